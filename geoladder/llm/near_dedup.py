"""MinHash near-dedup (3): BagMinHash signatures, bands, and verified multiset overlap.

Texts are multisets of five-word shingles (one shingle of all words where a text has fewer). Their weighted Jaccard
similarity is sum of min(counts) / sum of max(counts).

*Signatures.* A shingle of weight w owns the weight levels 1 .. w. Levels are grouped in dyadic layers (1], (1, 2],
(2, 4], (4, 8] ...; each layer of each shingle is a Poisson process whose rate is the layer's width, and each of its
points has a level in the layer and one of ``m`` registers. A layer that ends above w keeps the points whose level is at
most w. A register holds the earliest point that hits it; two texts agree on a register with exactly their weighted
Jaccard similarity as probability. Points come in order of time, and a process ends once it is later than the text's
latest register, so most shingles make a single point: the cost is about m log m points per text and one per shingle.

*Bands.* ``bands`` x ``rows`` registers; with 32 x 5 a pair of similarity 0.8 is missed with probability 3e-6, one of
0.85 with 2e-8.

*Links.* Texts that are the same as word sequences are one node from the start, with one representative. In a band's
bucket all members are compared with the bucket's hub (the node that meets most others), which is linear in its size.
Verified links give components. What can be missed so are links between members of one bucket that are now in different
components: the nodes of such buckets, and only these, go through an exact prefix-filter join (``across``), which finds
all their links between components. So the classes equal those from all pairs of every bucket.

*Verification* compares the multisets themselves. *Components* are found by min-label exchange over the links, each
round a written table; nothing but a count reaches the driver. Links that are counted to be few (``FEW_LINKS``) are
labelled by the driver, without any round: a round over few links costs its tasks and no more, and these are as many as
there are shuffle partitions.

Defined results: null counts as empty; texts without any word are one class; null doc ids are nodes like others; repeated
rows share a class; ``class_id`` is the smallest doc_id of a class (null only if it has no other); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _vec

U = np.uint64
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: 64-bit words of a set's parity bitmap.
PARITY_WORDS = 16
#: So many links (8 MB) at most are read by the driver.
FEW_LINKS = 1 << 19


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 random bits."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def bag_minhash(keys: np.ndarray, weights: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """Signatures (one row of ``m`` times per text) of weighted sets given as keys and positive integer weights.

    ``begin`` (n + 1 numbers) says where each text's keys begin. A text without keys has infinite times only.
    """
    n = len(begin) - 1
    sig = np.full(n * m, np.inf)
    doc = np.repeat(np.arange(n), np.diff(begin))
    # a process for each layer that begins below the weight: layer 0 is level 1, layer k has levels 2**(k-1)+1 .. 2**k
    layers = np.where(weights > 1, np.frexp((weights - 1).astype(np.float64))[1] + 1, 1)
    layer = np.arange(int(layers.sum())) - np.repeat(np.cumsum(layers) - layers, layers)
    of = np.repeat(np.arange(len(keys)), layers)
    width = np.where(layer == 0, 1, 1 << np.maximum(layer - 1, 0))
    low = np.where(layer == 0, 0, width)
    state = _vec.mix(keys[of] + layer.astype(U) * U(0x9E3779B97F4A7C15))
    inside, time, d = (weights[of] - low).astype(np.int64), np.zeros(len(of)), doc[of]
    latest = np.full(n, np.inf)
    k = 0
    while len(state):
        k += 1
        state = _vec.mix(state + U(0xD1B54A32D192ED03))
        time = time - np.log(_uniform(state)) / width
        alive = time < latest[d]
        if not alive.all():
            state, time, d, width, inside = state[alive], time[alive], d[alive], width[alive], inside[alive]
        if not len(state):
            break
        pick = _vec.mix(state ^ U(0xC2B2AE3D27D4EB4F))
        level = ((pick >> U(32)).astype(np.int64) * width) >> 32
        hit = level < inside
        np.minimum.at(sig, d[hit] * m + ((pick[hit] & U(0xFFFFFFFF)) % U(m)).astype(np.int64), time[hit])
        if len(state) * 8 < n:  # few texts are still at work
            some = np.unique(d)
            latest[some] = sig.reshape(n, m)[some].max(axis=1)
        else:
            latest = sig.reshape(n, m).max(axis=1, initial=0.0)
    return sig.reshape(n, m)


def multisets(buf: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, first key of each text, hash of each text's word sequence)."""
    hashes, first = _vec.word_hashes(buf, bounds)
    sh, begin = _vec.shingles(hashes, first, k)
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(begin))
    order = np.lexsort((sh, doc))
    s, d = sh[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(s)))
    # the word sequence's own hash, of its words' hashes
    raw, at_word = memoryview(np.ascontiguousarray(hashes)).cast("B"), (8 * first).tolist()
    whole = np.array([int.from_bytes(hashlib.blake2b(raw[i:j], digest_size=8).digest(), "little") for i, j in zip(at_word[:-1], at_word[1:], strict=True)], U)
    return s[at], counts, np.searchsorted(d[at], np.arange(n + 1)), whole


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Similarity of two multisets, each sorted keys and counts; two empty ones are equal."""
    na, nb = int(a[1].sum()), int(b[1].sum())
    if not na and not nb:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (na + nb - both)


def _signatures(bands: int, rows: int, k: int):
    """Per row: its node (the hash of the word sequence) and a key for each band; no keys for texts without words."""
    m = bands * rows

    def run(batches):
        for batch in batches:
            buf, bounds = _vec.text_buffers(batch.column(2))
            for i, j, b, o in _vec.chunks(buf, bounds):
                keys, counts, begin, node = multisets(b, o, k)
                sig = bag_minhash(keys, counts, begin, m).view(U).reshape(-1, bands, rows)
                h = np.broadcast_to(np.arange(bands, dtype=U), sig.shape[:2]).copy()
                for r in range(rows):
                    h = _vec.mix(h * U(0x100000001B3) + sig[:, :, r])
                some = np.diff(begin) > 0
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32), pa.array(h[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(node.view(np.int64)), lists], ["doc_id", "text_key", "node", "keys"])

    return run


def _verify(k: int):
    def run(batches):
        # rows of one hub mostly come together: its multiset is made once
        hub, hub_set = None, None
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (0, 1))
            n = batch.num_rows
            buf, bounds = _vec.text_buffers(batch.column(3))
            buf_a, bounds_a = _vec.text_buffers(batch.column(2))
            out = np.zeros(n)
            for i, j, x, o in _vec.chunks(buf, bounds):
                keys, counts, begin, _ = multisets(x, o, k)
                for r in range(i, j):
                    if hub != a[r]:
                        ka, ca, _, _ = multisets(buf_a[bounds_a[r] : bounds_a[r + 1]], np.array([0, bounds_a[r + 1] - bounds_a[r]]), k)
                        hub, hub_set = a[r], (ka, ca)
                    s = slice(begin[r - i], begin[r - i + 1])
                    out[r] = weighted_jaccard(hub_set, (keys[s], counts[s]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "similarity"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(a, b, similarity) of node pairs; ``texts``: (node, text)."""
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(tb, "b").join(ta, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_verify(k), "a bigint, b bigint, similarity double")


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links in ascending order, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))  # never above the node itself, so a tree's root is its smallest node
    while True:
        x, y = root[i], root[j]
        if np.array_equal(x, y):
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(far := root[root], root):
            root = far


def components(links: DataFrame, spark: SparkSession, what: str = "components", few: int | None = None) -> DataFrame:
    """(node, comp) for every node of (a, b) links; comp is the smallest node reachable.

    Labels shrink along links and are short-cut through the label's own label; the number of rounds is logarithmic for
    stars and chains alike. Every round is a written table, so that a lost executor costs one round at most. Links that
    are ``few`` at most need no rounds.
    """
    links = _shared.written(links.select("a", "b"), spark, f"{what}-links")
    if _shared.count_rows(links) <= (FEW_LINKS if few is None else few):
        pairs = _shared.read_table(links)
        _shared.discard(links)
        nodes, comp = least_reachable(*(pairs[c].to_numpy() for c in ("a", "b")))
        return _shared.written_here(pa.table({"node": nodes, "comp": comp}), spark, what)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = _shared.written(both, spark, f"{what}-edges")
    _shared.discard(links)
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    labels = old = _shared.written(labels, spark, what)
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("comp").alias("near"))
        best = edges.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = labels.join(best, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        now = hooked.join(jump, "next", "left").select("node", "comp", F.least("next", F.coalesce("far", "next")).alias("next"))
        now = _shared.written(now, spark, what)
        _shared.discard(old)
        changed, old = now.where("next <> comp").limit(1).count(), now
        labels = now.select("node", F.col("next").alias("comp"))
        if not changed:
            _shared.discard(edges)
            return labels


def _elements(keys: np.ndarray, counts: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A multiset as a set: an element for each occurrence of a key. (elements, text of each, texts' sizes)."""
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    of = np.repeat(np.arange(len(keys)), counts)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[of]
    return _vec.mix(keys[of] + nth.astype(U) * U(0x9E3779B97F4A7C15)), text, np.bincount(text, minlength=len(begin) - 1)


def _rarity(k: int, cells: int, slices: int = 16):
    """How many elements fall into each cell of a hash table of fixed size."""

    def run(batches):
        table = np.zeros(cells, np.uint32)
        for batch in batches:
            buf, bounds = _vec.text_buffers(batch.column(0))
            for _, _, b, o in _vec.chunks(buf, bounds):
                at, n = np.unique((_elements(*multisets(b, o, k)[:3])[0] % U(cells)).astype(np.int64), return_counts=True)
                table[at] += n.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(table, slices)], pa.binary())], ["slice", "counts"])

    return run


def _add_slices(folder: str):
    """Writes each slice of the tables' sum to a file; the table is for the executors and does not pass the driver."""

    def run(pdf):
        total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in pdf["counts"])
        out = _shared.SharedFile(folder, f"{pdf['slice'].iloc[0]}-{_shared.attempt()}")
        out.write(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes())
        pdf = pdf[["slice"]].iloc[:1].copy()
        pdf["uri"] = [out.close()]
        return pdf

    return run


@lru_cache(maxsize=1)
def _rarity_table(uris: tuple[str, ...]) -> np.ndarray:
    """The whole table from the files of its slices, in order; a worker reads it once."""
    return np.concatenate([np.frombuffer(_shared.read_shared(uri), np.uint32) for uri in uris])


def _prefixes(similarity: float, k: int, uris: tuple[str, ...]):
    """Of each node the elements that come first in the order of rarity, so many that a similar node must share one."""

    def run(batches):
        for batch in batches:
            table = _rarity_table(uris)
            buf, bounds = _vec.text_buffers(batch.column(2))
            for i, _, b, o in _vec.chunks(buf, bounds):
                el, text, size = _elements(*multisets(b, o, k)[:3])
                often = table[(el % U(len(table))).astype(np.int64)]
                shared = np.bincount(text, often > 1, len(size)).astype(np.int64)
                order = np.lexsort((el, often, text))
                begin = np.cumsum(size) - size
                take = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
                bits = np.zeros((len(size), 64 * PARITY_WORDS), np.uint8)
                np.bitwise_xor.at(bits, (text, ((el >> U(20)) % U(64 * PARITY_WORDS)).astype(np.int64)), 1)
                words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
                place = _vec.ragged(begin, take)
                el = el[order][place]
                of = np.repeat(np.arange(len(size)), take)
                left = size[of] - (place - begin[of])
                at = pa.array(of + i)
                lead = np.zeros(len(el), bool)
                lead[(np.cumsum(take) - take)[take > 0]] = True
                ends = np.concatenate([[0], np.cumsum(lead)]).astype(np.int32) * PARITY_WORDS
                parity = pa.ListArray.from_arrays(pa.array(ends), pa.array(words[take > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.repeat(size, take)), pa.array(np.repeat(shared, take)), pa.array(left), pa.array(el.view(np.int64)), parity], ["node", "comp", "size", "shared", "left", "element", "parity"])

    return run


def _candidates(live: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of nodes that no bound rules out, from the postings of elements that several components have.

    The condition is evaluated for each pair of an element's postings. Its columns are plain numbers without nulls, and no
    part of it occurs twice: with arrays, the compiled join was too long for the JVM to turn into machine code.
    """
    number = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    words = range(PARITY_WORDS)
    side = lambda s: [F.col("element"), F.col("node").alias(s), *[number(F.col(c)).alias(f"{c}_{s}") for c in ("comp", "size", "shared", "left")], *[number(F.col("parity")[i]).alias(f"bits{i}_{s}") for i in words]]
    # two sets of these sizes in all have so many elements in common at least; the slack only lets more pairs through
    needed = lambda sizes: F.ceil(sizes * (similarity / (1 + similarity)) - 1e-6)
    short = live.where(F.col("left") >= needed(2 * F.col("size")))
    differ = reduce(add, [F.bit_count(F.col(f"bits{i}_a").bitwiseXOR(F.col(f"bits{i}_b"))) for i in words])
    both = F.col("size_a") + F.col("size_b")
    larger = (F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    # each bit that differs is an element that only one of the two has
    fits = (F.col("comp_a") != F.col("comp_b")) & larger & (F.least("left_a", "left_b", "shared_a", "shared_b") >= needed(both)) & (differ <= both - 2 * needed(both))
    made = lambda x, y: x.select(*side("a")).join(y.select(*side("b")), "element").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    other, of_main = F.col("comp") != F.col("main"), F.col("comp") == F.col("main")
    return made(live.where(other), short).union(made(live.where(of_main), short.where(other))).distinct()


def across(text_of: DataFrame, nodes: DataFrame, spark: SparkSession, similarity: float, k: int, cells: int = 1 << 21) -> DataFrame:
    """All links (a, b) between nodes of different components: an exact prefix-filter join.

    Multisets are taken as sets of occurrences in one order, the rare ones first. Two sets of a Jaccard similarity s
    share one of their first n - ceil(s n) + 1 elements. Copies that were changed each in its own way begin with elements
    of their own, so they do not even become candidates; and two bounds of what two sets can have in common rule out pairs
    before they are made: elements that are nowhere else, and the bits in which parity bitmaps of the sets differ. Rarity is counted in a table of fixed size (8 MB); its
    collisions only blur the order, which may be any. The table lies in the shared folder while it is used. Of an element's
    nodes, those in its most frequent component are not paired with each other.

    All that two sets have in common lies from their first common element on, so a pair is made only where both have
    enough left there. For the smaller of two sets that is known before the join: it takes part only with the elements
    that a set of its own size could begin to agree at, which are about half of its prefix.
    """
    have = text_of.join(nodes, "node").select("node", "comp", "text")
    folder = _shared.new_folder(spark, "near-rarity")
    counted = have.select("text").mapInArrow(_rarity(k, cells), "slice int, counts binary").groupBy("slice").applyInPandas(_add_slices(folder), "slice int, uri string")
    uris = tuple(r.uri for r in sorted(counted.collect()))  # one name a slice, whatever the data are
    posts = have.mapInArrow(_prefixes(similarity, k, uris), "node bigint, comp bigint, size bigint, shared bigint, left bigint, element bigint, parity array<bigint>")
    posts = _shared.written(posts, spark, "near-prefixes")
    _shared.discard_folder(folder)
    per = posts.groupBy("element", "comp").agg(F.count("*").alias("n"))
    main = per.groupBy("element").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main")).where("comps > 1").select("element", "main")
    again = _shared.rehashed("element")
    live = posts.withColumn("again", again).join(main.withColumn("again", again), ["element", "again"]).drop("again")
    parity = posts.where(F.size("parity") > 0).select("node", "parity")
    live = _shared.written(live.drop("parity").join(parity, "node"), spark, "near-postings")
    pairs = _candidates(live, similarity)
    return verified(pairs, text_of, k).where(F.col("similarity") >= similarity).select("a", "b")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with row_key and text_key: alike for rows that are alike in doc_id and text, and never null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("text_key", F.xxhash64(text)).withColumn("row_key", F.xxhash64(F.col("doc_id").cast("bigint"), text))


def near_duplicates(docs: DataFrame, spark: SparkSession, similarity: float = SIMILARITY, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document row: doc_id, class_id (smallest doc_id of its class), comp (the class), text_key."""
    _shared.small_batches(spark)
    base = keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    member = base.select("doc_id", "text_key", "text").mapInArrow(_signatures(bands, rows, k), "doc_id bigint, text_key bigint, node bigint, keys array<bigint>")
    member = _shared.written(member, spark, "near-signatures")
    # copies are one node; its representative is a row of the smallest doc_id
    nodes = member.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("keys").alias("keys"))
    nodes = _shared.written(nodes.select("node", "rep.doc_id", "rep.text_key", "keys"), spark, "near-nodes")

    def bucket_rows() -> DataFrame:
        return nodes.select("node", F.posexplode("keys").alias("band", "key"))

    # a node's weight is how many others it meets: the original of many copies meets more of them than any copy does; a
    # node with its weight and buckets is one row, so that hubs and texts take no further join or distinct by node
    buckets = bucket_rows().groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    again = _shared.rehashed("band", "key")
    placed = bucket_rows().withColumn("again", again).join(buckets.withColumn("again", again), ["band", "key", "again"]).drop("again")
    crowded = placed.groupBy("node").agg(F.sum("size").alias("weight"), F.collect_list(F.struct("band", "key")).alias("at"))
    reps = nodes.select("node", F.xxhash64("doc_id").alias("id_key"), "text_key")
    crowded = _shared.written(crowded.join(reps, "node"), spark, "near-buckets")
    placed = crowded.select("node", "weight", F.inline("at"))
    hubs = placed.groupBy("band", "key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
    placed = placed.withColumn("again", again).join(hubs.withColumn("again", again), ["band", "key", "again"])
    placed = _shared.written(placed.select("band", "key", "node", "hub"), spark, "near-members")
    wanted = crowded.select("node", "id_key", "text_key")
    text_of = base.withColumn("id_key", F.xxhash64("doc_id")).select("id_key", "text_key", "text").join(wanted, ["id_key", "text_key"])
    text_of = _shared.written(text_of.select("node", "text").dropDuplicates(["node"]), spark, "near-texts")
    _shared.discard(crowded)
    # a node has a hub in each band at most, and pairs that come by node meet its text without another shuffle
    stars = placed.where("node <> hub").groupBy("node").agg(F.collect_set("hub").alias("hubs"))
    stars = stars.select(F.col("node").alias("b"), F.explode("hubs").alias("a"))
    links = verified(stars, text_of, k).where(F.col("similarity") >= similarity).select("a", "b")
    links = _shared.written(links, spark, "near-links")
    comp = components(links, spark)

    # nodes of buckets that are still split between components can have links that no hub has shown
    labelled = placed.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = labelled.groupBy("band", "key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("band", "key")
    rest = labelled.withColumn("again", again).join(split.withColumn("again", again), ["band", "key", "again"], "left_semi").select("node", "comp").distinct()
    rest = _shared.written(rest, spark, "near-open")
    more = _shared.written(across(text_of, rest, spark, similarity, k), spark, "near-across")
    if _shared.count_rows(more):
        comp = components(links.union(more), spark)
    _shared.discard(nodes, placed, text_of, links, rest, more)
    named = member.select("doc_id", "text_key", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    one = _shared.rehashed("comp")
    return named.withColumn("again", one).join(least.withColumn("again", one), ["comp", "again"]).select("doc_id", "class_id", "comp", "text_key")


def keep_one(docs: DataFrame, spark: SparkSession, **how) -> DataFrame:
    """One document row of each class, one with the smallest doc_id; the columns stay as they are."""
    classes = near_duplicates(docs, spark, **how)
    key, text_key = _shared.fresh(docs, "id", "text")
    keep = classes.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("k"))
    keep = keep.select(F.xxhash64("k.doc_id").alias(key), F.col("k.text_key").alias(text_key))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("bigint"))).withColumn(text_key, F.xxhash64(text)).join(keep, [key, text_key])
    return rows.dropDuplicates([key, text_key]).select(*[F.col(f"`{c}`") for c in docs.columns])
