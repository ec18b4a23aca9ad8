"""Suffix-array dedup (5): depth-limited radix sort.

A byte goes if it is covered by a string of ``length`` bytes that starts at some other place as well, in the same text or
another. Suffixes need to be ordered only through their first ``length`` bytes: groups that are equal to that depth are
exactly the repeated strings. The sort goes by most significant digits and drops a suffix as soon as it is alone.

1. *First digit: content.* Every window of ``length`` bytes is dealt by its anchor, the least (hashed) ``gram``-byte
   string in it, leftmost first. Equal windows have the same anchor at the same place, and neighbouring windows mostly
   share theirs, so one row per anchor stands for a run of about ``(length - gram) / 2`` windows. An anchor string that
   occurs once ends its windows' sort at once.
2. *Second digit: the whole run.* If the bytes that an anchor's run of windows spans, and the run itself, occur twice,
   all windows of both are repeated.
3. *Further digits.* What is left lies around the places where two texts begin or cease to agree. Their spans are
   fetched (one for each distinct span), their windows are sorted by ``length / 4`` bytes at a time, within their anchor
   string and place of it, and what stays together is compared byte by byte.

No group must fit in one task: counts are aggregated before they are shuffled, lookups are joins that adaptive execution
may split, and an anchor string's distinct spans are dealt out in parts of ``most_spans`` at most (some 10 MB), after which
only their windows' digests are counted across the parts. Smaller parts would make a digest for each of more windows.

Texts are keyed by a 64-bit hash and their length, strings by two rolling hashes of 62 bits each, modulo a prime.

Defined results: null counts as empty; matches never cross texts; repeated rows count as separate texts, so all of a
repeated text of at least ``length`` bytes goes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _vec

U = np.uint64
LENGTH = 400
GRAM = 100
MOST_SPANS = 20_000
#: Bytes of spans that are sorted at once.
SORT_BYTES = 2 << 20
TEXT = "text_key bigint, n_bytes bigint"


def anchors(buf: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all runs of windows with one anchor: (text, anchor, first window, last window, gram hash, span hash).

    Places are relative to the text.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, none.astype(U), none.astype(U)
    roll = _vec.Rolling(buf)
    p = np.arange(len(buf) - gram + 1)
    low = U((1 << 30) - 1)
    h = (roll(p, p + gram) & ~low) | p.astype(U)
    least = _vec.sliding_min(h, length - gram + 1)
    ok = np.zeros(len(least) + 1, np.int8)
    n_windows = np.maximum(np.diff(bounds) - length + 1, 0)
    long = n_windows > 0
    ok[bounds[:-1][long]] += 1
    np.subtract.at(ok, bounds[:-1][long] + n_windows[long], 1)
    ok = np.cumsum(ok[:-1]).astype(bool)
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    end = ok.copy()
    end[:-1] &= ~ok[1:] | new[1:]
    last = np.flatnonzero(end)
    at = (least[first] & low).astype(np.int64)
    span = _vec.mix(roll(first, last + length) ^ _vec.mix((at - first).astype(U) * U(0x9E3779B97F4A7C15) + (last - first).astype(U)))
    text = np.searchsorted(bounds, first, "right") - 1
    # empty texts share their start with the next one; the search finds the last of them, which is the one with windows
    off = bounds[text]
    return text, at - off, first - off, last - off, roll(at, at + gram), span


def _emit_anchors(length: int, gram: int):
    def run(batches):
        for batch in batches:
            buf, bounds = _vec.text_buffers(batch.column(3))
            for i, j, b, o in _vec.chunks(buf, bounds):
                text, a, s0, s1, g, u = anchors(b, o, length, gram)
                at = pa.array(text + i)
                head = [batch.column(k).take(at) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(a, pa.int64()), pa.array(s0, pa.int64()), pa.array(s1, pa.int64()), pa.array(g.view(np.int64)), pa.array(u.view(np.int64))], ["doc_id", "text_key", "n_bytes", "anchor", "first", "last", "gram", "span"])

    return run


def _emit_spans(length: int):
    """The bytes that each wanted run of windows spans."""
    kinds = [("gram", pa.int64()), ("span", pa.int64()), ("part", pa.int64()), ("copies", pa.int64()), ("anchor", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]

    def run(batches):
        for batch in batches:
            text = batch.column(2)
            wanted = batch.column(3)
            parents = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(wanted.offsets)))
            flat = wanted.flatten()
            cols = {k: np.asarray(flat.field(k)) for k, _ in kinds}
            buf, bounds = _vec.text_buffers(text)
            at = bounds[parents] + cols["first"]
            size = cols["last"] - cols["first"] + length
            for i in range(0, len(at), 4096):
                s = slice(i, i + 4096)
                data = buf[_vec.ragged(at[s], size[s])]
                offs = np.concatenate([[0], np.cumsum(size[s])]).astype(np.int32)
                spans = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data.tobytes())])
                keys = [batch.column(k).take(pa.array(parents[s])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(cols[k][s], t) for k, t in kinds], spans], ["text_key", "n_bytes", *[k for k, _ in kinds], "bytes"])

    return run


def radix_groups(buf: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings ``buf[at : at + length]`` within their groups, most significant digit first.

    Returns (index, class) of the strings that are not alone, classes being sets of equal strings.
    """
    roll = _vec.Rolling(buf)
    index = np.arange(len(at))
    _, group = np.unique(group, return_inverse=True)
    step = max(1, length // 4)
    depth = 0
    while True:
        n = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        many = n[group] > 1
        index, group = index[many], group[many]
        if not len(index) or depth >= length:
            break
        width = min(step, length - depth)
        begin = at[index] + depth
        digit = roll(begin, begin + width)
        order = np.lexsort((digit, group))
        index, group, digit = index[order], group[order], digit[order]
        new = np.ones(len(index), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        depth += width
    if len(index):  # the strings themselves, against the first of their class
        order = np.argsort(group, kind="stable")
        index, group = index[order], group[order]
        lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        lead = index[lead[np.cumsum(np.append(True, group[1:] != group[:-1])) - 1]]
        same = np.ones(len(index), bool)
        for i in range(0, len(index), 4096):
            s = slice(i, i + 4096)
            reach = np.arange(length)
            same[s] = (buf[at[index[s]][:, None] + reach] == buf[at[lead[s]][:, None] + reach]).all(1)
        for g in np.unique(group[~same]).tolist():  # different strings with the same hashes: by their bytes
            rows = np.flatnonzero(group == g)
            _, kind = np.unique(buf[at[index[rows]][:, None] + np.arange(length)], axis=0, return_inverse=True)
            group[rows] = group.max() + 1 + kind
        many = np.unique(group, return_counts=True)
        alone = np.isin(group, many[0][many[1] == 1])
        index, group = index[~alone], group[~alone]
    return index, group


_SORTED = f"{TEXT}, s0 bigint, s1 bigint, gram bigint, digest bigint"


def _sort_spans(length: int):
    """Repeated runs of window starts; for grams dealt over several tasks also a digest of each distinct window."""

    def work(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        col = {k: np.asarray(t[k].combine_chunks()) for k in ("text_key", "n_bytes", "gram", "span", "part", "copies", "anchor", "first", "last")}
        buf, bounds = _vec.text_buffers(t["bytes"])
        # a repeated row may have brought the same span twice
        _, one = np.unique(np.stack([col["gram"], col["span"]]), axis=1, return_index=True)
        n = (col["last"] - col["first"] + 1)[one]
        ctx = np.repeat(one, n)
        step = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n)
        at = bounds[:-1][ctx] + step
        place = col["anchor"][ctx] - col["first"][ctx] - step
        group = _vec.mix(col["gram"][ctx].view(U)) + place.astype(U) * U(0x9E3779B97F4A7C15)
        index, cls = radix_groups(buf, at, group, length)
        hit = np.zeros(len(ctx), bool)
        hit[index] = True
        out = []
        runs = np.flatnonzero(hit)
        if len(runs):
            new = np.append(True, (runs[1:] != runs[:-1] + 1) | (ctx[runs[1:]] != ctx[runs[:-1]]))
            a, b = runs[new], runs[np.append(np.flatnonzero(new)[1:] - 1, len(runs) - 1)]
            c = ctx[a]
            out.append((col["text_key"][c], col["n_bytes"][c], col["first"][c] + step[a], col["first"][c] + step[b], np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)))
        dealt = np.flatnonzero(col["part"][ctx] >= 0)
        if len(dealt):
            keep = np.ones(len(ctx), bool)
            keep[index] = False
            keep[index[np.unique(cls, return_index=True)[1]]] = True  # one of each class
            d = dealt[keep[dealt]]
            digest = _vec.mix(_vec.Rolling(buf)(at[d], at[d] + length) ^ place[d].astype(U))
            c = ctx[d]
            s = col["first"][c] + step[d]
            out.append((col["text_key"][c], col["n_bytes"][c], s, s, col["gram"][c], digest.view(np.int64)))
        for cols in out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["text_key", "n_bytes", "s0", "s1", "gram", "digest"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            g, p = np.asarray(batch.column("gram")), np.asarray(batch.column("part"))
            cut = np.append(np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1])) + 1, batch.num_rows)
            start = 0
            for c in cut.tolist():
                same = held and held[-1].column("gram")[-1] == batch.column("gram")[start] and held[-1].column("part")[-1] == batch.column("part")[start]
                if size >= SORT_BYTES and not same:
                    yield from work(held)
                    held, size = [], 0
                held.append(batch.slice(start, c - start))
                size += held[-1].column("bytes").nbytes
                start = c
        if held:
            yield from work(held)

    return run


def _cut(length: int):
    """Removes what the windows cover."""

    def run(batches):
        for batch in batches:
            buf, bounds = _vec.text_buffers(batch.column(1))
            lists = batch.column(2)
            per = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            parent = np.repeat(np.arange(batch.num_rows), per)
            s0, s1 = np.asarray(flat.field("s0")), np.asarray(flat.field("s1"))
            change = np.zeros(len(buf) + 1, np.int64)
            np.add.at(change, bounds[parent] + s0, 1)
            np.add.at(change, bounds[parent] + s1 + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = np.diff(sums[bounds])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = bounds[:-1][bounds[:-1] < len(buf)]
            begins[inner] = gone[inner]
            spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[bounds])
            kept = buf[~gone].tobytes()
            ends = (bounds - sums[bounds]).tolist()
            sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            texts = [kept[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(texts, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_windows(docs: DataFrame, spark: SparkSession, length: int = LENGTH, gram: int = GRAM, most_spans: int = MOST_SPANS) -> DataFrame:
    """(text_key, n_bytes, runs): per text the runs (s0, s1) of window starts whose strings occur elsewhere too.

    ``docs``: see ``_base``. The result is a written table.
    """
    a = docs.where(F.col("n_bytes") >= length).select("doc_id", "text_key", "n_bytes", "text").mapInArrow(_emit_anchors(length, gram), f"doc_id bigint, {TEXT}, anchor bigint, first bigint, last bigint, gram bigint, span bigint")
    a = _shared.written(a, spark, "span-anchors")
    twice = a.groupBy("gram").agg(F.count("*").alias("n"), F.min("span").alias("x"), F.max("span").alias("y")).where("n > 1").select("gram", (F.col("x") != F.col("y")).alias("mixed"))
    again = _shared.rehashed("gram")
    live = a.withColumn("again", again).join(twice.withColumn("again", again), ["gram", "again"]).drop("again")
    live = _shared.written(live, spark, "span-live")
    _shared.discard(a)
    spans = live.groupBy("gram", "span").agg(F.count("*").alias("copies"), F.first("mixed").alias("mixed"), F.min(F.struct("doc_id", "text_key", "n_bytes", "anchor", "first", "last")).alias("at"))
    spans = _shared.written(spans.select("gram", "span", "copies", "mixed", "at.*"), spark, "span-spans")

    both = _shared.rehashed("gram", "span")
    full = live.withColumn("again", both).join(spans.where("copies > 1").select("gram", "span").withColumn("again", both), ["gram", "span", "again"], "left_semi")
    full = full.select("text_key", "n_bytes", F.col("first").alias("s0"), F.col("last").alias("s1")).distinct()

    fine = spans.where("mixed")
    big = fine.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > most_spans).select("gram", F.ceil(F.col("n") / most_spans).cast("bigint").alias("parts"))
    fine = fine.withColumn("again", again).join(big.withColumn("again", again), ["gram", "again"], "left").withColumn("part", F.coalesce(F.pmod(F.col("span"), F.col("parts")), F.lit(-1).cast("bigint")))
    wanted = fine.groupBy(F.xxhash64("doc_id").alias("id_key"), "text_key", "n_bytes").agg(F.collect_list(F.struct("gram", "span", "part", "copies", "anchor", "first", "last")).alias("wanted"))
    got = docs.select(F.xxhash64("doc_id").alias("id_key"), "text_key", "n_bytes", "text").join(wanted, ["id_key", "text_key", "n_bytes"])
    got = got.select("text_key", "n_bytes", "text", "wanted").mapInArrow(_emit_spans(length), f"{TEXT}, gram bigint, span bigint, part bigint, copies bigint, anchor bigint, first bigint, last bigint, bytes binary")
    order = got.repartition("gram", "part").sortWithinPartitions("gram", "part")
    done = _shared.written(order.mapInArrow(_sort_spans(length), _SORTED), spark, "span-sorted")
    near = done.where("digest = 0 and gram = 0").select("text_key", "n_bytes", "s0", "s1")
    # windows of anchors that were dealt over several tasks
    dealt = done.where("digest <> 0 or gram <> 0")
    twin = dealt.groupBy("gram", "digest").agg(F.count("*").alias("n")).where("n > 1").select("gram", "digest")
    far = dealt.join(twin, ["gram", "digest"], "left_semi").select("text_key", "n_bytes", "s0", "s1")
    # every other member of a class that was repeated within its task is already in ``near``
    runs = full.union(near).union(far) if big.limit(1).count() else full.union(near)
    out = _shared.written(runs.groupBy("text_key", "n_bytes").agg(F.collect_set(F.struct("s0", "s1")).alias("runs")), spark, "span-runs")
    _shared.discard(live, spans, done)
    return out


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, text (bytes), text_key, n_bytes."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _shared.utf8(F.col("text").cast("string")).alias("text")).withColumn("text_key", F.xxhash64("text")).withColumn("n_bytes", F.octet_length("text").cast("bigint"))


def remove_repeats(docs: DataFrame, spark: SparkSession, length: int = LENGTH, gram: int = GRAM, most_spans: int = MOST_SPANS) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    _shared.small_batches(spark)
    gram = min(gram, length)
    base = _base(docs)
    per_text = repeated_windows(base, spark, length, gram, most_spans)
    again = _shared.rehashed("text_key", "n_bytes")
    none = F.array().cast("array<struct<s0:bigint,s1:bigint>>")
    rows = base.withColumn("again", again).join(per_text.withColumn("again", again), ["text_key", "n_bytes", "again"], "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
    return rows.mapInArrow(_cut(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
