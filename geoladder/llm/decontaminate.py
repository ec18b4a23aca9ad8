"""Benchmark decontamination (4), native: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Texts are lower-cased and cut into words. A window is as many words as the item has, at any place of a document (cut off
at the document's ends). Window and item are compared as multisets of five-word shingles (one of all words for shorter
items); from a weighted Jaccard similarity of ``similarity`` on, the document holds the item.

Pre-selection: a window that reaches the similarity has at least that share of an item's number of shingles in common with
it. So the places of shingles that any item of a size has are gathered by document, whatever item they come from, and a
window is fingerprinted at every start, from before the document's first word to its last one, that has so many of them;
at any other start the similarity is lower, so nothing is lost. (Without it, each word of the corpus would begin a window
per item size: some 45 fingerprints of 64 bits a word, each looked up by eight blocks.) What a window may hold, and which
item, is found by the fingerprints alone. Each window gets a 64-bit SimHash, the majority of its shingles' hashes bit by bit, repeats counted. Fingerprints are
searched by eight blocks of eight bits: if two differ in at most 23 bits, some block differs in at most 2, so the items'
blocks are stored with all their neighbours within 2 bits, and an equi-join on (size, block, value) finds every item
within the radius. At similarity 0.8 the expected distance is 10 bits with a deviation of 3. Candidates within the
radius are then compared exactly.

Documents are read twice: for the places, and for the windows of documents that have any. ``leaks`` reports the best of
all windows as ``similarity`` and their number as ``windows``.

Only DataFrame and SQL functions are used. The starts, which are written, and the items' shingles and blocks are broadcast
if they hold at most ``broadcast_rows`` numbers, which are counted first; more are shuffled.

Defined results: null texts are empty; items without words match nothing; ``leaks`` leaves out items with a null id, as
the SQL does, and ``clean`` removes what holds them; rows that are repeated, or
share a doc_id, are flagged together in ``leaks`` and one by one in ``clean``; an empty benchmark flags nothing; an empty
table gives no rows; other columns stay as they are, whatever their names; very long texts are one row like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, NEAR = 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
BROADCAST_ROWS = 200_000
SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Lower-case words; a text without any gives one empty word."""
    return F.split(F.lower(F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACE))), r"[\x20\x09-\x0D]+")


def shingles(ws: Column, k: int = SHINGLE) -> Column:
    """Hashes of all runs of k words (one of all words, if there are fewer), with repeats."""
    last = F.greatest(F.size(ws) - k, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(ws, i + 1, k)))


def simhash(hashes: Column) -> Column:
    """64 majority bits of an array of hashes."""
    bit = lambda b: F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.when(F.getbit(h, b) == 1, 1).otherwise(-1)) > 0
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(bit(b), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


def block_values(fingerprint: Column) -> Column:
    """(block, value) of the eight blocks of a fingerprint."""
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.struct(b.alias("block"), F.call_function("shiftright", fingerprint, b * 8).bitwiseAND(F.lit(255)).cast("int").alias("value")))


def overlap(a: Column, b: Column) -> Column:
    """Sum of the smaller counts of two arrays of hashes with repeats."""
    count = lambda arr, h: F.size(F.filter(arr, lambda x: x == h))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, h: acc + F.least(count(a, h), count(b, h)))


def items(benchmark: DataFrame, k: int = SHINGLE) -> DataFrame:
    """item_key, item_id, size, hashes, fingerprint; items that are repeated once."""
    i = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), words(F.col("text")).alias("ws")).where("ws[0] <> ''")
    i = i.withColumn("item_key", F.xxhash64("item_id", "ws")).dropDuplicates(["item_key"])
    return i.select("item_key", "item_id", F.size("ws").alias("size"), shingles(F.col("ws"), k).alias("hashes")).withColumn("fingerprint", simhash(F.col("hashes")))


def _bounded(df: DataFrame, limit: int, array: str | None = None) -> DataFrame:
    """Broadcast, if it is counted to be small: its rows, or the entries of its arrays."""
    size = df.limit(limit + 1).agg(F.count("*") if array is None else F.sum(F.size(array)) + F.count("*")).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def starts_of(places: Column, most: Column, need: Column) -> Column:
    """All window starts that have ``need`` or more of the sorted places among their ``most`` shingles.

    A start belongs to the first place at or after it, so none comes twice.
    """

    def before(j: Column) -> Column:
        first = F.greatest(F.get(places, j + need - 1) - most + 1, F.get(places, j - 1) + 1)
        return F.when(first <= F.get(places, j), F.sequence(first, F.get(places, j))).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(places) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size(places) - need), before)))


def found(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, similarity: float = SIMILARITY, k: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_key, item_id, start, similarity of every window that holds an item."""
    item = items(benchmark, k)
    at = _bounded(item.select("size", F.least("size", F.lit(k)).alias("n"), F.explode("hashes").alias("shingle")).distinct(), broadcast_rows)
    lengths = [r.n for r in at.select("n").distinct().collect()]  # at most k numbers
    if not lengths:
        return spark.createDataFrame([], "doc_id bigint, text_key bigint, item_id bigint, start int, similarity double")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), words(F.col("text")).alias("ws"))
    hits = None
    for n in sorted(lengths):
        here = base.select("doc_id", "text_key", "ws", F.explode(F.when(F.size("ws") >= n, F.sequence(F.lit(0), F.size("ws") - n))).alias("i"))
        here = here.withColumn("shingle", F.xxhash64(F.slice("ws", F.col("i") + 1, n)) if n != k or k > 8 else F.xxhash64(F.array(*[F.get("ws", F.col("i") + j) for j in range(n)])))
        hit = here.join(at.where(F.col("n") == n), "shingle").select("doc_id", "text_key", "size", "n", "i")
        hits = hit if hits is None else hits.unionByName(hit)
    most = F.col("size") - F.col("n") + 1  # the item's shingles
    need = F.greatest(F.ceil(most * F.lit(similarity) - 1e-6).cast("int"), F.lit(1))
    starts = hits.groupBy("doc_id", "text_key", "size", "n").agg(F.sort_array(F.collect_set("i")).alias("places"))
    starts = starts.select(F.col("doc_id").alias("s_doc"), F.col("text_key").alias("s_text"), "size", "n", starts_of(F.col("places"), most, need).alias("starts")).where(F.size("starts") > 0)
    starts = _bounded(_shared.written(starts, spark, "leak-starts"), broadcast_rows, "starts")
    windows = base.join(starts, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("text_key") == F.col("s_text")))
    windows = windows.withColumn("all", F.transform(F.sequence(F.lit(0), F.size("ws") - F.col("n")), lambda i: F.xxhash64(F.slice("ws", i + 1, F.col("n")))))
    windows = windows.select("doc_id", "text_key", "size", most.alias("most"), "all", F.explode("starts").alias("start")).withColumn("first", F.greatest("start", F.lit(0)))
    # slice() ends with the array, as the window does with the document
    windows = windows.select("doc_id", "text_key", "size", "start", F.slice("all", F.col("first") + 1, F.col("most") + F.col("start") - F.col("first")).alias("hashes"))
    windows = windows.withColumn("fingerprint", simhash(F.col("hashes")))

    near = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda m: F.bit_count(m) <= NEAR)
    index = item.select("item_key", "size", F.col("fingerprint").alias("item_fingerprint"), F.explode(block_values(F.col("fingerprint"))).alias("b")).select("item_key", "size", "item_fingerprint", "b.block", F.explode(F.transform(near, lambda m: m.bitwiseXOR(F.col("b.value")))).alias("value"))
    probe = windows.withColumn("b", F.explode(block_values(F.col("fingerprint")))).select("*", "b.block", "b.value").drop("b")
    pairs = probe.join(_bounded(index, broadcast_rows), ["size", "block", "value"])
    differ = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    # a pair that several blocks find counts at the first of them
    earlier = F.exists(block_values(differ), lambda b: (b["block"] < F.col("block")) & (F.bit_count(b["value"]) <= NEAR))
    pairs = pairs.where((F.bit_count(differ) <= RADIUS) & ~earlier).select("doc_id", "text_key", "start", "hashes", "item_key")
    known = item.select("item_key", "item_id", F.col("hashes").alias("item_hashes"))
    pairs = pairs.join(_bounded(known, broadcast_rows, "item_hashes"), "item_key")
    pairs = pairs.withColumn("both", overlap(F.col("hashes"), F.col("item_hashes")))
    pairs = pairs.withColumn("similarity", F.col("both") / (F.size("hashes") + F.size("item_hashes") - F.col("both"))).where(F.col("similarity") >= similarity)
    return pairs.select("doc_id", "text_key", "item_id", "start", "similarity")


def leaks(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, **how) -> DataFrame:
    """doc_id, item_id, similarity (the best window's), windows (how many hold it): one row per document and item."""
    rows = found(docs, benchmark.where("item_id is not null"), spark, **how)
    return rows.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.countDistinct("text_key", "start").alias("windows"))


def clean(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, **how) -> DataFrame:
    """The rows that hold no item; the columns stay as they are."""
    key, text = _shared.fresh(docs, "id", "text")
    bad = found(docs, benchmark, spark, **how).select(F.xxhash64("doc_id").alias(key), F.coalesce("text_key", F.lit(0)).alias(text)).distinct()
    rows = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("bigint"))).withColumn(text, F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)))
    return rows.join(bad, [key, text], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
