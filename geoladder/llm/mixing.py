"""Mixing sources to target weights (6): weighted fair queueing.

Every source has a target: its weight's share of the total size, but at most ``most`` times its own size; what a source
cannot take is shared by weight among the others until none is above its limit. That is the water level L with
target = min(limit, L * weight) and targets that add up to the total, found from running sums over the sources in order
of limit / weight.

Each document's passes (1 .. most) are queued in their source's shuffled order. A pass's virtual finish time is the
source's words up to and with it, divided by the source's target. At time 1 every source has had its target, and the
targets add up to the total budget; a pass that is under way then is cut there, so it gives its first words only. All
passes are sorted by virtual finish time, and the sorted queue is cut where the total budget is used up. So a source's
words differ from its target by less than one.

Rows that are equal in doc_id, text and source are one entry of the queue, with all their words, so that a hot group is
summed up before anything is shuffled; what the entry takes is dealt out among them again: whole passes first, then one
more for the first ones, then the cut pass for the next.

Neither the running sums per source nor the one over the global order runs in one task: rows fall into buckets of the
order, buckets into groups of ``GROUP``, and sums are carried from groups to buckets to rows. A bucket has about
``rows_per_bucket`` rows, whatever the source's share of the table is. Sources are one row each and are sorted in one
task, so they should be kinds of origin, not single addresses.

Defined results: a null text has size 0; documents of size 0 take nothing and do not queue; null is a source of its own,
the last one; repeated rows are separate documents; an empty table gives no rows; other columns are ignored by
``allocate`` and stay as they are in ``mix``, whatever their names (a cut text's length in another column as well). Very
long texts are like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of runs of signs other than the six white-space signs; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """source, source_size, target of each source, from (source, source_size). One row per source comes in and goes out."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1)).withColumn("limit", F.col("source_size").cast("double") * most)
    level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        s.withColumn("budget", F.sum(F.col("source_size").cast("double")).over(all_rows) * share)
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("at", F.col("left") / F.col("open_weight"))
        .withColumn("full", F.col("at") * F.col("weight") >= F.col("limit"))
    )
    # sources below the level are full; the first that is not sets the level of all that follow
    return s.withColumn("level", F.min(F.when(~F.col("full"), F.struct((F.col("limit") / F.col("weight")).alias("ratio"), F.col("at")))).over(all_rows)["at"]).select(
        "source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight"))).alias("target")
    )


#: Buckets whose sums are added up in one task.
GROUP = 1024
#: Sources that are broadcast, if they are counted to be no more.
BROADCAST_SOURCES = 50_000
BROADCAST_DEALS = 50_000


def running_sum(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each one, per ``keys``, in ``order``; ``bucket`` must not fall in that order.

    No key may be null.
    """
    df = df.withColumn("__bucket", bucket.cast("bigint")).withColumn("__group", F.floor(F.col("__bucket") / GROUP))
    sums = df.groupBy(*keys, "__group", "__bucket").agg(F.sum(value).alias("__sum"))
    groups = sums.groupBy(*keys, "__group").agg(F.sum("__sum").alias("__sum"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = Window.partitionBy(*keys).orderBy("__group") if keys else Window.orderBy("__group")
    groups = groups.select(*keys, "__group", before(over, "__sum").alias("__group_before"))
    sums = sums.join(groups, [*keys, "__group"])
    sums = sums.select(*keys, "__group", "__bucket", (F.col("__group_before") + before(Window.partitionBy(*keys, "__group").orderBy("__bucket"), "__sum")).alias("__before"))
    joined = df.join(sums, [*keys, "__group", "__bucket"])
    inside = before(Window.partitionBy(*keys, "__group", "__bucket").orderBy(*order), value)
    return joined.withColumn(out, F.col("__before") + inside).drop("__bucket", "__group", "__before")


def _queue(docs: DataFrame, spark: SparkSession, weights: tuple[float, ...], share: float, most: int, seed: int, rows_per_bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries: doc_id, text_key, source, size, copies; targets by source; words that each entry takes)."""
    source = F.col("source").cast("string")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), source.alias("source"), word_count(F.col("text")).alias("size"))
    # the texts are read once; what follows works on a few numbers per entry
    entries = _shared.written(slim.groupBy("doc_id", "text_key", "source").agg(F.first("size").alias("size"), F.count("*").alias("copies")), spark, "mix-sizes")
    n, total = entries.agg(F.count(F.when(F.col("size") > 0, 1)), F.sum(F.col("size") * F.col("copies"))).first()
    targets = source_targets(entries.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, most)
    # a number stands for each source, since null must be a key as well
    targets = _shared.written(targets.withColumn("source_no", F.xxhash64(F.col("source").isNull(), "source")), spark, "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    waiting = entries.where("size > 0").withColumn("source_no", F.xxhash64(F.col("source").isNull(), "source")).drop("source")
    waiting = waiting.withColumn("words", F.col("size") * F.col("copies")).withColumn("shuffled", F.shiftrightunsigned(F.xxhash64("doc_id", "text_key", "source_no", F.lit(seed)), 1))
    # shuffled is uniform over 63 bits: its place among equal parts of that range is the bucket, within a source
    rows_of = waiting.groupBy("source_no").agg(F.count("*").alias("source_rows"))
    known = targets.join(rows_of, "source_no").select("source_no", "source_size", "target", "source_rows")
    waiting = waiting.join(F.broadcast(known) if targets.count() <= BROADCAST_SOURCES else known, "source_no")
    parts = F.ceil(F.col("source_rows") / rows_per_bucket)
    place = F.least(F.floor(F.col("shuffled").cast("double") / float(1 << 63) * parts), parts - 1)
    key = [F.col("shuffled"), F.col("doc_id"), F.col("text_key")]
    waiting = running_sum(waiting, ["source_no"], key, place, "words", "before")
    passes = waiting.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("start", F.col("pass") * F.col("source_size") + F.col("before"))
    # what is under way at time 1 is cut there
    passes = passes.withColumn("words", F.least(F.col("words"), F.floor(F.col("target")) - F.col("start"))).where("words > 0")
    passes = passes.withColumn("finish", (F.col("start") + F.col("words")) / F.col("target"))
    at = F.floor(F.col("finish") * max(1, -(-n * most // rows_per_bucket)))
    queue = running_sum(passes.select("doc_id", "text_key", "source_no", "pass", "shuffled", "words", "finish"), [], [F.col("finish"), F.col("source_no"), F.col("pass"), *key], at, "words", "queued")
    budget = int((total or 0) * share + 1e-6)
    taken = queue.withColumn("words", F.least(F.col("words"), F.lit(budget) - F.col("queued"))).where("words > 0")
    return entries, targets, taken.groupBy("doc_id", "text_key", "source_no").agg(F.sum("words").alias("words"))


def plan(docs: DataFrame, spark: SparkSession, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = 3, seed: int = 17, rows_per_bucket: int = 64) -> DataFrame:
    """One row per entry of equal rows: doc_id, text_key, source, size, copies, source_size, target, and how its words are
    dealt out: each copy takes ``passes`` whole ones, the first ``more`` copies one more, and the next one ``part`` words."""
    entries, targets, taken = _queue(docs, spark, weights, share, most, seed, rows_per_bucket)
    rows = entries.withColumn("source_no", F.xxhash64(F.col("source").isNull(), "source")).join(targets.drop("source"), "source_no")
    t = taken.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__text"), F.col("source_no").alias("__source"), "words")
    rows = rows.join(t, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__text")) & (F.col("source_no") == F.col("__source")), "left")
    words = F.coalesce(F.col("words"), F.lit(0))
    rest = words - F.col("passes") * F.col("size") * F.col("copies")
    rows = rows.withColumn("passes", F.when(F.col("size") > 0, F.expr("coalesce(words, 0) div (size * copies)")).otherwise(0)).withColumn("rest", F.when(F.col("size") > 0, rest).otherwise(0))
    rows = rows.withColumn("more", F.when(F.col("size") > 0, F.expr("rest div size")).otherwise(0)).withColumn("part", F.col("rest") - F.col("more") * F.col("size"))
    return rows.select("doc_id", "text_key", "source", "size", "copies", "source_size", "target", "passes", "more", "part")


def allocate(docs: DataFrame, spark: SparkSession, **how) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, passes (whole ones), part (words of a cut one), taken (words) of
    each document row."""
    rows = plan(docs, spark, **how)
    # in two steps, so that no array is long
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / GROUP))))
    each = blocks.withColumn("nth", F.explode(F.sequence(F.col("block") * GROUP, F.least(F.col("copies"), (F.col("block") + 1) * GROUP) - 1)))
    passes = F.col("passes") + F.when(F.col("nth") < F.col("more"), 1).otherwise(0)
    part = F.when(F.col("nth") == F.col("more"), F.col("part")).otherwise(0)
    each = each.select("doc_id", "text_key", "source", "size", "source_size", "target", passes.cast("bigint").alias("passes"), part.cast("bigint").alias("part"))
    return each.withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n), "")


def mix(docs: DataFrame, spark: SparkSession, **how) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it, the last time perhaps with its first words only;
    the other columns stay as they are."""
    doc, text, source, part, order, number = _shared.fresh(docs, "doc", "text", "source", "part", "order", "number")
    deal = plan(docs, spark, **how).where("passes > 0 or more > 0 or part > 0")
    deal = _shared.written(deal.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__text"), F.col("source").alias("__source"), "copies", "passes", "more", "part"), spark, "mix-plan")
    names = ["__doc", "__text", "__source", "copies", "passes", "more", "part"]
    renamed = _shared.fresh(docs, *[f"deal_{c}" for c in names])
    deal = deal.select(*[F.col(c).alias(x) for c, x in zip(names, renamed, strict=True)])
    d, t, s, copies, passes, more, some = renamed
    keyed = docs.withColumns({doc: F.col("doc_id").cast("bigint"), text: F.xxhash64(F.col("text").cast("string")), source: F.col("source").cast("string"), part: F.spark_partition_id()})
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # copies that share unevenly are numbered: by the part of the table that they lie in, and within it by all they hold
    odd = F.col(copies) > 1
    uneven = odd & ((F.col(more) > 0) | (F.col(some) > 0))
    few = deal.where(uneven)
    if few.limit(BROADCAST_DEALS + 1).count() <= BROADCAST_DEALS:
        few = F.broadcast(few)  # else the texts are shuffled for these rows once more
    plain = keyed.join(deal.where(~uneven), same(doc, d) & (F.col(text) == F.col(t)) & same(source, s)).withColumn(number, F.lit(0).cast("bigint"))
    apart = keyed.withColumn(order, F.xxhash64(*[F.col(f"`{c}`").cast("string") if not kind.startswith(("map", "variant")) else F.lit(0) for c, kind in docs.dtypes])).join(few, same(doc, d) & (F.col(text) == F.col(t)) & same(source, s))
    key = [F.hash(doc, text, source), F.col(doc), F.col(text), F.col(source)]
    counts = apart.groupBy(doc, text, source, part).agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.select(F.col(doc).alias("c_doc"), F.col(text).alias("c_text"), F.col(source).alias("c_source"), F.col(part).alias("c_part"), "before")
    names = ["c_doc", "c_text", "c_source", "c_part", "before"]
    found = _shared.fresh(docs, *[f"count_{c}" for c in names])
    counts = counts.select(*[F.col(c).alias(x) for c, x in zip(names, found, strict=True)])
    on = same(doc, found[0]) & (F.col(text) == F.col(found[1])) & same(source, found[2]) & (F.col(part) == F.col(found[3]))
    inside = F.row_number().over(Window.partitionBy(*key, part).orderBy(order)) - 1
    apart = apart.join(counts, on).withColumn(number, F.col(found[4]) + inside)
    used = [*docs.columns, number, passes, more, some]
    rows = plain.select(*[F.col(f"`{c}`") for c in used]).unionByName(apart.select(*[F.col(f"`{c}`") for c in used]))
    whole = (F.col(passes) + F.when(F.col(number) < F.col(more), 1).otherwise(0)).cast("int")
    last = F.when(F.col(number) == F.col(more), F.col(some)).otherwise(0).cast("int")
    texts = F.concat(F.array_repeat(F.lit(-1), whole), F.when(last > 0, F.array(last)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn(order, F.explode(texts))
    cut = F.when(F.col(order) < 0, F.col("text")).otherwise(first_words(F.col("text").cast("string"), F.col(order)))
    return rows.select(*[cut.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
