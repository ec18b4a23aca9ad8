"""The version catalogue, and facts about a file from its column chunks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoladder.plans.ladder import WORLD_DEGREES

# Fixed value: the shape of the catalogue document.
MANIFEST = "latest string, base string, versions array<struct<version:string,prefix:string,spec:string,datasets:array<struct<id:string,label:string,path:string>>>>"


def datasets(manifests: DataFrame, text: str = "text") -> DataFrame:
    """latest, base, version, prefix, id, label, path of every dataset; a malformed document gives no rows."""
    m = manifests.select(F.from_json(text, MANIFEST).alias("m")).where("m.versions is not null").select("m.latest", "m.base", F.explode("m.versions").alias("v"))
    return m.select("latest", "base", "v.version", "v.prefix", F.explode("v.datasets").alias("d")).where("d.id is not null").select("latest", "base", "version", "prefix", "d.id", "d.label", "d.path")


def twins(sets: DataFrame, version: str, other: str) -> DataFrame:
    """The datasets of a version with the label of the same dataset in another, null if it has none."""
    a = sets.where(F.col("version") == version).select("id", "label")
    b = sets.where(F.col("version") == other).select("id", F.col("label").alias("twin_label"))
    return a.join(b, "id", "left")


def file_facts(chunks: DataFrame) -> DataFrame:
    """One row about a file from its chunks (rg, rows, column, nbytes, raw_bytes, codec)."""
    per = chunks.groupBy("rg").agg(F.max("rows").alias("rows"), F.sum("nbytes").alias("nbytes"))
    groups = per.agg(F.count("*").alias("row_groups"), F.sum("rows").alias("rows"), F.percentile("nbytes", 0.5).alias("median_bytes"))
    part = lambda c: F.coalesce(F.sum(F.when(F.col("column") == c, F.col("nbytes"))), F.lit(0))
    n = F.countDistinct("codec")
    every = chunks.agg(F.sum("nbytes").alias("nbytes"), F.when(n == 0, "unknown").when(n == 1, F.min("codec")).otherwise("mixed").alias("codec"), F.round(F.sum("raw_bytes") / F.sum("nbytes"), 6).alias("ratio"), part("geometry").alias("exact_bytes"), part("geom_overview").alias("overview_bytes"))
    return groups.crossJoin(every).select("row_groups", "rows", "nbytes", "codec", "ratio", "median_bytes", "exact_bytes", "overview_bytes")  # one row each


def overfetch(rows: DataFrame, zooms: Iterable[int]) -> DataFrame:
    """zoom, per_pixel: features per pixel of the extent, if all are read at that zoom."""
    e = rows.agg(F.count("*").alias("n"), (F.max("cx") - F.min("cx")).alias("w"), (F.max("cy") - F.min("cy")).alias("h"))
    z = e.withColumn("zoom", F.explode(F.array(*[F.lit(int(v)) for v in zooms])))
    pixel = F.lit(WORLD_DEGREES) / (256 * F.pow(F.lit(2.0), F.col("zoom")))
    return z.select("zoom", F.round(F.col("n") / (F.col("w") * F.col("h") / F.pow(pixel, F.lit(2))), 9).alias("per_pixel"))
