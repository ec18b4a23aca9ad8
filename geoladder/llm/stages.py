"""The stages of the training-data pipeline; each takes (spark, docs, sf_dir) and returns the documents that it keeps.

All but the last return the columns of ``docs``, whatever they are called, one row per kept row; an empty table gives an
empty one with the same columns. What a stage does with nulls, empty texts, ties and repeated rows is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, near_dedup, quality, token_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of a good grade is at least one half, without those that were rated lower.

    A null or empty text is scored by its features, of which it has none; rows without doc_id have no rating; repeated
    rows and equal texts get the same score and stay or go together.
    """
    return quality.select(docs, _table(spark, sf_dir, "labels"), spark).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Null and empty texts, and those of white space alone, are one group; a null doc_id counts as larger than all others;
    of repeated rows, and of rows with one doc_id and text, one stays.
    """
    return near_dedup.keep_one(docs, spark)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none, items without words are in no text, items without an id count; repeated rows stay or
    go together, rows that share only a doc_id are judged one by one.
    """
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"), spark)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; where a source's target ends within a document, its first
    words only (one document a source, at most).

    Null and empty texts have no words and are not taken; null is a source of its own; repeated rows are separate
    documents, ties in the queue are broken by ids and hashes, so that reruns agree.
    """
    return mixing.mix(docs, spark)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The directory of the written token codes: doc_id, start, n_tokens, ids_crc32; one row per row of ``docs``.

    Null and empty texts have their end id alone; null doc ids come first, equal ones are ordered by their texts' hash.
    """
    return token_codes.token_output(docs, spark)
