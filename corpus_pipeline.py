"""The training-data pipeline: documents go through the stages in turn, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoladder.llm import stages as _stages
from geoladder.llm import _shared

#: (name, function); each function takes (spark, docs, sf_dir) and works on all that the one before it kept.
STAGES = [
    ("quality", _stages.quality_stage),
    ("near_dedup", _stages.near_dedup_stage),
    ("decontaminate", _stages.decontaminate_stage),
    ("mix", _stages.mix_stage),
    ("tokens", _stages.token_stage),
]

#: The classifier and the tokenizer cannot be written in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _shared.written(stage(spark, docs, sf_dir), spark, f"pipeline-{name}")
    return docs
