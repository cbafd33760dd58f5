"""The training-data pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

Odd rows (null ids and texts, repeats, ties, long texts, clashing names, no rows at all) go through as tidewatch.llm.stages states. Every
stage's table stays until the next one is written; then it and all that the stage wrote for itself are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import stages
from tidewatch.llm.shared import held, release, written

#: (name, function of (spark, docs, sf_dir))
STAGES = list(stages.STAGES)

#: The learned grammar and the randomised join have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = held()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, since, keep=1)
    return docs
