"""Stages of the pipeline: each takes (spark, docs, sf_dir); all but the last return the columns of documents.

Every stage takes odd rows as its operator does: null and empty texts are neither toxic nor contaminated and have no near-duplicates;
rows that repeat doc_id and text become one in ngram_join and are otherwise kept; ties go to the smallest doc_id; long texts are read
to the end; an empty table stays empty; columns beside doc_id, text and source are carried along, whatever they are called (but a
column called shard or slot gives way to the last stage's own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, mixing, near_join, sharding, toxicity
from tidewatch.llm.shared import column, packed, table


def aside(docs: DataFrame) -> DataFrame:
    """doc_id, text and, as one struct, all other columns of docs, so that none clashes with what an operator makes."""
    return docs.select(packed(docs, "doc_id", "text").alias("own"), "doc_id", "text")


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*(column(c) if c.lower() in ("doc_id", "text") else F.col("own").getField(c).alias(c) for c in docs.columns))


def toxicity_filter(spark, docs, sf_dir):
    """Documents that the grammar finds toxic go."""
    scored = toxicity.score(aside(docs), table(spark, sf_dir, "labels"))
    return restored(scored.where("predicted = 0"), docs)


def near_duplicates(spark, docs, sf_dir):
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    return near_join.one_of_each(docs)


def benchmark_filter(spark, docs, sf_dir):
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    found = decontamination.decontaminate(aside(docs), table(spark, sf_dir, "benchmark"), window=10)
    return restored(found.where("not contaminated"), docs)


def source_mix(spark, docs, sf_dir):
    """Sources come as often as their targets ask for."""
    return mixing.mixed_rows(docs)


def shards(spark, docs, sf_dir):
    """Every row gets a shard and a slot in it."""
    return sharding.assign(docs, shards=40)


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_filter),
    ("mixing", source_mix),
    ("sharding", shards),
]
