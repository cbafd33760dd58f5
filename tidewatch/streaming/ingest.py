"""The same dataflow on a stream of landed candidates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions import text
from tidewatch.plans import ingest
from tidewatch.plans.run import LOG, SOURCE, counted
from tidewatch.sources.stores import KeyedTable, KeyIndex, remove, written


def deduplicated(candidates: DataFrame, delay: str = "7 days") -> DataFrame:
    """Candidates with raw_hash, repeated ones dropped while they are within the watermark; older ones are found in the index."""
    hashed = candidates.withColumn("raw_hash", text.item_hash(F.col("title"), F.col("url")))
    return hashed.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["raw_hash"])


#: Tables of the dataflow that a stream appends to.
TABLES = ("reports", "dropped", "links", "tally")


class State:
    """What a stream keeps under its path beside the tables it appends to: the index of all keys, sums and dates by source, the log."""

    def __init__(self, spark: SparkSession, path: str, writes: bool = True):
        self.index = KeyIndex(spark, f"{path}/index")
        self.sources = KeyedTable(spark, f"{path}/sources", SOURCE, "source_name", buckets=8, writes=writes)
        self.log = KeyedTable(spark, f"{path}/log", LOG, "run", buckets=1, writes=writes)


def delete(spark: SparkSession, path: str, gone: DataFrame, name: str) -> None:
    """Reports (raw_hash) that must never be taken in again; readers leave them out by live()."""
    KeyIndex(spark, f"{path}/index").add(gone, f"deleted-{name}", deleted=True)


def live(spark: SparkSession, path: str) -> DataFrame:
    """The reports that have not been deleted."""
    return spark.read.parquet(f"{path}/reports").join(KeyIndex(spark, f"{path}/index").deleted(), "raw_hash", "left_anti")


def start(candidates: DataFrame, groups: Column, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends reports, drops, links and counters under path, each row with its batch's number, and keeps State.

    Known are the keys of all reports there ever were and of all that have been deleted, from an index that is not read as a whole. What
    a batch writes is put under its number or under keys: a batch that is repeated after a failure replaces what it had written, so that
    nothing is there twice and nothing is counted twice. The log has one row a batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, load = batch.sparkSession, f"batch-{number}"
        batch = batch.persist()
        work = f"{path}/work/{load}"
        try:
            began, newest, rows = batch.agg(F.current_timestamp(), F.max(F.to_date("seen_at")), F.count("*")).first()
            if not rows:
                return
            state = State(spark, path)
            known = written(state.index.known(batch, but=load), f"{work}/known")  # written, as the index is changed below
            numbered = batch.drop("raw_hash").withColumn("ord", F.monotonically_increasing_id())
            out = ingest.run(numbered, known, known.limit(0), groups, held=lambda df: written(df, f"{work}/enriched"))
            for name in TABLES:
                marked = out[name].withColumns({"day": F.lit(newest), "batch": F.lit(number)})
                marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/{name}")
            state.index.add(out["reports"], load)
            state.index.fold(but=load)
            run = F.lit(number).cast("long").alias("run")
            pulled = batch.groupBy("source_name").agg(F.max("published_at").alias("last_item_at")).where("source_name is not null")
            own = pulled.join(out["tally"], "source_name", "left").select("source_name", run, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("kept", "dropped")), "last_item_at", F.lit(None).cast("string").alias("last_error"))
            state.sources.change(own, lambda old, new: counted(old, new, number))
            kept, dropped = out["tally"].agg(F.coalesce(F.sum("kept"), F.lit(0)), F.coalesce(F.sum("dropped"), F.lit(0))).first()
            told = F.lit(json.dumps({"candidates": rows, "kept": kept, "dropped": dropped})).alias("log")
            state.log.upsert(spark.range(1).select(run, F.lit("success").alias("status"), F.lit(began).alias("started_at"), F.current_timestamp().alias("finished_at"), F.lit(kept).cast("long").alias("items_added"), told))
        finally:
            batch.unpersist()
            remove(spark, work)

    writer = deduplicated(candidates).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def hourly_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events per hour and type with a watermark, for dashboards that follow a stream."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
