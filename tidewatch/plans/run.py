"""One ingest run over stored tables, which can be repeated after any of its steps.

A run has a number. Everything it writes is put under that number or under keys, so that a second time replaces the first: reports, drops
and links are upserts by key, the index forgets nothing and does not count the run's own keys as known, counters of a source are kept by run
until a later run folds them into its sum, the newest date of a source only moves forward, and the log has one row a run. So a run that
stops after any step, or that is started again when it is done, leaves all tables as one that went through.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.plans import ingest
from tidewatch.sources.stores import KeyedTable, KeyIndex, delete_reports, remove, written

REPORT = (
    "raw_hash string, ord long, title string, url string, description string, category string, source_name string, published_at date, kind string, cve_id string, exploit_status string, "
    "motivation string, country string, nexus string, crowdstrike_adversary string, adversary_label string, item_type string, classified_by string, run long"
)
DROP = "raw_hash string, title string, source_name string, reason string, classified_by string, run long"
LINK = "raw_hash string, ioc_type string, value string"
SOURCE = "source_name string, run long, kept long, dropped long, last_item_at date, last_error string"
LOG = "run long, status string, started_at timestamp, finished_at timestamp, items_added long, log string"
STEPS = ("opened", "reports", "dropped", "links", "index", "sources", "closed")


class Store:
    """The tables of a deployment under one path, in storage that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, **index: int):
        self.spark, self.path = spark, path
        self.reports = KeyedTable(spark, f"{path}/reports", REPORT, "raw_hash", buckets=buckets)
        self.links = KeyedTable(spark, f"{path}/links", LINK, "raw_hash", buckets=buckets)
        self.dropped = KeyedTable(spark, f"{path}/dropped", DROP, "raw_hash", buckets=buckets)
        self.sources = KeyedTable(spark, f"{path}/sources", SOURCE, "source_name", buckets=min(buckets, 8))
        self.log = KeyedTable(spark, f"{path}/log", LOG, "run", buckets=1)
        self.index = KeyIndex(spark, f"{path}/index", **index)

    def totals(self) -> DataFrame:
        """source_name, kept, dropped, last_item_at and last_error (of the last run that pulled it)."""
        return totals(self.sources.read())

    def delete(self, gone: DataFrame, name: str) -> None:
        """Takes reports (raw_hash) and their links out for good."""
        work = f"{self.path}/work/deleted-{name}"
        gone = written(gone.select("raw_hash").distinct(), work)  # written, as it may be read from a table that changes
        delete_reports(self.reports, self.index, gone, f"deleted-{name}")
        self.links.delete(gone)
        remove(self.spark, work)


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_name").agg(F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"), F.max("last_item_at").alias("last_item_at"), F.max_by("last_error", "run").alias("last_error"))


def counted(old: DataFrame, new: DataFrame, run: int) -> DataFrame:
    """Rows of SOURCE with a run's own; those of earlier runs, which are not repeated any more, become one row a source."""
    earlier = old.where(F.col("run") < run)
    base = totals(earlier).join(earlier.groupBy("source_name").agg(F.max("run").alias("run")), "source_name")
    columns = ["source_name", "run", "kept", "dropped", "last_item_at", "last_error"]
    return base.select(*columns).unionByName(old.where(F.col("run") > run).select(*columns)).unionByName(new.select(*columns))


def run(store: Store, number: int, candidates: DataFrame, groups: Column, health: DataFrame | None = None, at: Column | None = None, verdicts: DataFrame | None = None, after: Callable[[str], None] = lambda step: None) -> dict:
    """A run over candidates (ord, title, url, description, category, source_name, published_at), and the feeds' health (source_name, error).

    Runs are numbered upwards, and only the last one may be repeated. `after` is called behind each of STEPS. Returns the summary that is logged.
    """
    spark, load = store.spark, f"run-{number}"
    at = F.current_timestamp() if at is None else at
    none = F.lit(None)
    log = lambda status, finished, added, body: spark.range(1).select(F.lit(number).cast("long").alias("run"), F.lit(status).alias("status"), at.alias("started_at"), finished.cast("timestamp").alias("finished_at"), added.cast("long").alias("items_added"), body.cast("string").alias("log"))
    store.log.upsert(log("running", none, none, none))
    after("opened")

    work = f"{store.path}/work/{load}"
    hashes = candidates.select(text.item_hash(F.col("title"), F.col("url")).alias("raw_hash"))
    known = written(store.index.known(hashes, but=load), f"{work}/known")  # written, as the index is changed below
    out = ingest.run(candidates, known, known.limit(0), groups, verdicts, held=lambda df: written(df, f"{work}/enriched"))
    numbered = lambda df: df.withColumn("run", F.lit(number).cast("long"))
    reports, links = written(numbered(out["reports"]).select(*store.reports.columns), f"{work}/reports"), written(out["links"].select(*store.links.columns), f"{work}/links")
    store.reports.upsert(reports)
    after("reports")
    store.dropped.upsert(numbered(out["dropped"]).select(*store.dropped.columns))
    after("dropped")
    store.links.replace(links, owners=reports)
    after("links")
    store.index.add(reports, load)
    store.index.fold(but=load)
    after("index")

    pulled = candidates.groupBy("source_name").agg(F.max("published_at").alias("last_item_at"))
    errors = (health if health is not None else candidates.select("source_name", none.cast("string").alias("error")).limit(0)).groupBy("source_name").agg(F.max("error").alias("last_error"))
    own = pulled.join(errors, "source_name", "full_outer").join(out["tally"], "source_name", "left").withColumn("run", F.lit(number).cast("long"))
    own = own.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("kept", "dropped")}).where("source_name is not null")
    store.sources.change(own, lambda old, new: counted(old, new, number))
    after("sources")

    rows = store.sources.read().where(F.col("run") == number)
    kept, dropped, failed = rows.agg(F.coalesce(F.sum("kept"), F.lit(0)), F.coalesce(F.sum("dropped"), F.lit(0)), F.array_sort(F.collect_list(F.when(F.col("last_error").isNotNull(), F.concat_ws(": ", "source_name", "last_error"))))).first()
    summary = {"kept": kept, "dropped": dropped, "errors": failed[:50]}
    store.log.upsert(log("success", at, F.lit(kept), F.lit(json.dumps(summary))))
    after("closed")
    remove(spark, work)
    return summary

