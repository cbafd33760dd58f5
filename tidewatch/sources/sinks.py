"""Writes as functions from a table and its changes to the new table; Parquet has no update in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text


def insert_absent(table: DataFrame, rows: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """Rows whose key the table lacks, each key once: what is to be appended."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), order or keys[0]).alias("r")).select(*keys, "r.*") if len(rows.columns) > len(keys) else rows.distinct()
    return first.select(*rows.columns).join(table.select(*keys), list(keys), "left_anti").select(*rows.columns)


def upsert_iocs(iocs: DataFrame, rows: DataFrame) -> DataFrame:
    """iocs (value, ioc_type, comment) with rows (value, ioc_type, ord): the last type given for a value stands, comments stay."""
    last = rows.groupBy("value").agg(F.max_by("ioc_type", "ord").alias("new_type"))
    return iocs.join(last, "value", "full_outer").select("value", F.coalesce("new_type", "ioc_type").alias("ioc_type"), "comment")


def replace_sets(links: DataFrame, rows: DataFrame, owner: str) -> DataFrame:
    """links with the whole sets of the owners in rows replaced."""
    return links.join(rows.select(owner).distinct(), owner, "left_anti").unionByName(rows.distinct())


def find_or_create(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """names (id, name) with the wanted names it lacks, case ignored; new ids are digests, so parallel writers agree."""
    new = wanted.select(F.trim("name").alias("name"), "ord").where("name <> ''").groupBy(F.lower("name").alias("k")).agg(F.min_by("name", "ord").alias("name"))
    new = new.join(names.select(F.lower("name").alias("k")), "k", "left_anti")
    return names.unionByName(new.select(F.sha2("k", 256).alias("id"), "name"))


def unlink(links: DataFrame, iocs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links without gone (item_id, ioc_id), and iocs without those that no report links any more because of it."""
    left = links.join(gone.select("item_id", "ioc_id").distinct(), ["item_id", "ioc_id"], "left_anti")
    orphans = gone.select("ioc_id").distinct().join(left.select("ioc_id"), "ioc_id", "left_anti")
    return left, iocs.join(orphans, "ioc_id", "left_anti")


def delete(items: DataFrame, tombstones: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items without gone (raw_hash), and tombstones with them, so that they are never taken in again."""
    g = gone.select("raw_hash").distinct()
    return items.join(g, "raw_hash", "left_anti"), tombstones.select("raw_hash").unionByName(g).distinct()


def allowed_from_flags(flags: DataFrame) -> DataFrame:
    """value, ioc_type, note of the list's new rows from accepted flags (value, ioc_type, category), each once: domains and addresses only,
    as a hash is of one artefact and a URL would be listed by its host."""
    f = flags.where(F.col("ioc_type").isin("domain", "ip")).select(F.when(F.col("ioc_type") == "domain", F.lower(F.trim("value"))).otherwise(F.trim("value")).alias("value"), "ioc_type", "category")
    return f.where("value <> ''").groupBy("value", "ioc_type").agg(F.min(F.concat(F.lit("review: "), "category")).alias("note"))


def removed(flags: DataFrame, iocs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted flags (ioc_id, value, ioc_type, category) carried out: new rows of the list, and iocs and links without the flagged ones."""
    gone = flags.select("ioc_id").where("ioc_id is not null").distinct()
    return allowed_from_flags(flags), iocs.join(gone, "ioc_id", "left_anti"), links.join(gone, "ioc_id", "left_anti")


def unified(*tables: DataFrame, key: str = "raw_hash") -> DataFrame:
    """Tables of equal columns in one; of rows with the same key the first table's stays, and its least by the other columns."""
    rest = [c for c in tables[0].columns if c != key]
    both = tables[0].withColumn("_t", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        both = both.unionByName(t.withColumn("_t", F.lit(i)))
    return both.groupBy(key).agg(F.min(F.struct("_t", *rest)).alias("r")).select(key, *(f"r.{c}" for c in rest))


def run_opened(log: DataFrame, run_id: str, at: Column) -> DataFrame:
    """The run log (run_id, status, started_at, finished_at, items_added, log) with one more run under way."""
    none = lambda kind: F.lit(None).cast(kind)
    new = log.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit("running").alias("status"), at.alias("started_at"), none("timestamp").alias("finished_at"), none("long").alias("items_added"), none("string").alias("log"))
    return log.unionByName(new)


def run_closed(log: DataFrame, run_id: str, at: Column, status: str, items_added: int, summary: dict) -> DataFrame:
    """The run log with a run ended: its status, number of items and counters as JSON; errors are cut at 50."""
    import json

    body = {k: v[:50] if k == "errors" else v for k, v in summary.items()}
    own = F.col("run_id") == run_id
    set_ = lambda c, v: F.when(own, v).otherwise(F.col(c))
    return log.withColumns({"status": set_("status", F.lit(status)), "finished_at": set_("finished_at", at), "items_added": set_("items_added", F.lit(items_added).cast("long")), "log": set_("log", F.lit(json.dumps(body)))})


def sanitised(items: DataFrame) -> DataFrame:
    """Items whose title or description is not plain ASCII or whose key is not that of title and url: only these, as they should be."""
    title = text.to_ascii(F.col("title"))
    description = F.when(F.coalesce(F.col("description"), F.lit("")) == "", F.col("description")).otherwise(text.to_ascii(F.col("description")))
    new = items.withColumns({"_t": title, "_d": description}).withColumn("_h", text.item_hash(F.col("_t"), F.col("url")))
    changed = ~(F.col("_t").eqNullSafe(F.col("title")) & F.col("_d").eqNullSafe(F.col("description")) & F.col("_h").eqNullSafe(F.col("raw_hash")))
    return new.where(changed).withColumns({"title": F.col("_t"), "description": F.col("_d"), "raw_hash": F.col("_h")}).drop("_t", "_d", "_h")


def bump(sources: DataFrame, stats: Column) -> DataFrame:
    """sources (source_id, posts_kept, posts_dropped) plus the counters of a JSON array of {source_id, kept, dropped}."""
    rows = sources.sparkSession.range(1).select(F.inline(F.from_json(stats, "array<struct<source_id:bigint,kept:bigint,dropped:bigint>>")))
    add = rows.groupBy("source_id").agg(F.sum("kept").alias("k"), F.sum("dropped").alias("d"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sources.join(add, "source_id", "left").select("source_id", (F.col("posts_kept") + zero("k")).alias("posts_kept"), (F.col("posts_dropped") + zero("d")).alias("posts_dropped"))


def desired(rows: DataFrame, wanted: DataFrame, on: bool, *keys: str) -> DataFrame:
    """Per-user marks set or unset; doing it again changes nothing."""
    rest = rows.join(wanted.select(*keys).distinct(), list(keys), "left_anti")
    return rest.unionByName(wanted.select(*rows.columns).distinct()) if on else rest


def sources_checked(rows: DataFrame) -> DataFrame:
    """rows with problem (null if valid); sources other than feeds lose their feed_url."""
    ok = {"category": ("vendor", "news", "government", "research"), "feed_type": ("rss", "manual", "scraper")}
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    problem = F.when(blank("name"), "name").when(~F.coalesce(F.col("category").isin(*ok["category"]), F.lit(False)), "category").when(~F.coalesce(F.col("feed_type").isin(*ok["feed_type"]), F.lit(False)), "feed_type").when((F.col("feed_type") == "rss") & blank("feed_url"), "feed_url")
    return rows.withColumn("feed_url", F.when(F.col("feed_type") == "rss", F.trim("feed_url"))).withColumn("problem", problem)


def merge_names(links: DataFrame, old: list[str], new: str) -> DataFrame:
    """links (item_id, name) with old names (case ignored) replaced by new, each pair once."""
    return links.withColumn("name", F.when(F.upper(F.trim("name")).isin(*(o.upper() for o in old)), new).otherwise(F.col("name"))).distinct()


def dedup(candidates: DataFrame, known: DataFrame, deleted: DataFrame) -> DataFrame:
    """candidates (with raw_hash and ord) not seen before: the first of each key in the batch, none that is known or deleted."""
    # combined before the shuffle, so that a key with very many candidates is one row for each task
    rest = [c for c in candidates.columns if c != "raw_hash"]
    first = candidates.groupBy("raw_hash").agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*(F.col("raw_hash") if c == "raw_hash" else F.col(f"r.{c}") for c in candidates.columns))
    seen = known.select("raw_hash").unionByName(deleted.select("raw_hash"))
    return first.join(seen, "raw_hash", "left_anti")
