"""Subscriptions: which reports match, what is queued, and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("label", "adversary", "country")


def _norm(c: str):
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def values(reports: DataFrame) -> DataFrame:
    """id, kind, key, value, pos: every name a report can be matched by, a label also by each branch above it.

    Exploding a label into its branches turns "equal or below" into an equi-join, whatever the number of subscriptions.
    """
    none = F.array().cast("array<string>")
    label = reports.select("id", F.posexplode(F.coalesce("labels", none)).alias("pos", "value")).withColumn("kind", F.lit("label"))
    parts = F.split(F.lower(F.trim("value")), "/")
    branches = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    label = label.select("id", "kind", "value", "pos", F.explode(F.array_distinct(branches)).alias("key"))
    actor = reports.select("id", F.posexplode(F.coalesce("adversaries", none)).alias("pos", "value")).select("id", F.lit("adversary").alias("kind"), "value", "pos", _norm("value").alias("key"))
    country = reports.select("id", F.lit("country").alias("kind"), F.col("country").alias("value"), F.lit(0).alias("pos"), _norm("country").alias("key"))
    return label.unionByName(actor).unionByName(country).where("key <> ''")


def matches(reports: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """subscription_id, user_id, id, kind, matched: at most one row per subscription and report, its first value in order."""
    s = subscriptions.select(F.col("id").alias("subscription_id"), "user_id", F.col("kind").alias("k"), _norm("value").alias("want")).where("want <> ''")
    hit = values(reports).join(s, (F.col("kind") == F.col("k")) & (F.col("key") == F.col("want")))
    return hit.groupBy("subscription_id", "user_id", "id", "kind").agg(F.min_by("value", "pos").alias("matched"))


def queue(found: DataFrame, queued: DataFrame) -> DataFrame:
    """New rows user_id, id, kind, reason: one per user, report, kind and reason (case ignored), none that is queued already."""
    key = ["user_id", "id", "kind", "reason_key"]
    fresh = found.withColumn("reason_key", F.lower("reason")).groupBy(*key).agg(F.min("reason").alias("reason"))
    old = queued.select("user_id", "id", "kind", F.lower("reason").alias("reason_key")).distinct()
    return fresh.join(old, key, "left_anti").select("user_id", "id", "kind", "reason")


def bell(found: DataFrame) -> DataFrame:
    """One row per user and report, whatever the number of reasons."""
    return found.select("user_id", "id").distinct()


def digest_groups(entries: DataFrame) -> DataFrame:
    """kind, value, n and place of each heading of a user's digest, and reports, the number of different reports in it."""
    g = entries.groupBy("user_id", "reason_kind", F.lower("reason_value").alias("k")).agg(F.min_by("reason_value", "ord").alias("value"), F.count("*").alias("n"))
    subject = entries.groupBy("user_id").agg(F.count_distinct("title", F.coalesce("url", F.lit(""))).alias("reports"))
    order = Window.partitionBy("user_id").orderBy(F.array_position(F.array(*map(F.lit, KINDS)), F.col("reason_kind")), "value")
    return g.join(subject, "user_id").select("user_id", F.col("reason_kind").alias("kind"), "value", "n", "reports", F.row_number().over(order).alias("place"))


def subject(reports) -> "F.Column":
    return F.when(reports == 1, F.lit("1 new report matching your subscriptions")).otherwise(F.concat(reports.cast("string"), F.lit(" new reports matching your subscriptions")))


def pending(queued: DataFrame, most: int = 2000) -> DataFrame:
    """The oldest unsent entries; `most` is the size of a run, later runs send the rest."""
    return queued.where("sent_at is null").orderBy("created_at", "id").limit(most)


# Headings and notes of a digest.
HEADINGS = {"label": "Label", "adversary": "Adversary", "country": "Country"}
NOTES = {"ingest": "", "labels": " (relabelled)", "attribution": " (re-attributed)"}


def digests(entries: DataFrame, app_url: str) -> DataFrame:
    """user_id, subject, text for each user, from entries (user_id, ord, reason_kind, reason_value, trigger, title, url, source_name,
    published_at, item_url): under a heading for each reason its reports in order, then the footer."""
    mapped = lambda c, of: F.coalesce(*(F.when(F.col(c) == k, v) for k, v in of.items()))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    about = F.concat_ws(", ", some("source_name"), F.col("published_at").cast("date").cast("string"))
    line = F.concat(F.lit("  - "), "title", mapped("trigger", NOTES), F.when(about != "", F.concat(F.lit(" ["), about, F.lit("]"))).otherwise(""))
    link = F.coalesce("item_url", some("url"))
    block = F.concat(line, F.when(link.isNotNull(), F.concat(F.lit("\n    "), link)).otherwise(""))
    lines = entries.groupBy("user_id", "reason_kind", F.lower("reason_value").alias("k")).agg(F.sort_array(F.collect_list(F.struct("ord", block.alias("line")))).alias("lines"))
    g = digest_groups(entries).withColumn("k", F.lower("value")).join(lines.withColumnRenamed("reason_kind", "kind"), ["user_id", "kind", "k"])
    heading = F.concat(mapped("kind", HEADINGS), F.lit(": "), "value", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    part = F.concat_ws("\n", heading, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit(""))
    by_user = g.groupBy("user_id").agg(F.max("reports").alias("reports"), F.sort_array(F.collect_list(F.struct("place", part.alias("part")))).alias("parts"))
    body = F.concat_ws("\n", subject(F.col("reports")), F.lit(""), F.array_join(F.transform("parts", lambda p: p["part"]), "\n"), F.lit(f"Manage these subscriptions at {app_url}/settings"))
    return by_user.select("user_id", subject(F.col("reports")).alias("subject"), body.alias("text"))


def marked(queued: DataFrame, sent: DataFrame, at) -> DataFrame:
    """queued with sent_at, and a note, for the entries of sent (id, note); others stay for the next run."""
    j = queued.join(sent.select("id", F.col("note").alias("_note"), F.lit(True).alias("_sent")), "id", "left")
    return j.withColumns({"sent_at": F.when(F.col("_sent"), at).otherwise(F.col("sent_at")), "last_error": F.when(F.col("_sent"), F.col("_note")).otherwise(F.col("last_error"))}).drop("_sent", "_note")


#: Users that a broadcast goes to at most: the accounts of one deployment.
MOST_USERS = 100_000


def broadcast_rows(items: DataFrame, users: DataFrame, existing: DataFrame) -> DataFrame:
    """user_id, dedupe_key, id: every item for every user, less what exists.

    The result has a row for each user and item, as it must. Users are the accounts of a deployment: their number is checked, and they
    travel as one array beside each item, so that no two tables are joined.
    """
    ids = users.select("user_id").distinct()
    if ids.limit(MOST_USERS + 1).count() > MOST_USERS:
        raise ValueError(f"over {MOST_USERS} users: give each a subscription instead")
    everyone = ids.agg(F.collect_list("user_id").alias("u")).scalar()
    every = items.select("id").distinct().select("id", F.explode(everyone).alias("user_id")).withColumn("dedupe_key", F.concat(F.lit("poc:"), F.col("id").cast("string")))
    return every.join(existing.select("user_id", "dedupe_key"), ["user_id", "dedupe_key"], "left_anti")


# What a run tells of, as (title, body, where it leads); # stands for a number with its noun.
RUN_MESSAGES = {
    "feed_ingested": ("Feed updated", "#", "/"),
    "feeds_ingested": ("All feeds ingested", "#", "/"),
    "summary_updated": ("Executive summary updated", "The dashboard summary has been regenerated.", "/"),
    "suspect_iocs": ("# to review", "The daily check found indicators that may not be real.", "/settings?tab=review"),
    "unclassified_reports": ("# stored unclassified", "The triage call did not answer, so these came in with no labels, adversary or nexus. Open one and use AI Magic to read it properly.", "/settings?tab=unclassified"),
    "ingest_errors": ("Ingest finished with #", "", "/settings?tab=sources"),
    "stale_feeds": ("# look stale", "No items in the last {days} days, or failing to fetch.", "/settings?tab=sources"),
}


def run_messages(runs: DataFrame, stale_days: int = 30) -> DataFrame:
    """run_id, kind, title, body, href, dedupe_key: one to six rows for each run, by its counters (null counts as 0).

    runs: run_id, scoped, summarised, added, flagged_iocs, unclassified, stale_feeds and errors, an array, whose first is the body of its message,
    cut at 160 characters.
    """
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    counted = lambda number, noun: F.concat(number.cast("string"), F.lit(f" {noun}"), F.when(number == 1, "").otherwise("s"))
    failed = F.greatest(F.coalesce(F.size("errors"), F.lit(0)), F.lit(0))
    added = F.when(n("added") > 0, F.concat(counted(n("added"), "new report"), F.lit(" added"))).otherwise("No new reports")

    def row(kind: str, number: Column | None = None, body: Column | None = None) -> Column:
        title, text, href = RUN_MESSAGES[kind]
        said = F.lit(title) if number is None else F.replace(F.lit(title), F.lit("#"), number)
        return F.struct(F.lit(kind).alias("kind"), said.alias("title"), (F.lit(text.format(days=stale_days)) if body is None else body).alias("body"), F.lit(href).alias("href"))

    made = [
        F.when(F.col("scoped"), row("feed_ingested", body=added)).otherwise(row("feeds_ingested", body=added)),
        F.when(F.col("summarised"), row("summary_updated")),
        F.when(n("flagged_iocs") > 0, row("suspect_iocs", counted(n("flagged_iocs"), "suspect indicator"))),
        F.when(n("unclassified") > 0, row("unclassified_reports", counted(n("unclassified"), "report"))),
        F.when(failed > 0, row("ingest_errors", counted(failed, "error"), F.substring(F.get("errors", F.lit(0)), 1, 160))),
        F.when(n("stale_feeds") > 0, row("stale_feeds", counted(n("stale_feeds"), "feed"))),
    ]
    out = runs.select("run_id", F.inline(F.array_compact(F.array(*made))))
    return out.withColumn("dedupe_key", F.concat_ws(":", "kind", F.col("run_id").cast("string")))


def feed(reports: DataFrame, subscriptions: DataFrame, newest: int = 4000, each: int = 100) -> DataFrame:
    """The newest reports that match any subscription, at most `each` per section."""
    order = [F.col("published_at").desc_nulls_last(), F.col("id")]
    recent = reports.orderBy(*order).limit(newest)
    hit = recent.join(matches(recent, subscriptions).select("id").distinct(), "id", "left_semi")
    section = F.when(F.col("kind").isin("research", "other"), "reports").when(F.col("kind") == "breach", "breaches").otherwise("exploits")
    return hit.withColumn("section", section).withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*order))).where(F.col("place") <= each)


def options(reports: DataFrame, labels: DataFrame) -> DataFrame:
    """kind, value of everything one can subscribe to."""
    one = lambda kind, c: reports.select(F.lit(kind).alias("kind"), F.trim(c).alias("value"))
    every = one("adversary", "crowdstrike_adversary").unionByName(one("adversary", "adversary_label")).unionByName(one("country", "country")).unionByName(labels.select(F.lit("label").alias("kind"), F.trim("name").alias("value")))
    return every.where("value <> ''").distinct()
