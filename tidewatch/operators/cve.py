"""Prioritisation of vulnerabilities from the reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK = {"critical": 1, "high": 2, "medium": 3}


def prioritised(rows: DataFrame) -> DataFrame:
    """One row per CVE id (case and space ignored) with a proof of concept or a confirmation; one aggregation with partial results.

    The newest report represents it (ties by ord, which is input order); a display field that it lacks comes from the newest that has
    it. priority: critical with both kinds of report, high with a proof of concept, medium with a confirmation, else the id is left out.
    """
    key = F.upper(F.trim(F.coalesce("cve_id", F.lit(""))))
    newest = F.struct(F.coalesce(F.col("published_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), -F.col("ord"))
    shown = [F.max_by(c, F.when(F.col(c).isNotNull(), newest)).alias(c) for c in ("adversary_label", "target", "description", "url", "source_name")]
    has = lambda s: F.bool_or(F.coalesce(F.col("exploit_status") == s, F.lit(False)))
    g = rows.withColumn("k", key).where("k <> ''").groupBy("k").agg(
        F.max_by("cve_id", newest).alias("cve_id"), F.max_by("raw_hash", newest).alias("raw_hash"), F.max_by("published_at", newest).alias("added_at"), *shown,
        F.max("created_at").alias("created_at"), F.count("*").alias("report_count"), has("poc").alias("poc"), has("confirmed").alias("confirmed"), has("suspected").alias("suspected"),
    )
    priority = F.when(F.col("poc") & F.col("confirmed"), "critical").when(F.col("poc"), "high").when(F.col("confirmed"), "medium")
    statuses = F.array_compact(F.array(*(F.when(F.col(s), s) for s in ("poc", "confirmed", "suspected"))))
    return g.withColumns({"priority": priority, "statuses": statuses}).where("priority is not null").drop("poc", "confirmed", "suspected", "k")


def order() -> list:
    """Priority, date, time of arrival, then year and number of the id, all newest first."""
    rank = F.when(F.col("priority") == "critical", 1).when(F.col("priority") == "high", 2).otherwise(3)
    part = lambda i: F.expr(f"try_cast(regexp_extract(cve_id, '(?i)CVE-([0-9]+)-([0-9]+)', {i}) as bigint)").desc_nulls_last()
    return [rank, F.col("added_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), part(1), part(2), F.col("cve_id").desc()]
