"""The ingest dataflow: candidates to reports, with outside verdicts as a table, as a batch or in a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import indicators, rules, text
from tidewatch.functions.patterns import has, text_of
from tidewatch.operators import attribution
from tidewatch.sources import sinks


def enriched(candidates: DataFrame, groups: Column, verdicts: DataFrame | None = None, llm_first: bool = False) -> DataFrame:
    """candidates with outcome (keep or drop), reason, item_type, classified_by and the matched group g.

    Rules first: rules keep or drop, and an outside verdict decides where they are unsure. Verdicts first: only what misses a title or
    URL, or is marketing, is dropped before; then the verdict stands, and rules where there is none. Nobody's answer is a keep.
    verdicts: raw_hash, drop (boolean), reason, item_type, adversary, nexus. An actor that a verdict names is looked up in the catalogue:
    a known name or alias becomes the actor's own name and fills an empty nexus, an unknown one stays as it is; bare families and
    placeholders name nobody, so that the text's own match stands.
    """
    c = candidates.withColumn("g", attribution.match(text_of("title", "description"), groups))
    c = c.withColumn("_v", rules.verdict(F.col("title"), F.col("url"), F.col("description"), F.col("category"), F.col("g.nexus"), F.col("g.motivation")))
    if verdicts is not None:
        v = verdicts.select(F.col("raw_hash"), F.struct("drop", "reason", "item_type", "adversary", "nexus").alias("_l"))
        c = c.join(v, "raw_hash", "left")
    else:
        c = c.withColumn("_l", F.lit(None).cast("struct<drop:boolean,reason:string,item_type:string,adversary:string,nexus:string>"))
    rule, said = F.col("_v.verdict"), F.col("_l").isNotNull()
    gate = (F.col("_v.reason") == "missing title or URL") | (F.col("_v.reason") == "marketing / product")
    by_rules = (rule != "unsure") if not llm_first else (F.coalesce(gate, F.lit(False)) | ~said)
    via = F.when(by_rules | ~said, "rules").otherwise("llm")
    outcome = F.when(via == "llm", F.when(F.col("_l.drop"), "drop").otherwise("keep")).otherwise(F.when(rule == "drop", "drop").otherwise("keep"))
    pre = F.when(F.col("_v.reason") == "marketing / product", "marketing / product (pre-gate)").otherwise(F.col("_v.reason")) if llm_first else F.col("_v.reason")
    reason = F.when(outcome == "drop", F.when(via == "llm", F.coalesce(F.nullif("_l.reason", F.lit("")), F.lit("LLM: not intelligence"))).otherwise(pre))
    kind = F.when(via == "llm", F.coalesce("_l.item_type", F.lit("report"))).otherwise(F.coalesce("_v.item_type", F.lit("report")))
    c = c.withColumn("_k", attribution.match(F.coalesce("_l.adversary", F.lit("")), groups))
    none = F.lit(None).cast("string")
    known = F.struct(F.col("_k.alias").alias("alias"), F.coalesce("_l.nexus", "_k.nexus").alias("nexus"), F.col("_k.cs").alias("cs"), F.col("_k.motivation").alias("motivation"))
    unknown = F.struct(none.alias("alias"), F.col("_l.nexus").alias("nexus"), F.col("_l.adversary").alias("cs"), none.alias("motivation"))
    named = (via == "llm") & rules.specific(F.coalesce("_k.cs", "_l.adversary"))
    actor = F.when(named, F.when(F.col("_k").isNotNull(), known).otherwise(unknown)).otherwise(F.col("g"))
    return c.withColumns({"outcome": outcome, "reason": reason, "classified_by": via, "item_type": kind, "g": actor}).drop("_v", "_l", "_k")


def drop_audit(enriched: DataFrame) -> DataFrame:
    """raw_hash, title, source_name, reason and who decided it, for each dropped candidate once."""
    return enriched.where("outcome = 'drop'").select("raw_hash", "title", "source_name", "reason", "classified_by").dropDuplicates(["raw_hash"])


def rows(kept: DataFrame, actors: DataFrame | None = None) -> DataFrame:
    """Report rows of kept candidates: attribution, kind, CVE, exploit status and label."""
    t = text_of("title", "description")
    cve = rules.routing_cve(t)
    by_nexus = F.when(F.col("g.nexus") != "other", "nation_state")
    r = kept.withColumns({"cve_id": cve, "crowdstrike_adversary": F.col("g.cs"), "nexus": F.col("g.nexus"), "motivation": F.coalesce("g.motivation", by_nexus)})
    kind = rules.report_kind(F.col("item_type"), F.col("g").isNotNull(), F.col("cve_id"), t)
    country = None
    for name, nexus in rules.NEXUS_OF.items():
        country = F.when(F.col("nexus") == nexus, name) if country is None else country.when(F.col("nexus") == nexus, name)
    r = r.withColumns({"kind": kind, "country": country, "exploit_status": F.when(kind == "exploit", rules.exploit_status(t, F.col("category")))})
    r = r.withColumn("adversary_label", rules.adversary_label(F.col("crowdstrike_adversary"), F.col("nexus"), t, F.col("country")))
    return r.drop("g")


def promoted(reports: DataFrame, cves: DataFrame) -> DataFrame:
    """reports in which advisories of kind other with a CVE found in their body (id, value) have become exploits."""
    newest = cves.groupBy("id").agg(F.max(F.upper("value")).alias("_cve"))
    j = reports.join(newest, "id", "left")
    up = (F.col("kind") == "other") & has(F.col("title"), rules.ADVISORY) & F.col("_cve").isNotNull()
    return j.withColumns({"kind": F.when(up, "exploit").otherwise(F.col("kind")), "cve_id": F.when(up, F.col("_cve")).otherwise(F.col("cve_id"))}).drop("_cve")


# Fixed value: what tells of a proof of concept when stored reports are graded again.
POC_AGAIN = r"\b(proof.?of.?concept|\bpoc\b|exploit code|proof-of-concept)\b"


def reclassified(reports: DataFrame, groups: Column, cves: DataFrame) -> DataFrame:
    """Stored reports filed again.

    Of those of kind other or breach, unattributed advisories of kind other with a CVE found in their body (id, value) become exploits;
    attributed ones, and those whose title names an actor, become research, the latter with the actor's name, motivation (its own, else
    by nexus), country and label. Then exploits whose target or description tells of a proof of concept are graded poc, never down.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bare = blank("motivation") & blank("crowdstrike_adversary") & (blank("adversary_label") | F.col("adversary_label").rlike(r"(?i)^unid(?![0-9A-Za-z_])"))
    newest = cves.groupBy("id").agg(F.max(F.upper("value")).alias("_cve"))
    r = reports.join(newest, "id", "left").withColumns({"_g": attribution.match(F.col("title"), groups), "_bare": bare})
    open_ = F.col("kind").isin("other", "breach")
    up = (F.col("kind") == "other") & F.col("_bare") & has(F.col("title"), rules.ADVISORY) & F.col("_cve").isNotNull()
    research = open_ & ~up & (~F.col("_bare") | F.col("_g").isNotNull())
    named = research & F.col("_bare")
    country = None
    for name, nexus in rules.NEXUS_OF.items():
        country = F.when(F.col("_g.nexus") == nexus, name) if country is None else country.when(F.col("_g.nexus") == nexus, name)
    by_nexus = F.col("_g.motivation").isNull() & (F.col("_g.nexus") != "other")
    text = text_of("title", "description")
    status = F.when(has(text, POC_AGAIN), "poc").otherwise("confirmed")
    label = rules.adversary_label(F.col("_g.cs"), F.col("_g.nexus"), text, F.lit(None).cast("string"))
    own = lambda test, new, old: F.when(test, new).otherwise(F.col(old))
    r = r.withColumns({
        "cve_id": own(up, F.col("_cve"), "cve_id"), "target": own(up, F.substring("title", 1, 200), "target"), "exploit_status": own(up, status, "exploit_status"),
        "country": own(named & by_nexus, F.coalesce("country", country), "country"), "motivation": own(named, F.coalesce("_g.motivation", F.when(by_nexus, "nation_state"), "motivation"), "motivation"),
        "crowdstrike_adversary": own(named, F.col("_g.cs"), "crowdstrike_adversary"), "adversary_label": own(named, label, "adversary_label"),
        "kind": F.when(up, "exploit").when(research, "research").otherwise(F.col("kind")),
    }).drop("_g", "_cve", "_bare")
    again = (F.col("kind") == "exploit") & (F.col("exploit_status") != "poc") & has(text_of("target", "description"), POC_AGAIN)
    return r.withColumn("exploit_status", F.when(again, "poc").otherwise(F.col("exploit_status")))


def run(candidates: DataFrame, known: DataFrame, deleted: DataFrame, groups: Column, verdicts: DataFrame | None = None, held: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """A whole run: reports to insert, drops to audit, indicators to link, counters per source.

    held may write the enriched candidates, from which all four come, and read them again.
    """
    fresh = candidates.withColumn("raw_hash", text.item_hash(F.col("title"), F.col("url")))
    fresh = sinks.dedup(fresh, known, deleted)
    e = held(enriched(fresh, groups, verdicts))
    kept = e.where("outcome = 'keep'")
    reports = rows(kept)
    i = kept.select("raw_hash", indicators.indicators(text_of("title", "description")).alias("i"))
    of = {"ip": "ips", "domain": "domains", "file_hash": "files", "cve": "cves", "mitre": "mitre"}

    def typed(kind: str, field: str) -> Column:
        return F.transform(F.col(f"i.{field}"), lambda v: F.struct(F.lit(kind).alias("ioc_type"), v.alias("value")))

    pairs = F.flatten(F.array(*(typed(kind, field) for kind, field in of.items())))
    links = i.select("raw_hash", F.inline(pairs))
    tally = e.groupBy("source_name").agg(F.count_if(F.col("outcome") == "keep").alias("kept"), F.count_if(F.col("outcome") == "drop").alias("dropped"))
    return {"reports": reports, "dropped": drop_audit(e), "links": links, "tally": tally}
