"""Queries on the ingest dataflow, sinks, and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import html, indicators, rules, text, verdicts
from tidewatch.functions.patterns import text_of
from tidewatch.operators import attribution, notify, search, views
from tidewatch.plans import ingest
from tidewatch.plans.adapters import AS_OF, actors, run, view, with_views
from tidewatch.plans.registry import query
from tidewatch.plans.text_queries import ascii_sql
from tidewatch.plans.report_queries import MARKET, NOTIFIED, TEXT, groups, hit, matched, notifiable
from tidewatch.sources import feeds, pull, sinks

#: A few words of each turn without signs that JSON or SQL would read otherwise.
SAID = "replace(replace(replace(replace(replace(coalesce(substr(text, 1, 30), ''), chr(10), ' '), chr(34), ''), chr(92), ''), chr(123), ''), chr(125), '')"


def squeezed_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def turns(spark, sf):
    return run(spark, sf, f"SELECT conv_id, turn, role, text, {SAID} AS w FROM {{conversations}}")


def spoken(sql: str) -> str:
    """Oracle SQL over the turns."""
    return f"WITH turns AS (SELECT conv_id, turn, role, text, {SAID} AS w FROM conversations) {sql}"


def among(key, *values):
    """The value at key modulo their number."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(key % len(values) == i, v).otherwise(out)
    return out


UNSURE = f"b.id IS NULL AND category = 'news' AND NOT {hit(TEXT, rules.ROUTING_CVE)} AND NOT {hit(TEXT, rules.BREACH)} AND NOT {hit(TEXT, rules.LARGE_SCALE)} AND NOT {hit(TEXT, rules.HACKTIVISM)}"
QUIET = f"coalesce(b.nexus = 'other' AND b.motive <> 'hacktivism' AND NOT {hit(TEXT, rules.LARGE_SCALE)} AND NOT {hit(TEXT, rules.RESEARCH)} AND NOT {hit(TEXT, rules.INCIDENT)}, false)"


def candidates(spark, sf):
    return view(spark, sf, "reports").drop("kind", "motivation", "country", "crowdstrike_adversary", "adversary_label", "cve_id", "exploit_status").withColumn("raw_hash", F.concat(F.lit("r"), F.col("id").cast("string")))


def answers(c):
    """Outside verdicts on every third candidate; every sixth says drop, the others name an alias, a stranger, a bare family or nobody."""
    said = c.where("id % 3 = 0")
    adversary = F.when(F.col("id") % 4 == 1, "apt28").when(F.col("id") % 4 == 3, "Quiet Crew 9").when(F.col("id") % 5 == 0, "Kitten")
    return said.select("raw_hash", (F.col("id") % 6 == 0).alias("drop"), F.when(F.col("id") % 12 == 0, "screened out: dull").alias("reason"), F.lit("report").alias("item_type"), adversary.alias("adversary"), F.when(F.col("id") % 7 == 0, "iran").alias("nexus"))


@query("p1_hybrid_rules_first", matched(f"""SELECT id, via, CASE WHEN via = 'llm' THEN CASE WHEN id % 6 = 0 THEN 'drop' ELSE 'keep' END WHEN m OR quiet THEN 'drop' ELSE 'keep' END AS outcome,
    CASE WHEN via = 'llm' AND id % 12 = 0 THEN 'screened out: dull' WHEN via = 'llm' AND id % 6 = 0 THEN 'LLM: not intelligence' WHEN via = 'rules' AND m THEN 'marketing / product' WHEN via = 'rules' AND quiet THEN 'low-signal crew mention' END AS reason
    FROM (SELECT r.id, {MARKET} AS m, {QUIET} AS quiet, CASE WHEN NOT {MARKET} AND NOT {QUIET} AND {UNSURE} AND r.id % 3 = 0 THEN 'llm' ELSE 'rules' END AS via FROM reports r LEFT JOIN best b ON r.id = b.id)"""))  # fmt: skip
def p1(spark, sf):
    c = candidates(spark, sf)
    return ingest.enriched(c, groups(spark, sf), answers(c)).select("id", F.col("classified_by").alias("via"), "outcome", "reason")


@query("p1_hybrid_llm_first", matched(f"""SELECT id, via, CASE WHEN via = 'llm' THEN CASE WHEN id % 6 = 0 THEN 'drop' ELSE 'keep' END WHEN m OR quiet THEN 'drop' ELSE 'keep' END AS outcome,
    CASE WHEN via = 'llm' AND id % 12 = 0 THEN 'screened out: dull' WHEN via = 'llm' AND id % 6 = 0 THEN 'LLM: not intelligence' WHEN via = 'rules' AND m THEN 'marketing / product (pre-gate)' WHEN via = 'rules' AND quiet THEN 'low-signal crew mention' END AS reason
    FROM (SELECT r.id, {MARKET} AS m, {QUIET} AS quiet, CASE WHEN NOT {MARKET} AND r.id % 3 = 0 THEN 'llm' ELSE 'rules' END AS via FROM reports r LEFT JOIN best b ON r.id = b.id)"""))  # fmt: skip
def p1l(spark, sf):
    c = candidates(spark, sf)
    return ingest.enriched(c, groups(spark, sf), answers(c), llm_first=True).select("id", F.col("classified_by").alias("via"), "outcome", "reason")


@query("p2_canonical_actor", matched(f"""SELECT id, classified_by, CASE WHEN classified_by = 'rules' THEN cs WHEN id % 4 = 1 THEN 'FANCY BEAR' WHEN id % 4 = 3 THEN 'Quiet Crew 9' ELSE cs END AS cs,
    CASE WHEN classified_by = 'rules' THEN nexus WHEN id % 4 = 1 THEN CASE WHEN id % 7 = 0 THEN 'iran' ELSE 'russia' END WHEN id % 4 = 3 THEN CASE WHEN id % 7 = 0 THEN 'iran' END ELSE nexus END AS nexus
    FROM (SELECT r.id, b.cs, b.nexus, CASE WHEN NOT {MARKET} AND r.id % 3 = 0 THEN 'llm' ELSE 'rules' END AS classified_by FROM reports r LEFT JOIN best b ON r.id = b.id)"""))  # fmt: skip
def p2(spark, sf):
    c = candidates(spark, sf)
    return ingest.enriched(c, groups(spark, sf), answers(c), llm_first=True).select("id", "classified_by", "g.cs", "g.nexus")


@query("p3_drop_audit", matched(f"SELECT 'r' || CAST(r.id AS VARCHAR) AS raw_hash, CASE WHEN {MARKET} THEN 'marketing / product' ELSE 'low-signal crew mention' END AS reason, 'rules' AS classified_by FROM reports r LEFT JOIN best b ON r.id = b.id WHERE {MARKET} OR {QUIET}"))
def p3(spark, sf):
    return ingest.drop_audit(ingest.enriched(candidates(spark, sf), groups(spark, sf))).select("raw_hash", "reason", "classified_by")


ITEM_TYPE = f"CASE WHEN {hit(TEXT, rules.ROUTING_CVE)} THEN 'vuln' WHEN b.id IS NOT NULL THEN 'actor_activity' WHEN {hit(TEXT, rules.BREACH)} THEN 'breach' WHEN category = 'news' AND {hit(TEXT, rules.LARGE_SCALE)} THEN 'breaking' ELSE 'report' END"


@query("i1_x12_report_rows", matched(f"""SELECT id, CASE WHEN t = 'vuln' THEN 'exploit' WHEN t = 'breach' THEN 'breach' WHEN cs IS NOT NULL OR hk THEN 'research' ELSE 'other' END AS kind, cs AS crowdstrike_adversary, nullif(cve, '') AS cve_id
    FROM (SELECT r.id, b.cs, {ITEM_TYPE} AS t, {hit(TEXT, rules.HACKTIVISM)} AS hk, upper(regexp_extract({TEXT}, '(?i){rules.ROUTING_CVE}')) AS cve FROM reports r LEFT JOIN best b ON r.id = b.id WHERE NOT {MARKET} AND NOT {QUIET})"""))  # fmt: skip
def i1(spark, sf):
    kept = ingest.enriched(candidates(spark, sf), groups(spark, sf)).where("outcome = 'keep'")
    return ingest.rows(kept).select("id", "kind", "crowdstrike_adversary", "cve_id")


@query("i2_promotion", with_views(f"SELECT id, CASE WHEN kind = 'other' AND {hit('title', rules.ADVISORY)} AND id % 2 = 1 THEN 'exploit' ELSE kind END AS kind FROM reports", "reports"))
def i2(spark, sf):
    r = view(spark, sf, "reports")
    return ingest.promoted(r, r.where("id % 2 = 1").select("id", F.lit("cve-2026-1000").alias("value"))).select("id", "kind")


POC_TOLD = hit("title || ' ' || coalesce(description, '')", ingest.POC_AGAIN)


@query("i3_reclassify", with_views(f"""SELECT id,
    CASE WHEN up THEN 'exploit' WHEN research THEN 'research' ELSE kind END AS kind, CASE WHEN up THEN 'CVE-2026-1000' ELSE cve_id END AS cve_id,
    CASE WHEN research AND bare THEN coalesce(a.motive, motivation) ELSE motivation END AS motivation, CASE WHEN research AND bare THEN a.name ELSE crowdstrike_adversary END AS crowdstrike_adversary,
    CASE WHEN research AND bare THEN a.name ELSE adversary_label END AS adversary_label,
    CASE WHEN up AND {POC_TOLD} THEN 'poc' WHEN up THEN 'confirmed' WHEN kind = 'exploit' AND exploit_status <> 'poc' AND {hit("coalesce(target, '') || ' ' || coalesce(description, '')", ingest.POC_AGAIN)} THEN 'poc' ELSE exploit_status END AS exploit_status
    FROM (SELECT *, kind IN ('other', 'breach') AND NOT up AND (NOT bare OR actor IS NOT NULL) AS research FROM (SELECT *, kind = 'other' AND bare AND {hit('title', rules.ADVISORY)} AND id % 2 = 1 AS up FROM (SELECT *,
        coalesce(motivation, '') = '' AND coalesce(crowdstrike_adversary, '') = '' AND (coalesce(adversary_label, '') = '' OR regexp_matches(adversary_label, '(?i)^unid\\b')) AS bare,
        CASE WHEN regexp_matches(lower(title), '\\bvolt typhoon\\b') THEN 'VANGUARD PANDA' WHEN regexp_matches(lower(title), '\\blockbit\\b') THEN 'BITWISE SPIDER' WHEN regexp_matches(lower(title), '\\bfancy bear\\b') THEN 'FANCY BEAR'
             WHEN regexp_matches(lower(title), '\\bkillnet\\b') THEN 'KillNet' WHEN regexp_matches(lower(title), '\\bdark halo\\b') THEN 'COZY BEAR' END AS actor FROM rows))) r
    LEFT JOIN actors a ON a.name = r.actor""", "reports", "actors").replace(") SELECT id,", "), rows AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN motivation END AS motivation, CASE WHEN id % 3 = 0 THEN crowdstrike_adversary END AS crowdstrike_adversary, CASE WHEN id % 3 <> 1 THEN adversary_label END AS adversary_label, CASE WHEN kind = 'exploit' AND id % 4 = 0 THEN 'PoC for ' || title ELSE target END AS target) FROM reports) SELECT id,"))  # fmt: skip
def i3(spark, sf):
    third = lambda c, test: F.when(test, F.col(c)).alias(c)
    r = view(spark, sf, "reports")
    r = r.withColumns({"motivation": third("motivation", F.col("id") % 3 == 0), "crowdstrike_adversary": third("crowdstrike_adversary", F.col("id") % 3 == 0), "adversary_label": third("adversary_label", F.col("id") % 3 != 1), "target": F.when((F.col("kind") == "exploit") & (F.col("id") % 4 == 0), F.concat(F.lit("PoC for "), "title")).otherwise(F.col("target"))})
    found = ingest.reclassified(r, groups(spark, sf), r.where("id % 2 = 1").select("id", F.lit("cve-2026-1000").alias("value")))
    return found.select("id", "kind", "cve_id", "motivation", "crowdstrike_adversary", "adversary_label", "exploit_status")


@query("i4_rescan_one_actor", with_views(f"SELECT id FROM reports WHERE crowdstrike_adversary IS NULL AND regexp_matches(lower({TEXT}), '(^|[^a-z0-9])(lockbit|lockbit affiliate|bitwise spider)($|[^a-z0-9])')", "reports"))
def i4(spark, sf):
    one = attribution.aliases(actors(spark, sf).where("name = 'BITWISE SPIDER'"))
    return view(spark, sf, "reports").where("crowdstrike_adversary is null").where(attribution.match(text_of("title", "description"), attribution.catalogue(one)).isNotNull()).select("id")


@query("ingest_run", matched(f"SELECT source_name, count(*) FILTER (NOT d) AS kept, count(*) FILTER (d) AS dropped FROM (SELECT r.source_name, {MARKET} OR {QUIET} AS d, row_number() OVER (PARTITION BY lower(r.title), r.url ORDER BY r.id) AS n FROM reports r LEFT JOIN best b ON r.id = b.id) WHERE n = 1 GROUP BY 1"))
def ingest_run(spark, sf):
    c = candidates(spark, sf).withColumn("ord", F.col("id"))
    none = c.select("raw_hash").limit(0)
    return ingest.run(c, none, none, groups(spark, sf))["tally"]


@query("s17_find_or_create", with_views("SELECT lower(name) AS k, name, count(*) OVER () AS n FROM (SELECT DISTINCT name FROM report_labels WHERE id < 2 UNION ALL SELECT upper(min(name)) FROM report_labels WHERE lower(name) NOT IN (SELECT lower(name) FROM report_labels WHERE id < 2) GROUP BY lower(name))", "report_labels"))
def s17(spark, sf):
    lab = view(spark, sf, "report_labels")
    have = lab.where("id < 2").select(F.sha2("name", 256).alias("id"), "name").distinct()
    made = sinks.find_or_create(have, lab.select(F.concat(F.lit(" "), F.upper("name")).alias("name"), F.col("id").alias("ord")))
    return made.select(F.lower("name").alias("k"), "name").crossJoin(made.agg(F.count("*").alias("n")))


@query("s19_tombstones", with_views("SELECT 'tombstone' AS what, raw_hash, count(*) AS n FROM (SELECT raw_hash FROM hidden UNION SELECT raw_hash FROM reports WHERE id % 100 = 1) GROUP BY 2 UNION ALL SELECT 'item', raw_hash, count(*) FROM reports WHERE raw_hash NOT IN (SELECT raw_hash FROM reports WHERE id % 100 = 1) GROUP BY 2", "reports", "hidden"))
def s19(spark, sf):
    r = view(spark, sf, "reports")
    items, stones = sinks.delete(r, view(spark, sf, "hidden"), r.where("id % 100 = 1"))
    both = stones.select(F.lit("tombstone").alias("what"), "raw_hash").unionByName(items.select(F.lit("item").alias("what"), "raw_hash"))
    return both.groupBy("what", "raw_hash").agg(F.count("*").alias("n"))


@query("s22_prune", with_views("SELECT ioc_id FROM iocs WHERE NOT regexp_matches(value, '\\.bad\\.test$')", "iocs"))
def s22(spark, sf):
    allow = spark.range(1).select(F.lit("bad.test").alias("value"), F.lit("domain").alias("ioc_type"))
    return indicators.not_allowed(view(spark, sf, "iocs"), allow).select("ioc_id")


@query("s23_sanitise", f"""WITH items AS (SELECT doc_id, substr(text, 1, 200) AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS description, source AS url FROM documents),
    new AS (SELECT doc_id, {ascii_sql('title')} AS title, CASE WHEN coalesce(description, '') = '' THEN description ELSE {ascii_sql('description')} END AS description, url, title AS t, description AS d FROM items),
    hashed AS (SELECT *, sha256(lower({squeezed_sql('title')}) || '|' || lower({squeezed_sql('url')})) AS raw_hash FROM new)
    SELECT doc_id, title, md5(description) AS description, raw_hash FROM hashed WHERE title IS DISTINCT FROM t OR description IS DISTINCT FROM d OR doc_id % 4 = 0""")  # fmt: skip
def s23(spark, sf):
    d = run(spark, sf, "SELECT doc_id, substr(text, 1, 200) AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS description, source AS url FROM {documents}")
    stored = d.withColumn("raw_hash", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(text.item_hash(text.to_ascii(F.col("title")), F.col("url"))))
    return sinks.sanitised(stored).select("doc_id", "title", F.md5("description").alias("description"), "raw_hash")


@query("s24_marks", with_views("SELECT id, user_id FROM (SELECT id, 1 AS user_id FROM reports WHERE id % 3 = 0 UNION SELECT id, 1 FROM reports WHERE id % 5 = 0)", "reports"))
def s24(spark, sf):
    r = view(spark, sf, "reports").select("id", F.lit(1).alias("user_id"))
    return sinks.desired(r.where("id % 3 = 0"), r.where("id % 5 = 0"), True, "id", "user_id")


@query("s25_sources_checked", with_views("SELECT name, CASE WHEN source_id % 3 = 2 THEN 'category' WHEN source_id % 2 = 0 AND feed_url IS NULL THEN 'feed_url' END AS problem, CASE WHEN source_id % 2 = 0 THEN feed_url END AS feed_url FROM feeds", "feeds"))
def s25(spark, sf):
    f = view(spark, sf, "feeds").withColumns({"category": F.when(F.col("source_id") % 3 == 2, "gossip").otherwise("news"), "feed_type": F.when(F.col("source_id") % 2 == 0, "rss").otherwise("manual")})
    return sinks.sources_checked(f).select("name", "problem", "feed_url")


@query("s13_pdf_detection", """SELECT page_id, said, regexp_matches(split_part(split_part(lower(u), '#', 1), '?', 1), '\\.pdf$') OR regexp_matches(coalesce(said, ''), 'application/(x-)?pdf', 'i') OR substr(h, 1, 5) = '%PDF-' AS pdf
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '/report.PDF' WHEN 1 THEN url || '/a.pdf.html' ELSE url END AS u, CASE WHEN page_id % 7 = 0 THEN '%PDF-1.7' || html ELSE html END AS h FROM pages),
        (VALUES ('text/html'), ('application/pdf; q=1'), ('application/x-pdf'), ('binary; Application/PDF'), ('application/octet-stream'), (NULL)) AS t(said)""")
def s13(spark, sf):
    """Every page with every type that a server may tell of it."""
    n = F.col("page_id")
    url = among(n, F.concat("url", F.lit("/report.PDF")), F.concat("url", F.lit("/a.pdf.html")), F.col("url"), F.col("url"))
    head = F.when(n % 7 == 0, F.concat(F.lit("%PDF-1.7"), "html")).otherwise(F.col("html")).cast("binary")
    types = F.array(*(F.lit(t).cast("string") for t in ("text/html", "application/pdf; q=1", "application/x-pdf", "binary; Application/PDF", "application/octet-stream", None)))
    rows = run(spark, sf, "SELECT page_id, url, html FROM {pages}").select("page_id", url.alias("u"), head.alias("h"), F.explode(types).alias("said"))
    return rows.select("page_id", "said", html.is_pdf(F.col("u"), F.col("said"), F.col("h")).alias("pdf"))


@query("s3_listing_reader", f"""SELECT page_id, CASE WHEN page_id % 5 <> 4 THEN 'cert-eu-blog' END AS reader, CASE WHEN page_id % 5 < 3 THEN CASE WHEN k = 0 THEN 'https://cert.europa.eu' || split_part(p, '?', 1) ELSE url END END AS url,
    CASE WHEN page_id % 5 < 3 THEN {ascii_sql('t')} END AS title, CASE WHEN page_id % 5 < 3 AND k = 0 THEN nullif(substr({ascii_sql('d')}, 1, 500), '') END AS description,
    CASE WHEN page_id % 5 < 3 AND k = 0 THEN TIMESTAMP '2026-04-21 15:50:00' + INTERVAL 1 HOUR * CAST(page_id % 5 AS INT) END AS published_at,
    CASE WHEN page_id % 5 = 4 THEN 'no reader' WHEN page_id % 5 = 3 THEN 'no items' END AS error
    FROM (SELECT page_id, url, '/blog/' || CAST(page_id AS VARCHAR) AS p, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS t, regexp_extract(html, '(?s)<h1>.*?</h1>(.*?)</p>', 1) AS body, replace(regexp_extract(html, '(?s)<h1>.*?</h1>(.*?)</p>', 1), '</p>', '') AS dd, k,
        regexp_replace(regexp_extract(html, '(?s)<h1>.*?</h1>(.*?)</p>', 1), '<[^>]*>', ' ', 'g') AS d FROM pages, (SELECT unnest([0, 1]) AS k)) WHERE page_id % 5 < 3 OR k = 0""")  # fmt: skip
def s3(spark, sf):
    """Listing pages made of each page's own heading and first paragraph: two items, one without date; none; or of another site."""
    n = F.col("page_id")
    title, about = F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.regexp_extract("html", "(?s)<h1>.*?</h1>(.*?)</p>", 1)
    zone = among(n % 5, F.lit("05:50:00 PM CEST"), F.lit("16:50"), F.lit("05:50 PM XYZ"), F.lit(""), F.lit(""))
    first = F.concat(F.lit('<article class="news--articles--item"><time class="news--articles--item--time" datetime="2001-05-15T19:00">Tuesday, April 21, 2026 '), zone, F.lit('</time><h3 class="news--articles--item--title"><a href="/blog/'), n.cast("string"), F.lit('">'), title, F.lit('</a></h3><p class="news--articles--item--description">'), about, F.lit("</p></article>"))
    second = F.concat(F.lit('<article class="news--articles--item"><h3 class="news--articles--item--title"><a href="'), "url", F.lit('">'), title, F.lit("</a></h3></article>"))
    untitled = F.lit('<article class="news--articles--item"><h3 class="news--articles--item--title"><a href="/x"> </a></h3></article>')
    page = F.when(n % 5 == 3, untitled).otherwise(F.concat(first, untitled, second))
    p = run(spark, sf, "SELECT page_id, url, html FROM {pages}").select("page_id", page.alias("html"), F.when(n % 5 == 4, F.col("url")).otherwise(F.lit("https://cert.europa.eu/blog?page=1")).alias("base"))
    listed = feeds.read_listing(p)
    return listed.join(feeds.errors(listed), "page_id", "left")


@query("s5_feed_health", with_views("SELECT coalesce(k.source_name, f.source_name) AS source_name, coalesce(items, 0) AS items, latest_item_at, f.error FROM (SELECT source_name, count(*) AS items, max(published_at) AS latest_item_at FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY published_at DESC NULLS LAST, id) AS n FROM reports) WHERE n <= 40 GROUP BY 1) k FULL JOIN (SELECT name AS source_name, last_error AS error FROM feeds WHERE last_error IS NOT NULL) f ON k.source_name = f.source_name", "reports", "feeds"))
def s5(spark, sf):
    """Sources with items beside those whose pull failed."""
    kept = feeds.newest(view(spark, sf, "reports").withColumn("ord", F.col("id")))
    failed = view(spark, sf, "feeds").where("last_error is not null").select(F.col("name").alias("source_name"), F.col("last_error").alias("error"))
    return feeds.health(kept, failed)


@query("s5_pulls", """WITH p AS (SELECT s_suppkey AS k, 'src' || CAST(s_suppkey AS VARCHAR) AS source_name FROM supplier)
    SELECT source_name, CASE WHEN k % 4 = 0 OR k % 7 = 0 THEN 0 ELSE 1 + k % 3 END AS items, CASE WHEN k % 4 <> 0 AND k % 7 <> 0 THEN TIMESTAMP '2026-07-01 10:00:00' + to_days(CAST(k % 20 AS INT)) + to_hours(CAST(k % 3 AS INT)) END AS latest_item_at, CASE WHEN k % 4 = 0 THEN 'timeout of ' || source_name END AS error FROM p""")
def s5_pulls(spark, sf):
    """Pulled feeds of one to three entries, empty ones and failed ones: one row of health for each, and no failed job."""
    k = F.col("s_suppkey")
    rows = run(spark, sf, "SELECT s_suppkey FROM {supplier}").withColumn("source_name", F.concat(F.lit("src"), k.cast("string")))
    day = F.date_format(F.date_add(F.lit("2026-07-01").cast("date"), (k % 20).cast("int")), "yyyy-MM-dd")
    item = lambda i: F.concat(F.lit("<item><title>n"), i.cast("string"), F.lit("</title><link>https://x.example/"), i.cast("string"), F.lit("</link><isoDate>"), day, F.lit("T1"), i.cast("string"), F.lit(":00:00Z</isoDate></item>"))
    body = F.concat(F.lit("<rss><channel>"), F.when(k % 7 != 0, F.array_join(F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), item), "")).otherwise(""), F.lit("</channel></rss>"))
    pulls = rows.select("source_name", F.lit(None).cast("string").alias("url"), F.when(k % 4 != 0, body).alias("body"), F.when(k % 4 == 0, F.concat(F.lit("timeout of "), "source_name")).alias("error"), F.current_timestamp().alias("pulled_at"))
    return pull.accounts(pulls, ("item",))[2].select("source_name", "items", "latest_item_at", "error")


@query("j14_source_of_url", with_views("SELECT id, CASE WHEN id % 4 = 0 THEN 'alpha' WHEN id % 4 = 2 THEN 'gamma' END AS source FROM reports", "reports"))
def j14(spark, sf):
    known = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(f).alias("feed_url"), F.lit(u).alias("url")) for n, f, u in (("alpha", "https://alpha.example/rss", ""), ("gamma", "", "https://www.gamma.example/"))))))
    return feeds.source_of(view(spark, sf, "reports").select("id", "url"), known).select("id", "source")


@query("j15_collisions", with_views("""SELECT p.name AS proposed, a.name AS existing, min(n) AS shared_name FROM (SELECT DISTINCT name, lower(trim(unnest([name, one, two]))) AS n FROM proposed) p
    JOIN (SELECT name, lower(trim(unnest(string_split(name || '|' || community || '|' || internal, '|')))) AS m FROM actors) a ON n = m WHERE n <> '' GROUP BY 1, 2""", "reports", "actors").replace(") SELECT p.name", "), proposed AS (SELECT DISTINCT source_name || ' crew' AS name, ' ' || upper(coalesce(adversary_label, '')) || ' ' AS one, CASE id % 4 WHEN 0 THEN 'apt28' WHEN 1 THEN 'SideWinder ' WHEN 2 THEN 'lockbit affiliate' ELSE '' END AS two FROM reports) SELECT p.name"))  # fmt: skip
def j15(spark, sf):
    two = among(F.col("id"), F.lit("apt28"), F.lit("SideWinder "), F.lit("lockbit affiliate"), F.lit(""))
    p = view(spark, sf, "reports").select(F.concat("source_name", F.lit(" crew")).alias("name"), F.array(F.concat(F.lit(" "), F.upper(F.coalesce("adversary_label", F.lit(""))), F.lit(" "))).alias("community_identifiers"), F.array(two).alias("internal_alternative_names")).distinct()
    return attribution.collisions(p, actors(spark, sf)).withColumnRenamed("on", "shared_name")


@query("j16_alias_exists", with_views(f"SELECT r.id FROM reports r WHERE EXISTS (SELECT 1 FROM (SELECT lower(unnest(string_split(name || '|' || community, '|'))) AS a FROM actors) x WHERE length(a) >= 4 AND regexp_matches(lower({TEXT}), '(^|[^a-z0-9])' || a || '($|[^a-z0-9])'))", "reports", "actors"))
def j16(spark, sf):
    a = actors(spark, sf).select("ord", "nexus", F.col("name").alias("cs"), F.get("motivation", F.lit(0)).alias("motivation"), F.explode(F.concat(F.array("name"), "community_identifiers")).alias("raw"))
    a = a.select(F.lower("raw").alias("alias"), "nexus", "cs", "motivation", "ord").where("length(alias) >= 4")
    return attribution.match_join(view(spark, sf, "reports"), a, "id", text_of("title", "description")).select("id")


@query("j2_report_indicators", with_views("SELECT item_id, string_agg(value, ',' ORDER BY value) AS ips FROM (SELECT DISTINCT item_id, value FROM links JOIN iocs USING (ioc_id) WHERE ioc_type = 'ip') GROUP BY 1", "links", "iocs"))
def j2(spark, sf):
    j = view(spark, sf, "links").join(view(spark, sf, "iocs"), "ioc_id").where("ioc_type = 'ip'")
    return j.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_set("value")), ",").alias("ips"))


@query("j5_body_fallback", with_views(f"""SELECT r.id, coalesce(max(CASE WHEN stated THEN name END), max(CASE WHEN NOT any_stated AND strong THEN name END)) AS cs FROM (SELECT r.*, x.*, bool_or(stated) OVER (PARTITION BY r.id) AS any_stated,
        row_number() OVER (PARTITION BY r.id ORDER BY CASE WHEN stated THEN 0 WHEN strong THEN 1 ELSE 2 END, length(a) DESC, ord, pos) AS k FROM (SELECT id, title, body, regexp_matches(lower(title), '(^|[^a-z0-9])' || a || '($|[^a-z0-9])') AS stated,
            regexp_matches(lower(body), '(^|[^a-z0-9])' || a || '($|[^a-z0-9])') AND regexp_matches(a, '\\s|[0-9]') AS strong, name, a, ord, pos FROM bodies, names) r, (SELECT 1) x WHERE stated OR strong) r WHERE k = 1 GROUP BY r.id
    UNION ALL SELECT id, NULL FROM bodies WHERE NOT EXISTS (SELECT 1 FROM names WHERE regexp_matches(lower(title), '(^|[^a-z0-9])' || a || '($|[^a-z0-9])') OR regexp_matches(lower(body), '(^|[^a-z0-9])' || a || '($|[^a-z0-9])') AND regexp_matches(a, '\\s|[0-9]'))""", "reports", "actors").replace(") SELECT r.id", "), names AS (SELECT name, ord, generate_subscripts(string_split(name || '|' || community || '|' || internal, '|'), 1) AS pos, lower(trim(unnest(string_split(name || '|' || community || '|' || internal, '|')))) AS a FROM actors), names2 AS (SELECT * FROM names), bodies AS (SELECT id, CASE WHEN id % 2 = 0 THEN title ELSE 'Title without a name' END AS title, coalesce(description, '') || ' ' || CASE id % 5 WHEN 0 THEN 'links to APT28 and more' WHEN 1 THEN 'related: Sofacy, KillNet' WHEN 2 THEN 'by Volt Typhoon' WHEN 3 THEN 'LockBit affiliate, APT28' ELSE '' END AS body FROM reports) SELECT r.id", 1).replace("FROM bodies, names)", "FROM bodies, (SELECT * FROM names WHERE length(a) >= 4 AND a <> 'lead') names)").replace("FROM names WHERE regexp", "FROM (SELECT * FROM names WHERE length(a) >= 4 AND a <> 'lead') names WHERE regexp"))  # fmt: skip
def j5(spark, sf):
    title = F.when(F.col("id") % 2 == 0, F.col("title")).otherwise("Title without a name")
    body = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), among(F.col("id"), F.lit("links to APT28 and more"), F.lit("related: Sofacy, KillNet"), F.lit("by Volt Typhoon"), F.lit("LockBit affiliate, APT28"), F.lit("")))
    return view(spark, sf, "reports").select("id", attribution.match_report(title, F.lit(None).cast("string"), groups(spark, sf), body)["cs"].alias("cs"))


@query("a19_bell_rows", with_views(f"SELECT DISTINCT user_id, id FROM ({NOTIFIED})", "reports", "subscriptions", "report_labels"))
def a19(spark, sf):
    return notify.bell(notify.matches(notifiable(spark, sf), view(spark, sf, "subscriptions")))


@query("n9_dispatch", with_views("""SELECT user_id, CASE WHEN reports = 1 THEN '1 new report matching your subscriptions' ELSE CAST(reports AS VARCHAR) || ' new reports matching your subscriptions' END AS subject, md5(CASE WHEN reports = 1 THEN '1 new report matching your subscriptions' ELSE CAST(reports AS VARCHAR) || ' new reports matching your subscriptions' END || chr(10) || chr(10) || body || chr(10) || chr(10) || 'Manage these subscriptions at https://app.example/settings') AS text, sent
    FROM (SELECT user_id, string_agg(part, chr(10) || chr(10) ORDER BY rank, value) AS body, max(sent) AS sent FROM (SELECT user_id, rank, value, heading || ': ' || value || ' (' || CAST(count(*) AS VARCHAR) || ')' || chr(10) || string_agg('  - ' || title || note || ' [' || source_name || CASE WHEN published_at IS NULL THEN '' ELSE ', ' || CAST(published_at AS VARCHAR) END || ']' || chr(10) || '    ' || url, chr(10) ORDER BY created_at, id) AS part, max(sent) AS sent
        FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS sent, CASE id % 3 WHEN 0 THEN ' (relabelled)' WHEN 1 THEN ' (re-attributed)' ELSE '' END AS note FROM pending) GROUP BY user_id, rank, value, heading) GROUP BY user_id) JOIN (SELECT user_id, count(DISTINCT title || '|' || url) AS reports FROM pending GROUP BY user_id) USING (user_id)""", "reports").replace(") SELECT user_id, CASE", "), pending AS (SELECT id, id % 7 AS user_id, title, url, source_name, published_at, created_at, CASE WHEN id % 2 = 0 THEN coalesce(country, 'Nowhere') ELSE kind END AS value, CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS rank, CASE WHEN id % 2 = 0 THEN 'Country' ELSE 'Label' END AS heading FROM reports WHERE id % 37 <> 5 ORDER BY created_at, id LIMIT 300) SELECT user_id, CASE", 1))  # fmt: skip
def n9(spark, sf):
    """The oldest 300 unsent entries, a digest for each user, and how many entries are marked as sent after it."""
    n = F.col("id")
    q = view(spark, sf, "reports").select("id", (n % 7).alias("user_id"), "title", "url", "source_name", "published_at", "created_at", F.when(n % 37 == 5, F.col("created_at")).alias("sent_at"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("string").alias("item_url"),
        F.when(n % 2 == 0, F.coalesce("country", F.lit("Nowhere"))).otherwise(F.col("kind")).alias("reason_value"), F.when(n % 2 == 0, "country").otherwise("label").alias("reason_kind"), among(n, F.lit("labels"), F.lit("attribution"), F.lit("ingest")).alias("trigger"))
    pending = notify.pending(q, most=300)
    digest = notify.digests(pending.withColumn("ord", F.struct("created_at", "id")), "https://app.example")
    # an entry of an earlier run may have been sent at this very time
    owed = q.withColumn("owed", F.col("sent_at").isNull())
    sent = notify.marked(owed, pending.select("id", F.lit(None).cast("string").alias("note")), F.expr(AS_OF).cast("timestamp")).where("owed and sent_at is not null").groupBy("user_id").agg(F.count("*").alias("sent"))
    return digest.join(sent, "user_id").select("user_id", "subject", F.md5("text").alias("text"), "sent")


@query("n10_run_messages", """WITH k AS (SELECT o_orderkey AS run_id, o_orderkey % 13 AS a, o_orderkey % 4 AS f, o_orderkey % 5 AS e, o_orderkey % 3 AS s, o_orderkey % 2 AS u, o_orderkey % 7 AS st, o_orderpriority AS why FROM orders)
    SELECT run_id, kind, title, body, href, kind || ':' || CAST(run_id AS VARCHAR) AS dedupe_key FROM (
    SELECT run_id, CASE WHEN u = 0 THEN 'feed_ingested' ELSE 'feeds_ingested' END AS kind, CASE WHEN u = 0 THEN 'Feed updated' ELSE 'All feeds ingested' END AS title, CASE WHEN a = 0 THEN 'No new reports' WHEN a = 1 THEN '1 new report added' ELSE CAST(a AS VARCHAR) || ' new reports added' END AS body, '/' AS href FROM k
    UNION ALL SELECT run_id, 'summary_updated', 'Executive summary updated', 'The dashboard summary has been regenerated.', '/' FROM k WHERE s = 0
    UNION ALL SELECT run_id, 'suspect_iocs', CAST(f AS VARCHAR) || ' suspect indicator' || CASE WHEN f = 1 THEN '' ELSE 's' END || ' to review', 'The daily check found indicators that may not be real.', '/settings?tab=review' FROM k WHERE f > 0
    UNION ALL SELECT run_id, 'unclassified_reports', CASE WHEN s = 1 THEN '1 report' ELSE '2 reports' END || ' stored unclassified', 'The triage call did not answer, so these came in with no labels, adversary or nexus. Open one and use AI Magic to read it properly.', '/settings?tab=unclassified' FROM k WHERE s > 0
    UNION ALL SELECT run_id, 'ingest_errors', 'Ingest finished with ' || CAST(e AS VARCHAR) || ' error' || CASE WHEN e = 1 THEN '' ELSE 's' END, substr(repeat(why || ' timed out; ', 1 + a), 1, 160), '/settings?tab=sources' FROM k WHERE e > 0
    UNION ALL SELECT run_id, 'stale_feeds', CAST(st AS VARCHAR) || ' feed' || CASE WHEN st = 1 THEN '' ELSE 's' END || ' look stale', 'No items in the last 30 days, or failing to fetch.', '/settings?tab=sources' FROM k WHERE st > 0)""")  # fmt: skip
def n10(spark, sf):
    k = F.col("o_orderkey")
    why = F.repeat(F.concat("o_orderpriority", F.lit(" timed out; ")), (1 + k % 13).cast("int"))
    errors = F.when(k % 5 > 0, F.transform(F.sequence(F.lit(1).cast("long"), k % 5), lambda i: F.when(i == 1, why).otherwise(F.lit("another"))))
    runs = run(spark, sf, "SELECT o_orderkey, o_orderpriority FROM {orders}").select(k.alias("run_id"), (k % 2 == 0).alias("scoped"), (k % 3 == 0).alias("summarised"), (k % 13).alias("added"), (k % 4).alias("flagged_iocs"), (k % 3).alias("unclassified"), errors.alias("errors"), F.when(k % 7 > 0, k % 7).alias("stale_feeds"))
    return notify.run_messages(runs)


@query("n12_feed", with_views(f"SELECT section, id FROM (SELECT section, id, row_number() OVER (PARTITION BY section ORDER BY published_at DESC NULLS LAST, id) AS p FROM (SELECT *, CASE WHEN kind IN ('research', 'other') THEN 'reports' WHEN kind = 'breach' THEN 'breaches' ELSE 'exploits' END AS section FROM reports ORDER BY published_at DESC NULLS LAST, id LIMIT 4000) WHERE id IN (SELECT id FROM ({NOTIFIED}))) WHERE p <= 100", "reports", "subscriptions", "report_labels"))
def n12(spark, sf):
    r = view(spark, sf, "reports").select("id", "kind", "published_at").join(notifiable(spark, sf).drop("kind", "published_at"), "id")
    return notify.feed(r, view(spark, sf, "subscriptions")).select("section", "id")


@query("a24_unify_tables", with_views("SELECT raw_hash, id, CASE WHEN t = 0 THEN 'research' ELSE 'breach' END AS kind FROM (SELECT raw_hash, id, t, row_number() OVER (PARTITION BY raw_hash ORDER BY t, id) AS n FROM (SELECT raw_hash, id, 0 AS t FROM reports WHERE kind = 'research' UNION ALL SELECT raw_hash, id, 1 FROM reports WHERE kind = 'breach')) WHERE n = 1", "reports"))
def a24(spark, sf):
    r = view(spark, sf, "reports")
    part = lambda kind: r.where(F.col("kind") == kind).select("raw_hash", "id", "kind")
    return sinks.unified(part("research"), part("breach"))


@query("a25_section_totals", with_views("SELECT motivation, count(*) AS total FROM reports WHERE motivation IS NOT NULL GROUP BY 1", "reports"))
def a25(spark, sf):
    return views.section_totals(view(spark, sf, "reports"), "motivation")


@query("a21_memory_brief", "SELECT kind, subject FROM (SELECT kind, subject, row_number() OVER (PARTITION BY kind ORDER BY mentions DESC, last_seen DESC, subject) AS n FROM (SELECT 'label' AS kind, p_brand AS subject, count(*) AS mentions, max(p_partkey) AS last_seen FROM part GROUP BY 2)) WHERE n <= 40 UNION ALL SELECT kind, subject FROM (SELECT kind, subject, row_number() OVER (PARTITION BY kind ORDER BY last_seen DESC, mentions DESC, subject) AS n FROM (SELECT 'trend' AS kind, p_type AS subject, count(*) AS mentions, max(p_partkey) AS last_seen FROM part GROUP BY 2)) WHERE n <= 6")
def a21(spark, sf):
    p = run(spark, sf, "SELECT p_partkey, p_brand, p_type FROM {part}")
    note = lambda kind, c: p.groupBy(F.col(c).alias("subject")).agg(F.count("*").alias("mentions"), F.max("p_partkey").alias("last_seen")).withColumn("kind", F.lit(kind))
    return views.memory_brief(note("label", "p_brand").unionByName(note("trend", "p_type"))).select("kind", "subject")


Q, BS = 'chr(34)', 'chr(92)'


@query("n1_first_object", spoken(f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{{"a": {{"b": "}}{{"}}, "w": "' || w || '", "n": ' || CAST(turn AS VARCHAR) || '}}' WHEN 3 THEN '{{"q": "say ' || {BS} || {Q} || '}}' || {BS} || {Q} || ' ' || w || '"}}' END AS body FROM turns"""))
def n1(spark, sf):
    """Prose around an object with braces in strings and another behind it; no object; one that never closes; escaped quotes."""
    w, n = F.col("w"), F.col("turn")
    object_ = F.concat(F.lit('He said "so": '), w, F.lit(' {"a": {"b": "}{"}, "w": "'), w, F.lit('", "n": '), n.cast("string"), F.lit('} and {"later": 1}'))
    said = F.when(n % 4 == 0, object_).when(n % 4 == 1, F.concat(w, F.lit(" } no object"))).when(n % 4 == 2, F.concat(F.lit('```json {"open": "'), w, F.lit('} never closed'))).otherwise(F.concat(F.lit('x {"q": "say \\"}\\" '), w, F.lit('"} y')))
    return turns(spark, sf).select("conv_id", "turn", verdicts.first_object(said).alias("body"))


CODE = "'T' || CAST(1000 + conv_id % 800 AS VARCHAR)"


@query("n2_techniques", spoken(f"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN {CODE} || '.001:' || CASE WHEN {ascii_sql('w')} = '' THEN {CODE} || '.001' ELSE {ascii_sql('w')} END || ',' || 'T9' || CAST(100 + turn AS VARCHAR) || ':T9' || CAST(100 + turn AS VARCHAR) WHEN 1 THEN {CODE} || ':known' ELSE '' END AS found FROM turns"""))
def n2(spark, sf):
    """Codes in either case, repeated, unnamed, malformed; a list alone; and answers without one."""
    n, w = F.col("turn"), F.col("w")
    code = F.concat(F.lit("t"), (F.col("conv_id") % 800 + 1000).cast("string"))
    many = F.concat(F.lit('Found [{"code": "'), code, F.lit('.001", "name": "'), w, F.lit('"}, {"code": " T9'), (n + 100).cast("string"), F.lit('"}, {"code": "'), F.upper(code), F.lit('.001", "name": "again"}, {"code": "X1", "name": "no"}, {"code": "T12", "name": "short"}] for '), w)
    one = F.concat(F.lit('[{"name": "known", "code": "'), code, F.lit('"}]'))
    said = F.when(n % 3 == 0, many).when(n % 3 == 1, one).otherwise(F.concat(F.lit("none in "), w, F.lit(" [not json")))
    found = F.transform(verdicts.techniques(said), lambda r: F.concat_ws(":", r["code"], r["name"]))
    return turns(spark, sf).select("conv_id", "turn", F.array_join(found, ",").alias("found"))


LABEL = "substr(array_to_string(list_transform(list_filter(regexp_split_to_array({0}, '[^a-zA-Z0-9]+'), lambda p: p <> ''), lambda p: upper(substr(p, 1, 1)) || substr(p, 2)), ''), 1, 48)"


@query("n2_n3_triage", spoken(f"""SELECT conv_id, turn, turn % 4 <> 1 AND turn % 5 <> 4 AS relevant, kind, item_type, confidence, nexus, adversary, labels, CASE WHEN parsed THEN ips END AS ips, CASE WHEN parsed THEN hashes END AS hashes, CASE WHEN parsed THEN techniques END AS techniques, CASE WHEN parsed THEN trim(w) END AS summary, CASE WHEN parsed AND turn % 2 = 0 THEN 'why' END AS reason FROM (SELECT *,
    CASE WHEN parsed THEN CASE WHEN conv_id % 2 = 0 THEN 'breach' ELSE 'other' END END AS kind, CASE WHEN parsed THEN CASE WHEN conv_id % 3 = 0 THEN 'vuln' ELSE 'report' END END AS item_type, CASE WHEN parsed THEN CASE WHEN conv_id % 5 = 0 THEN 'poc' ELSE 'suspected' END END AS confidence,
    CASE WHEN parsed AND conv_id % 7 = 0 THEN 'north_korea' END AS nexus, CASE WHEN parsed AND conv_id % 4 = 0 THEN 'Crew ' || CAST(conv_id AS VARCHAR) END AS adversary,
    CASE WHEN parsed THEN array_to_string(list_filter([CASE WHEN {LABEL.format('w')} <> '' THEN 'Malware/' || {LABEL.format('w')} END, 'Target/F5BIGIP', 'Target/Other' || CAST(turn AS VARCHAR), 'Vector/MailLure'], lambda x: x IS NOT NULL), ',') END AS labels,
    '45.1.2.' || CAST(conv_id % 250 AS VARCHAR) AS ips, CASE WHEN conv_id % 2 = 1 THEN 'abc,def' ELSE '' END AS hashes, 'T10' || CAST(conv_id % 90 + 10 AS VARCHAR) AS techniques FROM (SELECT *, turn % 5 <> 4 AS parsed FROM turns)) WHERE true""").replace("turn % 4 <> 1 AND turn % 5 <> 4 AS relevant", "CASE WHEN turn % 5 <> 4 THEN turn % 4 <> 1 END AS relevant"))  # fmt: skip
def n3(spark, sf):
    """Answers whose fields are allowed, unknown or missing, with keys under several names; every fifth turn's is broken JSON."""
    n, w, c = F.col("turn"), F.col("w"), F.col("conv_id")
    body = F.concat(
        F.lit('```json {"relevant": '), F.when(n % 4 == 1, "false").otherwise("true"), F.lit(', "dashboardKind": "'), F.when(c % 2 == 0, "breach").otherwise("Nonsense"), F.lit('", "itemType": "'), F.when(c % 3 == 0, "vuln").otherwise("x"),
        F.lit('", "confidence": '), F.when(c % 5 == 0, '"poc"').otherwise("3"), F.lit(', "nexus": '), F.when(c % 7 == 0, '"north_korea"').otherwise('"atlantis"'), F.lit(', "crowdstrikeAdversary": "'), F.when(c % 4 == 0, F.concat(F.lit("Crew "), c.cast("string"))).otherwise(""),
        F.lit('", "labels": {"malware": "Malware/ '), w, F.lit('", "targeted_systems": ["F5 BIG-IP", "f5 bIG iP", "other '), n.cast("string"), F.lit('"], "vector": ["mail lure", "Vector/Mail-Lure"]}, "indicators": {"ips": ["45.1.2.'), (c % 250).cast("string"), F.lit('", " "], "hashes": '), F.when(c % 2 == 1, '["abc", "def"]').otherwise('"abc"'),
        F.lit('}, "mitreTechniques": ["t10'), (c % 90 + 10).cast("string"), F.lit('"], "summary": "'), w, F.lit(' ", "reason": "'), F.when(n % 2 == 0, " why ").otherwise("  "), F.lit('"'), F.when(n % 5 == 4, "").otherwise("} ``` done"),
    )
    t = turns(spark, sf).select("conv_id", "turn", verdicts.triage(body).alias("t"))
    comma = lambda a: F.array_join(a, ",")
    return t.select("conv_id", "turn", "t.relevant", "t.kind", "t.item_type", "t.confidence", "t.nexus", "t.adversary", comma(F.col("t.labels")).alias("labels"), comma(F.col("t.indicators.ips")).alias("ips"), comma(F.col("t.indicators.files")).alias("hashes"), comma(F.col("t.techniques")).alias("techniques"), "t.summary", "t.reason")


@query("n4_flags", spoken("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Site' || CAST(conv_id AS VARCHAR) || '.Example|' || CASE WHEN trim(w) = '' THEN 'unclassified' ELSE substr(trim(w || ' ' || role), 1, 40) END || '|Flagged without a stated reason.' WHEN 1 THEN '' ELSE '8.8.4.' || CAST(turn AS VARCHAR) || '|unclassified|' || substr(repeat('long ', 100), 1, 300) END AS flags FROM turns"""))
def n4(spark, sf):
    """Flags that are in the batch (in another case, twice), guarded, invented, blank or over-long; and an answer without any."""
    n, w, site = F.col("turn"), F.col("w"), F.concat(F.lit("Site"), F.col("conv_id").cast("string"), F.lit(".Example"))
    one = F.concat(F.lit('Here {"flagged": [{"value": " '), F.lower(site), F.lit('", "category": "'), F.when(F.trim(w) == "", "").otherwise(F.concat(w, F.lit(" "), "role")), F.lit('", "reason": " "}, {"value": "'), site, F.lit('", "reason": "twice"}, {"value": "x.github.com", "reason": "guarded"}, {"value": "absent.example", "reason": "no"}, {"value": ""}]} ok'))
    two = F.concat(F.lit('{"flagged": [{"value": "8.8.4.'), n.cast("string"), F.lit('", "reason": "'), F.repeat(F.lit("long "), 100), F.lit('"}]}'))
    said = F.when(n % 3 == 0, one).when(n % 3 == 1, F.concat(w, F.lit(" nothing {to flag"))).otherwise(two)
    got = verdicts.flags(said, F.array(site, F.lit("x.github.com"), F.concat(F.lit("8.8.4."), n.cast("string"))), F.array(F.lit("github.com")))
    return turns(spark, sf).select("conv_id", "turn", F.array_join(F.transform(got, lambda f: F.concat_ws("|", f["value"], f["category"], f["reason"])), ",").alias("flags"))


@query("n5_longest_body", "SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n, coalesce(length(text), 0) >= 600 AS ok FROM documents")
def n5(spark, sf):
    d = run(spark, sf, "SELECT doc_id, text FROM {documents}")
    return d.select("doc_id", verdicts.longest_body(F.array(F.substring("text", 1, 10), "text", F.lit(""))).alias("b")).select("doc_id", F.length("b.text").cast("long").alias("n"), "b.ok")


@query("u5_reconcile", with_views("""SELECT id, array_to_string(list_sort(list_filter(['domain:evil' || CAST(id % 50 AS VARCHAR) || '.example', CASE WHEN id % 3 <> 0 THEN 'cve:CVE-2026-' || CAST(1000 + id AS VARCHAR) END, 'ip:45.1.2.' || CAST(id % 250 AS VARCHAR), CASE WHEN id % 2 = 0 THEN 'mitre:T1' || CAST(100 + id % 800 AS VARCHAR) END], lambda x: x IS NOT NULL)), ',') AS found FROM reports""", "reports"))
def u5(spark, sf):
    """Claims in the text in obfuscated form, absent from it, invalid, private or excluded; an address that only the text has; a link's target."""
    pair = lambda k, *v: F.struct(F.lit(k).alias("kind"), F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in v]).alias("value"))
    n = F.col("id").cast("string")
    domain, cve, last, code = F.concat(F.lit("EVIL"), (F.col("id") % 50).cast("string")), (F.col("id") + 1000).cast("string"), (F.col("id") % 250).cast("string"), (F.col("id") % 800 + 100).cast("string")
    claimed = F.array(pair("domain", domain, "[.]example"), pair("domain", "absent", n, ".example"), pair("ip", "999.1.1.1"), pair("ip", "10.0.0.1"), pair("domain", "github.io.twitter.com"), pair("domain", "sharer.php"), pair("cve", "cve-2026-", cve), pair("mitre", "t1", code), pair("uri", "http://x.example"))
    said = F.concat(F.lit("at "), domain, F.lit("(.)example, 10.0.0.1 twitter.com sharer.php http://x.y/ 45.1.2[.]"), last, F.when(F.col("id") % 3 != 0, F.concat(F.lit(" CVE-2026-"), cve)).otherwise(""), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" T1"), code)).otherwise(""), F.lit(" [menu](https://chrome"), n, F.lit(".example/a)"))
    got = indicators.reconcile(claimed, F.replace(said, F.lit(" http://x.y/"), F.lit("")))
    return view(spark, sf, "reports").select("id", F.array_join(F.sort_array(F.transform(got, lambda g: F.concat_ws(":", g["kind"], g["value"]))), ",").alias("found"))


@query("f7_pruned_search", with_views("SELECT id FROM reports WHERE contains(source_name, 'src1')", "reports"))
def f7(spark, sf):
    tree = search.parse("src:src1")
    return search.documents(view(spark, sf, "reports"), search.fields(tree)).where(search.compiled(tree)).select("id")


@query("f14_queues", with_views("""SELECT 'unclassified' AS queue, id FROM (SELECT id FROM reports WHERE id % 3 = 0 ORDER BY created_at DESC, id LIMIT 500) UNION ALL SELECT 'dropped', id FROM (SELECT id FROM reports WHERE created_at >= TIMESTAMP '2024-04-30' - INTERVAL 30 DAY ORDER BY created_at DESC, lpad(CAST(id AS VARCHAR), 9, '0') LIMIT 40)
    UNION ALL SELECT 'dropped of one', id FROM (SELECT id FROM reports WHERE created_at >= TIMESTAMP '2024-04-30' - INTERVAL 30 DAY AND source_name = (SELECT min(source_name) FROM reports) ORDER BY created_at DESC, lpad(CAST(id AS VARCHAR), 9, '0') LIMIT 40) UNION ALL SELECT 'flags', id FROM (SELECT id FROM reports WHERE id % 4 <> 0 ORDER BY id % 90 DESC, id LIMIT 500)""", "reports"))  # fmt: skip
def f14(spark, sf):
    r = view(spark, sf, "reports").withColumn("classified_by", F.when(F.col("id") % 3 == 0, "rules").otherwise("llm"))
    dropped = r.withColumn("raw_hash", F.lpad(F.col("id").cast("string"), 9, "0"))
    now = F.expr(AS_OF).cast("timestamp")
    flags = r.select("id", (F.col("id") % 90).alias("reports"), F.when(F.col("id") % 4 == 0, F.current_timestamp()).alias("resolved_at"))
    one = r.agg(F.min("source_name")).first()[0]
    out = [("unclassified", views.unclassified(r)), ("dropped", views.dropped_list(dropped, now, most=40)), ("dropped of one", views.dropped_list(dropped, now, one, most=40)), ("flags", views.open_flags(flags))]
    queues = [rows.select(F.lit(name).alias("queue"), "id") for name, rows in out]
    return queues[0].unionByName(queues[1]).unionByName(queues[2]).unionByName(queues[3])


@query("f19_actor_filter", with_views("SELECT name FROM actors WHERE motive = 'nation_state' AND (contains(lower(community), 'apt') OR contains(lower(internal), 'apt'))", "actors"))
def f19(spark, sf):
    return views.actors_found(actors(spark, sf), motivation="nation_state", alias=" APT").select("name")


@query("f22_stored_else_extracted", with_views("""SELECT id, CASE WHEN id % 3 = 0 THEN 'stored' || CAST(id AS VARCHAR) || '.example' ELSE 'seen' || CAST(id % 70 AS VARCHAR) || '.example' END AS domains, CASE WHEN id % 3 = 0 THEN '' ELSE '45.9.8.' || CAST(id % 250 AS VARCHAR) END AS ips, CASE WHEN id % 5 = 0 THEN 'T1001' ELSE 'T1' || CAST(100 + id % 800 AS VARCHAR) END AS mitre FROM reports""", "reports"))
def f22(spark, sf):
    """Reports with stored indicators, with techniques alone, with neither; the rest is read from the text, its own site left out."""
    n = F.col("id")
    empty = F.array().cast("array<string>")
    one = lambda test, v: F.when(test, F.array(v)).otherwise(empty)
    stored = F.struct(empty.alias("ips"), one(n % 3 == 0, F.concat(F.lit("stored"), n.cast("string"), F.lit(".example"))).alias("domains"), empty.alias("files"), empty.alias("cves"), one(n % 5 == 0, F.lit("T1001")).alias("mitre"))
    said = F.concat(F.lit("at seen"), (n % 70).cast("string"), F.lit("[.]example from own.site.example, 45.9.8."), (n % 250).cast("string"), F.lit(" by T1"), (n % 800 + 100).cast("string"))
    got = indicators.stored_else_found(stored, indicators.indicators(said, F.array(F.lit("site.example"))))
    return view(spark, sf, "reports").select("id", *(F.array_join(got[k], ",").alias(k) for k in ("domains", "ips", "mitre")))


@query("x32_jitter", "SELECT o_orderkey, CAST(list_reduce(list_prepend(0::UBIGINT, list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda a, c: (a * 31 + c) % 4294967296) % 1000 AS BIGINT) AS h FROM orders")
def x32(spark, sf):
    return run(spark, sf, "SELECT o_orderkey FROM {orders}").select("o_orderkey", F.round((text.jitter(F.col("o_orderkey").cast("string")) / 0.24 + 0.5) * 999).cast("long").alias("h"))


WS = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"


@query("x33_evidence_lines", with_views(f"""SELECT '[' || CAST(row_number() OVER (ORDER BY band, n) AS VARCHAR) || '] window=' || CASE band WHEN 0 THEN 'last24h' WHEN 1 THEN 'days2to7' ELSE 'days8to30' END || '; date=' || CAST(published_at AS VARCHAR) || '; source=' || coalesce(nullif(substr({WS.format('source_name')}, 1, 100), ''), 'unknown') || '; title=' || substr({WS.format('title')}, 1, 240) || '; synopsis=' || coalesce(nullif(substr({WS.format('description')}, 1, 520), ''), 'No synopsis available.') AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY published_at DESC, id) AS n FROM (SELECT *, CASE WHEN published_at >= {AS_OF} - 1 THEN 0 WHEN published_at >= {AS_OF} - 7 THEN 1 ELSE 2 END AS band FROM (SELECT *, row_number() OVER (PARTITION BY raw_hash ORDER BY published_at DESC, id) AS f FROM reports WHERE published_at >= {AS_OF} - 30) WHERE f = 1)) WHERE n <= CASE band WHEN 2 THEN 16 ELSE 18 END""", "reports"))  # fmt: skip
def x33(spark, sf):
    return views.evidence(view(spark, sf, "reports"), F.expr(AS_OF)).select(views.evidence_line().alias("line"))


@query("x20_listing_dates", """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN NULL ELSE CASE WHEN o_orderkey % 8 IN (1, 4) THEN date_trunc('minute', t) ELSE t END - CASE o_orderkey % 8 WHEN 0 THEN INTERVAL 1 HOUR WHEN 1 THEN INTERVAL 2 HOUR WHEN 5 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END END AS t
    FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 1 SECOND * CAST(o_orderkey * 7919 % 86400 AS INT) AS t FROM orders)""")
def x20(spark, sf):
    """Dates at all times of day: two zones, one unknown, none; with and without weekday and seconds; 12 and 24 hours; and no date."""
    k = F.col("o_orderkey")
    t = F.col("o_orderdate").cast("date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * 7919 % 86400).cast("int"))
    said = lambda form, zone: F.concat(F.date_format(t, form), F.lit(zone))
    full = "EEEE, MMMM d, yyyy hh:mm:ss a"
    forms = [said(full, " CET"), said("MMMM dd, yyyy hh:mm a", " CEST"), said(full, " XYZ"), said("MMMM d, yyyy HH:mm:ss", ""), said("EEEE, MMMM d, yyyy H:mm", " utc"), said("MMMM d, yyyy h:mm:ss a", " EEST"), said("MMMM d,  yyyy hh:mm:ssa", ""), F.concat(F.lit("Fooruary "), F.date_format(t, "d, yyyy HH:mm"))]
    return run(spark, sf, "SELECT o_orderkey, o_orderdate FROM {orders}").select("o_orderkey", text.listing_date(among(k, *forms)).alias("t"))


WORDS_ONLY = "trim(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query("x25_plain_markdown", f"SELECT page_id, trim('Page ' || CAST(page_id AS VARCHAR) || ' ' || CASE WHEN page_id % 2 = 0 THEN 'Share ' ELSE '' END || {WORDS_ONLY.format('url')} || ' ' || {WORDS_ONLY.format('html')}) AS plain FROM pages")
def x25(spark, sf):
    """Each page's words as markdown: a heading, an image in a link (alone or beside a word), a link, bold and a list."""
    only = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9 ]", " "), " +", " "))
    linked = F.when(F.col("page_id") % 2 == 0, "[Share ![i](https://a/i.png)](https://a/s)").otherwise("[ ![i](https://a/i.png) ](https://a/s)")
    md = F.concat(F.lit("# Page "), F.col("page_id").cast("string"), F.lit("\n\n"), linked, F.lit("\n\n**["), only(F.col("url")), F.lit("](https://a/x)**\n\n- "), only(F.col("html")))
    return run(spark, sf, "SELECT page_id, url, html FROM {pages}").select("page_id", html.plain(html.unwrap_images(md)).alias("plain"))


@query("x29_techniques", with_views("SELECT ioc_id, CASE WHEN ioc_id % 8 = 3 AND CAST(substr(value, 2) AS INT) % 3 = 0 THEN 'own ' || value WHEN CAST(substr(value, 2) AS INT) % 2 = 0 THEN 'name ' || value END AS name FROM iocs WHERE ioc_type = 'mitre'", "iocs"))
def x29(spark, sf):
    """Sub-techniques with a name of their own, with their parent's, and with none."""
    i = view(spark, sf, "iocs").where("ioc_type = 'mitre'")
    number = F.substring("code", 2, 9).cast("int")
    codes = i.select(F.col("value").alias("code")).distinct()
    named = codes.where(number % 2 == 0).select("code", F.concat(F.lit("name "), "code").alias("name")).unionByName(codes.where(number % 3 == 0).select(F.concat("code", F.lit(".001")).alias("code"), F.concat(F.lit("own "), "code").alias("name")))
    asked = i.select("ioc_id", F.lower(F.concat("value", F.when(F.col("ioc_id") % 8 == 3, ".001").otherwise(".002"))).alias("code"))
    return views.technique_names(asked, named).select("ioc_id", "name")


@query("x36_never_flag", with_views("SELECT ioc_id FROM iocs WHERE ioc_type = 'domain' AND NOT value LIKE '%.evil.example'", "iocs"))
def x36(spark, sf):
    guard = spark.range(1).select(F.lit("evil.example").alias("value"), F.lit("domain").alias("ioc_type"))
    return indicators.not_allowed(view(spark, sf, "iocs").where("ioc_type = 'domain'"), guard).select("ioc_id")


@query("x17_country_nexus", with_views("SELECT DISTINCT country, CASE country WHEN 'China' THEN 'china' WHEN 'Russia' THEN 'russia' WHEN 'Iran' THEN 'iran' WHEN 'North Korea' THEN 'north_korea' ELSE 'rest_of_world' END AS nexus FROM reports", "reports"))
def x17(spark, sf):
    return view(spark, sf, "reports").select("country", rules.nexus_of_country(F.col("country")).alias("nexus")).distinct()


@query("w6_capped_expansion", with_views("SELECT item_id, count(*) AS n FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY ioc_id) AS k FROM links) WHERE k <= 2 GROUP BY 1", "links"))
def w6(spark, sf):
    return views.top_per(view(spark, sf, "links"), "item_id", 2, F.col("ioc_id")).groupBy("item_id").agg(F.count("*").alias("n"))


@query("g4_items_of_entity", with_views("SELECT id FROM reports WHERE (crowdstrike_adversary = 'LockBit' OR adversary_label = 'LockBit') AND raw_hash NOT IN (SELECT raw_hash FROM hidden) ORDER BY published_at DESC NULLS LAST, id LIMIT 40", "reports", "hidden"))
def g4(spark, sf):
    hit_ = F.coalesce(F.col("crowdstrike_adversary") == "LockBit", F.lit(False)) | F.coalesce(F.col("adversary_label") == "LockBit", F.lit(False))
    return views.shown(view(spark, sf, "reports").where(hit_), view(spark, sf, "hidden")).orderBy(*views.newest()).limit(40).select("id")


@query("u1_union_of_kinds", with_views("SELECT id, kind FROM reports WHERE kind IN ('research', 'breach', 'exploit')", "reports"))
def u1(spark, sf):
    r = view(spark, sf, "reports").select("id", "kind")
    return r.where("kind = 'research'").unionByName(r.where("kind = 'breach'")).unionByName(r.where("kind = 'exploit'"))


@query("n6b_citation_tokens", "SELECT conv_id, turn, unnest(list_filter(list_distinct([CAST(turn AS INT) + 1, CAST(conv_id % 5 AS INT), 99]), lambda i: i BETWEEN 1 AND 9)) AS cited FROM conversations")
def n6b(spark, sf):
    """Tokens in each turn's text, one of them twice and one unknown."""
    one, two = (F.col("turn") + 1).cast("string"), (F.col("conv_id") % 5).cast("string")
    said = F.concat(F.coalesce(F.regexp_replace("text", r"[\[\]]", " "), F.lit("")), F.lit(" ["), one, F.lit("]["), two, F.lit("] and [99] text [12345678901] and [99999999999999999999] ["), one, F.lit("] [x] [ 3 ]"))
    rows = run(spark, sf, "SELECT conv_id, turn, text FROM {conversations}").select("conv_id", "turn", F.explode(text.citations(said)).alias("cited"))
    return rows.join(spark.range(1, 10).select(F.col("id").cast("int").alias("cited")), "cited").select("conv_id", "turn", "cited")


@query("i7_new_actor_guard", with_views("""SELECT 'Crew of ' || source_name AS name, CASE id % 3 WHEN 0 THEN 'china' ELSE 'other' END AS nexus, CASE id % 3 WHEN 0 THEN 'China' END AS country, CASE id % 3 WHEN 0 THEN 'nation_state' END AS motivation, 'provisional' AS status FROM reports WHERE id % 5 = 0 AND coalesce(adversary_label, '') <> 'Qilin'
    AND NOT EXISTS (SELECT 1 FROM reports x WHERE x.source_name = reports.source_name AND x.id % 5 = 0 AND coalesce(x.adversary_label, '') <> 'Qilin' AND x.id < reports.id)""", "reports"))
def i7(spark, sf):
    """Names met in reports: new ones, bare families, placeholders, too short ones, ordinary words, and aliases that are known."""
    named = among(F.col("id"), F.concat(F.lit(" Crew of "), "source_name"), F.coalesce("adversary_label", F.lit("UNID PANDA")), F.lit("abc"), F.lit("sofacy"), F.lit("Lead"))
    met = view(spark, sf, "reports").where("adversary_label is null or adversary_label <> 'Qilin'").select(named.alias("name"), among(F.col("id"), F.lit("china"), F.lit("other"), F.lit(None)).alias("nexus"), F.col("id").alias("ord"))
    return attribution.provisional(met, actors(spark, sf)).select("name", "nexus", "country", F.get("motivation", F.lit(0)).alias("motivation"), "status")


@query("s2_clean_descriptions", f"SELECT page_id, nullif(substr({ascii_sql("regexp_replace(html, '<[^>]*>', ' ', 'g')")}, 1, 500), '') AS plain FROM pages")
def s2(spark, sf):
    return run(spark, sf, "SELECT page_id, html FROM {pages}").select("page_id", text.clean(F.col("html")).alias("plain"))


RSS_ITEMS = """SELECT page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title, regexp_replace(regexp_extract(html, '(?s)</h1>(.*?)</p>', 1), '[<>&]', ' ', 'g') AS about FROM pages"""


@query("s1_rss_entries", f"""SELECT 'feed ' || CAST(page_id % 3 AS VARCHAR) AS source_name, {ascii_sql('title')} AS title, url, nullif(substr({ascii_sql('about')}, 1, 500), '') AS description, CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2026-07-23 07:13:03' WHEN page_id % 3 = 1 THEN TIMESTAMP '2026-07-01 00:00:00' END AS published_at
    FROM ({RSS_ITEMS}) WHERE page_id % 4 <> 3 AND {ascii_sql('title')} <> ''""")
def s1(spark, sf):
    """Each page as a feed of two entries: its own, and one without a link (or, every fourth, both without); dates in three forms."""
    n = F.col("page_id")
    cdata = lambda c: F.concat(F.lit("<![CDATA["), c, F.lit("]]>"))
    about = F.regexp_replace(F.regexp_extract("html", "(?s)</h1>(.*?)</p>", 1), "[<>&]", " ")
    when = among(n, F.lit("<pubDate>Thu, 23 Jul 2026 09:13:03 CEST</pubDate>"), F.lit("<isoDate>2026-07-01T00:00:00Z</isoDate>"), F.lit("<pubDate>some day</pubDate>"))
    link = F.when(n % 4 == 3, F.lit("<link> </link>")).otherwise(F.concat(F.lit("<link> "), cdata(F.col("url")), F.lit(" </link>")))
    title = F.concat(F.lit("<title>"), cdata(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)), F.lit("</title>"))
    body = F.concat(F.lit("<rss><channel><title>Feed</title><item>"), title, link, F.lit("<description>"), cdata(about), F.lit("</description>"), when, F.lit("</item><item>"), title, F.lit("</item></channel></rss>"))
    fetched = run(spark, sf, "SELECT page_id, url, html FROM {pages}").select(F.concat(F.lit("feed "), (n % 3).cast("string")).alias("source_name"), body.alias("body"))
    return feeds.entries(fetched).select("source_name", "title", "url", "description", "published_at")


@query("s7_scan_by_ids", with_views("SELECT id, title FROM reports WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)", "reports"))
def s7(spark, sf):
    ids = run(spark, sf, "SELECT doc_id AS id FROM {labels} WHERE toxic = 1")
    return view(spark, sf, "reports").join(ids, "id", "left_semi").select("id", "title")


@query("s21_run_log", with_views("""SELECT 'r1' AS run_id, 'success' AS status, count(*) FILTER (published_at IS NOT NULL) AS items_added, '{\"candidates\": ' || CAST(count(*) AS VARCHAR) || ', \"undated\": ' || CAST(count(*) FILTER (published_at IS NULL) AS VARCHAR) || ', \"errors\": [\"feed\"]}' AS log, TIMESTAMP '2024-04-30 01:00:00' AS finished_at FROM reports UNION ALL SELECT 'r2', 'running', NULL, NULL, NULL""", "reports"))
def s21(spark, sf):
    """A run opened and closed with its counters, and one that is still under way."""
    total, undated = view(spark, sf, "reports").agg(F.count("*"), F.count_if(F.col("published_at").isNull())).first()
    at = F.expr(AS_OF).cast("timestamp")
    log = spark.createDataFrame([], "run_id string, status string, started_at timestamp, finished_at timestamp, items_added long, log string")
    log = sinks.run_opened(sinks.run_opened(log, "r1", at), "r2", at)
    done = sinks.run_closed(log, "r1", at + F.make_dt_interval(F.lit(0), F.lit(1)), "success", total - undated, {"candidates": total, "undated": undated, "errors": ["feed"]})
    return done.select("run_id", "status", "items_added", "log", "finished_at")


@query("o3_candidate_order", with_views("SELECT id, CAST(row_number() OVER (PARTITION BY source_name ORDER BY coalesce(published_at, DATE '1970-01-01') DESC, id) AS INT) AS place FROM reports", "reports"))
def o3(spark, sf):
    date = F.coalesce("published_at", F.expr("DATE '1970-01-01'"))
    return views.top_per(view(spark, sf, "reports"), "source_name", 1 << 30, date.desc(), F.col("id")).select("id", "place")


@query("o5_q11_section_limits", with_views("SELECT id, section FROM (SELECT id, section, row_number() OVER (PARTITION BY section ORDER BY published_at DESC NULLS LAST, id) AS n FROM (SELECT *, CASE WHEN kind IN ('research', 'other') THEN 'reports' WHEN kind = 'breach' THEN 'breaches' ELSE 'exploits' END AS section FROM reports WHERE contains(lower(source_name), 'src'))) WHERE n <= 50", "reports"))
def o5(spark, sf):
    hits = search.search("src:src", view(spark, sf, "reports"))
    return views.top_per(hits, "section", 50, *views.newest()).select("id", "section")


@query("o6_longest_alias_first", with_views("SELECT name, length(name) AS n, CAST(row_number() OVER (ORDER BY length(name) DESC, ord) AS INT) AS place FROM actors", "actors"))
def o6(spark, sf):
    from pyspark.sql import Window

    order = Window.orderBy(F.length("name").desc(), "ord")
    return actors(spark, sf).select("name", F.length("name").cast("long").alias("n"), F.row_number().over(order).alias("place"))


@query("u2_set_difference", with_views("SELECT DISTINCT raw_hash FROM reports WHERE raw_hash NOT IN (SELECT raw_hash FROM hidden)", "reports", "hidden"))
def u2(spark, sf):
    return view(spark, sf, "reports").select("raw_hash").subtract(view(spark, sf, "hidden").select("raw_hash"))


@query("u4_q9_complement", with_views("SELECT id FROM reports r WHERE NOT (EXISTS (SELECT 1 FROM report_labels l WHERE l.id = r.id AND contains(lower(l.name), 'zimbra')) OR coalesce(contains(lower(cve_id), '2024-10'), false))", "reports", "report_labels"))
def u4(spark, sf):
    tree = search.parse("NOT (label:zimbra OR cve:2024-10)")
    docs = search.documents(view(spark, sf, "reports"), search.fields(tree), view(spark, sf, "report_labels"), spark.createDataFrame([], "id long, value string, ioc_type string"))
    return docs.where(search.compiled(tree)).select("id")


IN_TEXT = "(contains(lower(title), 'the') OR coalesce(contains(lower(description), 'the'), false) OR coalesce(contains(lower(cve_id), 'the'), false) OR coalesce(contains(lower(target), 'the'), false))"


@query("q10_text_only_relevance", with_views(f"SELECT id FROM reports WHERE {IN_TEXT} AND (kind = 'exploit' OR NOT {hit(TEXT, rules.OFF_TOPIC)} OR {hit(TEXT, rules.STRONG_INTEL)})", "reports"))
def q10(spark, sf):
    return search.search("the", view(spark, sf, "reports")).select("id")


HAS = "EXISTS (SELECT 1 FROM item_iocs i WHERE i.id = r.id AND {0})"


def item_iocs(spark, sf):
    return view(spark, sf, "links").join(view(spark, sf, "iocs"), "ioc_id").select(F.col("item_id").alias("id"), "value", "ioc_type")


#: Searches over stored indicators: obfuscated needles, globs, patterns, any of them, techniques, and the report's own CVE beside linked ones.
IOC_SEARCHES = {
    "domain:evil[.]example": HAS.format("ioc_type = 'domain' AND contains(lower(value), 'evil.example')"),
    "ip:45.* -domain:*.bad.test": HAS.format("ioc_type = 'ip' AND regexp_matches(value, '(?i)^45\\..*$')") + " AND NOT " + HAS.format("ioc_type = 'domain' AND regexp_matches(value, '(?i)^.*\\.bad\\.test$')"),
    "cve:~2024-10[12]": "(" + HAS.format("ioc_type = 'cve' AND regexp_matches(value, '(?i)2024-10[12]')") + " OR coalesce(regexp_matches(cve_id, '(?i)2024-10[12]'), false))",
    'ioc:"h1" OR ttp:t1010': "(" + HAS.format("ioc_type IN ('ip', 'domain', 'file_hash', 'cve') AND contains(lower(value), 'h1')") + " OR " + HAS.format("ioc_type = 'mitre' AND contains(lower(value), 't1010')") + ")",
    "NOT ioc:45.1 src:src1": "NOT " + HAS.format("ioc_type <> 'mitre' AND contains(lower(value), '45.1')") + " AND contains(source_name, 'src1')",
}


def _ioc_search(number: int, asked: str, test: str):
    @query(f"q_search_iocs_{number}", with_views(f"SELECT r.id FROM reports r WHERE {test}", "reports", "links", "iocs").replace(") SELECT r.id", "), item_iocs AS (SELECT item_id AS id, value, ioc_type FROM links JOIN iocs USING (ioc_id)) SELECT r.id", 1))
    def run_search(spark, sf):
        return search.search(asked, view(spark, sf, "reports"), iocs=item_iocs(spark, sf)).select("id")


for _i, (_asked, _test) in enumerate(IOC_SEARCHES.items(), 1):
    _ioc_search(_i, _asked, _test)


@query("a8_n7_pairs_as_json", with_views("SELECT '{\"a\":' || CAST(a AS VARCHAR) || ',\"b\":' || CAST(b AS VARCHAR) || ',\"weight\":' || CAST(w AS VARCHAR) || '}' AS pair FROM (SELECT x.item_id AS a, y.item_id AS b, count(*) AS w FROM links x JOIN links y ON x.ioc_id = y.ioc_id AND x.item_id < y.item_id WHERE x.ioc_id IN (SELECT ioc_id FROM links GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25) GROUP BY 1, 2)", "links"))
def a8(spark, sf):
    from tidewatch.operators import network

    return network.pairs(view(spark, sf, "links"), 25).select(F.to_json(F.struct("a", "b", "weight")).alias("pair"))


@query("i6_source_domains", with_views("SELECT ioc_id FROM iocs WHERE ioc_type = 'domain' AND regexp_matches(value, '(^|\\.)evil\\.example$')", "iocs"))
def i6(spark, sf):
    own = spark.range(1).select(indicators.host(F.lit("https://www.evil.example/blog")).alias("value"), F.lit("domain").alias("ioc_type"))
    iocs = view(spark, sf, "iocs").where("ioc_type = 'domain'")
    return iocs.join(indicators.not_allowed(iocs, own).select("ioc_id"), "ioc_id", "left_anti").select("ioc_id")


@query("i8_allowlist_from_flags", with_views("""SELECT what, value, n FROM (SELECT 'listed' AS what, CASE ioc_type WHEN 'domain' THEN lower(value) ELSE value END || '|' || ioc_type AS value, 1 AS n FROM iocs WHERE ioc_id % 16 < 3 AND ioc_type IN ('ip', 'domain') GROUP BY 2
    UNION ALL SELECT 'iocs', '', count(*) FROM iocs WHERE ioc_id % 16 >= 3 UNION ALL SELECT 'links', '', count(*) FROM links WHERE ioc_id % 16 >= 3)""", "iocs", "links"))
def i8(spark, sf):
    """Accepted flags of every type: new rows of the list, and what is left of indicators and links."""
    iocs, links = view(spark, sf, "iocs"), view(spark, sf, "links")
    flags = iocs.where("ioc_id % 16 < 3").withColumn("category", F.lit("parked"))
    listed, left, linked = sinks.removed(flags, iocs, links)
    count = lambda df, name: df.agg(F.lit(name).alias("what"), F.lit("").alias("value"), F.count("*").alias("n"))
    return listed.select(F.lit("listed").alias("what"), F.concat_ws("|", "value", "ioc_type").alias("value"), F.lit(1).cast("long").alias("n")).unionByName(count(left, "iocs")).unionByName(count(linked, "links"))


@query("i5_manual_attribution", with_views("""SELECT id, CASE WHEN f IN (0, 1, 2) AND kind <> 'exploit' THEN 'research' ELSE kind END AS kind, CASE f WHEN 0 THEN 'FANCY BEAR' WHEN 1 THEN 'UNID TIGER' WHEN 2 THEN 'SPIDER' WHEN 3 THEN NULL ELSE adversary_label END AS adversary_label,
    CASE f WHEN 0 THEN 'FANCY BEAR' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE crowdstrike_adversary END AS crowdstrike_adversary, CASE f WHEN 0 THEN 'Russia' WHEN 1 THEN 'India' WHEN 2 THEN NULL ELSE country END AS country,
    CASE f WHEN 0 THEN 'nation_state' WHEN 1 THEN 'nation_state' WHEN 2 THEN 'ecrime' ELSE motivation END AS motivation, CASE WHEN f <= 3 THEN true WHEN f = 4 THEN false END AS recognised FROM (SELECT *, id % 6 AS f FROM reports)""", "reports"))  # fmt: skip
def i5(spark, sf):
    """Edits by alias, by UNID family, by bare family, to nothing, to free text; and reports without an edit."""
    r = view(spark, sf, "reports")
    typed = among(F.col("id"), F.lit(" apt28 "), F.lit("Unid Tiger"), F.lit("spider"), F.lit("  "), F.lit("Some New Crew"), F.lit(None))
    edits = r.where("id % 6 < 5").select("id", typed.alias("typed"))
    known = actors(spark, sf).withColumn("country", F.when(F.col("nexus") == "russia", "Russia"))
    return attribution.edited(r, edits, known).select("id", "kind", "adversary_label", "crowdstrike_adversary", "country", "motivation", "recognised")
