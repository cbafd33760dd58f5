"""Queries on reports, sources and subscriptions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import rules
from tidewatch.functions.patterns import has, text_of
from tidewatch.operators import attribution, cve, notify, search, views
from tidewatch.plans.adapters import AS_OF, REPORTS, actors, braced, run, view, with_views
from tidewatch.plans.registry import query
from tidewatch.sources import sinks


TEXT = "coalesce(title, '') || ' ' || coalesce(description, '')"
quoted = lambda p: "'(?i)" + p.replace("'", "''") + "'"
hit = lambda c, p: f"regexp_matches({c}, {quoted(p)})"

VULN_ROWS = "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'CVE-2024-' ELSE 'cve-2024-' END || CAST(o_custkey AS STRING) AS cve_id, 'h' || CAST(o_orderkey AS STRING) AS raw_hash, CAST(o_orderdate AS DATE) AS published_at, o_orderdate AS created_at, CASE WHEN o_orderpriority LIKE '1%' THEN 'poc' WHEN o_orderpriority LIKE '2%' THEN 'confirmed' ELSE 'suspected' END AS exploit_status, CASE WHEN o_orderkey % 3 = 0 THEN 't' || CAST(o_orderkey % 100 AS STRING) END AS target, CASE WHEN o_orderkey % 5 = 0 THEN 'APT' || CAST(o_orderkey % 40 AS STRING) END AS adversary_label, CAST(NULL AS STRING) AS description, 'u' AS url, 's' AS source_name, o_orderkey AS ord FROM orders"


@query(
    "a1_cve_priority",
    f"""WITH r AS ({VULN_ROWS}), k AS (SELECT *, upper(trim(cve_id)) AS k FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY published_at DESC, ord) AS rn FROM k),
    g AS (SELECT k, max(CASE WHEN rn = 1 THEN cve_id END) AS cve_id, max(CASE WHEN rn = 1 THEN raw_hash END) AS raw_hash, max(CASE WHEN rn = 1 THEN published_at END) AS added_at, max(created_at) AS created_at, count(*) AS report_count,
        bool_or(exploit_status = 'poc') AS p, bool_or(exploit_status = 'confirmed') AS c, bool_or(exploit_status = 'suspected') AS s FROM n GROUP BY k),
    t AS (SELECT k, target FROM (SELECT k, target, row_number() OVER (PARTITION BY k ORDER BY rn) AS q FROM n WHERE target IS NOT NULL) WHERE q = 1),
    a AS (SELECT k, adversary_label FROM (SELECT k, adversary_label, row_number() OVER (PARTITION BY k ORDER BY rn) AS q FROM n WHERE adversary_label IS NOT NULL) WHERE q = 1)
    SELECT g.cve_id, raw_hash, added_at, created_at, report_count, target, adversary_label, CASE WHEN p AND c THEN 'critical' WHEN p THEN 'high' ELSE 'medium' END AS priority,
        concat_ws(',', CASE WHEN p THEN 'poc' END, CASE WHEN c THEN 'confirmed' END, CASE WHEN s THEN 'suspected' END) AS statuses
    FROM g LEFT JOIN t ON g.k = t.k LEFT JOIN a ON g.k = a.k WHERE p OR c""",
)
def a1(spark, sf):
    rows = cve.prioritised(run(spark, sf, braced(VULN_ROWS)))
    return rows.orderBy(*cve.order()).select("cve_id", "raw_hash", "added_at", "created_at", "report_count", "target", "adversary_label", "priority", F.array_join("statuses", ",").alias("statuses"))


#: The same with dates of years, so that most places are decided by the ids' years and numbers.
YEAR_ROWS = VULN_ROWS.replace("CAST(o_orderdate AS DATE)", "CAST(date_trunc('YEAR', o_orderdate) AS DATE)").replace("o_orderdate AS created_at", "date_trunc('YEAR', o_orderdate) AS created_at")
PART = "CAST(regexp_extract(cve_id, '(?i)CVE-([0-9]+)-([0-9]+)', {0}) AS BIGINT)"


@query(
    "o1_cve_order",
    f"""WITH k AS (SELECT upper(trim(cve_id)) AS k, max(published_at) AS added_at, max(created_at) AS created_at, bool_or(exploit_status = 'poc') AS p, bool_or(exploit_status = 'confirmed') AS c FROM ({YEAR_ROWS}) GROUP BY 1)
    SELECT k AS cve_id, row_number() OVER (ORDER BY CASE WHEN p AND c THEN 1 WHEN p THEN 2 ELSE 3 END, added_at DESC, created_at DESC, {PART.format(1).replace('cve_id', 'k')} DESC, {PART.format(2).replace('cve_id', 'k')} DESC, k DESC) AS place FROM k WHERE p OR c""",
)
def o1(spark, sf):
    """Every CVE with its place in the list."""
    found = cve.prioritised(run(spark, sf, braced(YEAR_ROWS)))
    return found.select(F.upper("cve_id").alias("cve_id"), F.row_number().over(Window.orderBy(*cve.order())).cast("long").alias("place"))



@query("f1_window_scan", with_views(f"SELECT id, published_at FROM reports WHERE kind = 'research' AND published_at >= {AS_OF} - 30", "reports"))
def f1(spark, sf):
    return views.window(view(spark, sf, "reports"), "research", F.expr(AS_OF), 30).orderBy(*views.newest()).select("id", "published_at")


@query("f2_visible", with_views("SELECT id, raw_hash FROM reports WHERE raw_hash NOT IN (SELECT raw_hash FROM hidden)", "reports", "hidden"))
def f2(spark, sf):
    return views.shown(view(spark, sf, "reports"), view(spark, sf, "hidden")).select("id", "raw_hash")


@query("f3_relevance", with_views(f"SELECT id FROM reports WHERE NOT {hit(TEXT, rules.OFF_TOPIC)} OR {hit(TEXT, rules.STRONG_INTEL)}", "reports"))
def f3(spark, sf):
    return view(spark, sf, "reports").where(rules.relevant(text_of("title", "description"))).select("id")


SIGNALS = {"breach": rules.BREACH, "large_scale": rules.LARGE_SCALE, "incident": rules.INCIDENT, "research": rules.RESEARCH, "confirmed": rules.CONFIRMED, "poc": rules.POC, "hacktivism": rules.HACKTIVISM}


@query("f4_f5_signals", with_views("SELECT id, " + f"{hit('title', rules.MARKETING)} OR {hit('coalesce(description, chr(32))', rules.MARKETING)} AS marketing, {hit('title', rules.ADVISORY)} AS advisory, " + ", ".join(f"{hit(TEXT, p)} AS {n}" for n, p in SIGNALS.items()) + " FROM reports", "reports"))
def f45(spark, sf):
    text = text_of("title", "description")
    return view(spark, sf, "reports").select("id", rules.marketing(F.col("title"), F.col("description")).alias("marketing"), has(F.col("title"), rules.ADVISORY).alias("advisory"), *(has(text, p).alias(n) for n, p in SIGNALS.items()))


@query("f6_search_corpus", with_views("SELECT id FROM (SELECT id, raw_hash FROM reports ORDER BY published_at DESC NULLS LAST, id LIMIT 400) WHERE raw_hash NOT IN (SELECT raw_hash FROM hidden)", "reports", "hidden"))
def f6(spark, sf):
    return search.corpus(view(spark, sf, "reports"), view(spark, sf, "hidden"), most=400)[0].select("id")


@query("f9_f10_range_tooltip", with_views("SELECT id, CASE WHEN id % 400 IN (7, 14, 30, 90, 182, 365) THEN CAST(id % 400 AS INT) ELSE 90 END AS days, CASE WHEN length(trim(description)) > 180 THEN rtrim(substr(trim(description), 1, 180)) || '...' WHEN trim(description) <> '' THEN trim(description) END AS tip FROM reports", "reports"))
def f910(spark, sf):
    return view(spark, sf, "reports").select("id", views.snapped(F.col("id") % 400).alias("days"), views.tooltip(F.col("description")).alias("tip"))


NOW = "TIMESTAMP '2024-04-30 12:00:00'"


@query("f11_feed_health", with_views(f"SELECT name, CASE WHEN NOT active THEN 'off' WHEN feed_url IS NULL THEN 'ok' WHEN last_error IS NOT NULL THEN 'error' WHEN last_item_at IS NULL THEN 'never' WHEN epoch({NOW}) - epoch(last_item_at) > 2592000 THEN 'stale' ELSE 'ok' END AS health FROM feeds", "feeds"))
def f11(spark, sf):
    return view(spark, sf, "feeds").select("name", rules.feed_health(F.col("active"), F.col("feed_url"), F.col("last_item_at"), F.col("last_error"), F.expr(NOW)).alias("health"))


@query("f12_stale_feeds", with_views(f"SELECT name, last_item_at FROM feeds WHERE active AND feed_url IS NOT NULL AND (last_item_at IS NULL OR last_item_at < {NOW} - INTERVAL 30 DAY)", "feeds"))
def f12(spark, sf):
    return views.stale(view(spark, sf, "feeds"), F.expr(NOW)).select("name", "last_item_at")


@query("f13_source_filter", with_views("SELECT name FROM feeds WHERE active AND contains(lower(name), 'c1')", "feeds"))
def f13(spark, sf):
    return views.sources_found(view(spark, sf, "feeds").withColumn("category", F.lit("news")), "C1", category="news", active=True).select("name")


@query("f15_lookup", with_views("SELECT id, raw_hash FROM reports WHERE raw_hash = 'h77' ORDER BY id LIMIT 1", "reports"))
def f15(spark, sf):
    return views.lookup(view(spark, sf, "reports"), "h77").select("id", "raw_hash")


@query("f16_browse", with_views("SELECT id, n > 200 AS truncated FROM (SELECT *, count(*) OVER () AS n FROM (SELECT * FROM reports WHERE crowdstrike_adversary = 'LockBit' OR adversary_label = 'Qilin' ORDER BY published_at DESC NULLS LAST, id LIMIT 201) WHERE raw_hash NOT IN (SELECT raw_hash FROM hidden)) ORDER BY published_at DESC NULLS LAST, id LIMIT 200", "reports", "hidden"))
def f16(spark, sf):
    test = F.coalesce(F.col("crowdstrike_adversary") == "LockBit", F.lit(False)) | F.coalesce(F.col("adversary_label") == "Qilin", F.lit(False))
    return views.browse(view(spark, sf, "reports"), view(spark, sf, "hidden"), test).select("id", "truncated")


ALIASES = "SELECT DISTINCT alias FROM (SELECT unnest(string_split(name || '|' || community || '|' || internal, '|')) AS alias FROM actors UNION ALL SELECT unnest(['play', 'Dark Halo', 'abc', 'UNC5221', 'Snake ']) AS alias) WHERE alias <> ''"
ORDINARY = "(" + ", ".join(f"'{w}'" for w in rules.ORDINARY) + ")"


@query("f17_alias_quality", with_views(f"SELECT alias, m AS matchable, m AND regexp_matches(trim(alias), '[\\s0-9]') AS strong FROM (SELECT alias, length(trim(alias)) >= 4 AND NOT (NOT regexp_matches(trim(alias), '\\s') AND lower(trim(alias)) IN {ORDINARY}) AS m FROM ({ALIASES}))", "actors"))
def f17(spark, sf):
    a = actors(spark, sf)
    names = a.select(F.explode(F.concat(F.array("name"), "community_identifiers", "internal_alternative_names")).alias("alias"))
    more = spark.range(1).select(F.explode(F.array(*map(F.lit, ("play", "Dark Halo", "abc", "UNC5221", "Snake ")))).alias("alias"))
    return names.unionByName(more).distinct().select("alias", rules.matchable(F.col("alias")).alias("matchable"), rules.strong(F.col("alias")).alias("strong"))


GENERIC = "(" + ", ".join(f"'{w}'" for w in (*rules.FAMILIES, *rules.PLACEHOLDERS)) + ")"


@query("f18_specific_adversary", with_views(f"SELECT id FROM reports WHERE adversary_label IS NOT NULL AND upper(trim(adversary_label)) NOT IN {GENERIC}", "reports"))
def f18(spark, sf):
    return view(spark, sf, "reports").where(rules.specific(F.col("adversary_label"))).select("id")


@query("f20_unlabelled", with_views("SELECT id FROM reports WHERE id NOT IN (SELECT id FROM report_labels WHERE name LIKE 'Malware/%')", "reports", "report_labels"))
def f20(spark, sf):
    labelled = view(spark, sf, "report_labels").where(F.col("name").startswith("Malware/"))
    return view(spark, sf, "reports").join(labelled, "id", "left_anti").orderBy(*views.newest()).select("id")


@query("f21_poll", with_views("SELECT id, created_at FROM reports WHERE created_at > TIMESTAMP '2024-03-01 00:00:00' ORDER BY created_at DESC, id LIMIT 20", "reports"))
def f21(spark, sf):
    return views.poll(view(spark, sf, "reports"), F.expr("TIMESTAMP '2024-03-01 00:00:00'")).select("id", "created_at")


# matching: the catalogue written out, longest alias first, then in catalogue order
GROUPS = f"SELECT alias, nexus, cs, motive, row_number() OVER (ORDER BY length(alias) DESC, ord, pos, alias) AS rk FROM (SELECT lower(trim(raw)) AS alias, nexus, name AS cs, motive, ord, pos FROM (SELECT name, nexus, motive, ord, unnest(string_split(name || '|' || community || '|' || internal, '|')) AS raw, generate_subscripts(string_split(name || '|' || community || '|' || internal, '|'), 1) AS pos FROM actors)) WHERE length(alias) >= 4 AND NOT (NOT regexp_matches(alias, '\\s') AND alias IN {ORDINARY})"
MATCH = f"grp AS ({GROUPS}), hits AS (SELECT r.id, g.*, row_number() OVER (PARTITION BY r.id ORDER BY rk) AS rn FROM reports r JOIN grp g ON regexp_matches(lower({TEXT}), '(^|[^a-z0-9])' || g.alias || '($|[^a-z0-9])')), best AS (SELECT * FROM hits WHERE rn = 1)"


def matched(sql: str, *names: str) -> str:
    return with_views("", *dict.fromkeys(("reports", "actors", *names))).rstrip() + f", {MATCH} {sql}"


def groups(spark, sf, motive: str | None = None):
    found = attribution.aliases(actors(spark, sf))
    return attribution.catalogue(found.where(F.col("motivation") == motive) if motive else found)


@query("j4_alias_match", matched("SELECT id, alias, nexus, cs, motive AS motivation FROM best"))
def j4(spark, sf):
    m = attribution.match_report(F.col("title"), F.col("description"), groups(spark, sf))
    return view(spark, sf, "reports").select("id", m.alias("g")).where("g is not null").select("id", "g.*")


@query("j4_alias_match_join", matched("SELECT id, alias, nexus, cs, motive AS motivation FROM best"))
def j4_join(spark, sf):
    return attribution.match_join(view(spark, sf, "reports"), attribution.aliases(actors(spark, sf)), "id", text_of("title", "description"))


@query("j1_labels_of_reports", with_views("SELECT id, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT id, name FROM report_labels) GROUP BY id", "report_labels"))
def j1(spark, sf):
    return view(spark, sf, "report_labels").groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


@query("j3_nexus_by_name", with_views("SELECT id, nexus FROM reports LEFT JOIN actors ON lower(crowdstrike_adversary) = lower(name)", "reports", "actors"))
def j3(spark, sf):
    a = actors(spark, sf).select(F.lower("name").alias("k"), "nexus")
    return view(spark, sf, "reports").join(a, F.lower("crowdstrike_adversary") == F.col("k"), "left").select("id", "nexus")


@query("x11_x14_routing", matched(f"""SELECT r.id, upper(regexp_extract({TEXT}, {quoted(rules.ROUTING_CVE)})) AS cve,
    CASE WHEN {hit(TEXT, rules.POC)} THEN 'poc' WHEN category = 'government' OR {hit(TEXT, rules.CONFIRMED)} THEN 'confirmed' ELSE 'suspected' END AS status,
    CASE WHEN {hit(TEXT, rules.ROUTING_CVE)} THEN 'vuln' WHEN b.id IS NOT NULL THEN 'actor_activity' WHEN {hit(TEXT, rules.BREACH)} THEN 'breach' WHEN category = 'news' AND {hit(TEXT, rules.LARGE_SCALE)} THEN 'breaking' ELSE 'report' END AS item_type
    FROM reports r LEFT JOIN best b ON r.id = b.id"""))  # fmt: skip
def x11(spark, sf):
    text = text_of("title", "description")
    r = view(spark, sf, "reports").withColumn("g", attribution.match(text, groups(spark, sf)))
    return r.select("id", F.coalesce(rules.routing_cve(text), F.lit("")).alias("cve"), rules.exploit_status(text, F.col("category")).alias("status"), rules.item_type(text, F.col("g").isNotNull(), F.col("category")).alias("item_type"))


MARKET = f"({hit('title', rules.MARKETING)} OR {hit('coalesce(description, chr(32))', rules.MARKETING)})"


@query("x15_rules_verdict", matched(f"""SELECT id, CASE WHEN {MARKET} THEN 'drop' WHEN quiet THEN 'drop' WHEN unsure THEN 'unsure' ELSE 'keep' END AS verdict,
    CASE WHEN {MARKET} THEN 'marketing / product' WHEN quiet THEN 'low-signal crew mention' END AS reason
    FROM (SELECT r.*, coalesce(b.nexus = 'other' AND b.motive <> 'hacktivism' AND NOT {hit(TEXT, rules.LARGE_SCALE)} AND NOT {hit(TEXT, rules.RESEARCH)} AND NOT {hit(TEXT, rules.INCIDENT)}, false) AS quiet,
        b.id IS NULL AND category = 'news' AND NOT {hit(TEXT, rules.ROUTING_CVE)} AND NOT {hit(TEXT, rules.BREACH)} AND NOT {hit(TEXT, rules.LARGE_SCALE)} AND NOT {hit(TEXT, rules.HACKTIVISM)} AS unsure
        FROM reports r LEFT JOIN best b ON r.id = b.id)"""))  # fmt: skip
def x15(spark, sf):
    r = view(spark, sf, "reports").withColumn("g", attribution.match(text_of("title", "description"), groups(spark, sf)))
    v = rules.verdict(F.col("title"), F.col("url"), F.col("description"), F.col("category"), F.col("g.nexus"), F.col("g.motivation"))
    return r.select("id", v.alias("v")).select("id", "v.verdict", "v.reason")


COUNTRY_CASE = "CASE lower(trim(country)) " + " ".join(f"WHEN '{c.lower()}' THEN '{f}'" for f, c in rules.FAMILIES.items() if c) + " END"
TEXT_CASE = "CASE " + " ".join(f"WHEN {hit(TEXT, chr(92) + 'b(' + w + ')' + chr(92) + 'b')} THEN '{f}'" for f, w in rules.ADJECTIVES.items()) + " ELSE 'BAT' END"


@query("x16_adversary_label", with_views(f"SELECT id, CASE WHEN crowdstrike_adversary IS NOT NULL AND upper(trim(crowdstrike_adversary)) NOT IN {GENERIC} THEN crowdstrike_adversary ELSE 'UNID ' || CASE nexus WHEN 'china' THEN 'PANDA' WHEN 'russia' THEN 'BEAR' WHEN 'north_korea' THEN 'CHOLLIMA' WHEN 'iran' THEN 'KITTEN' ELSE coalesce({COUNTRY_CASE}, {TEXT_CASE}) END END AS label FROM (SELECT *, CASE lower(trim(country)) WHEN 'china' THEN 'china' WHEN 'russia' THEN 'russia' WHEN 'north korea' THEN 'north_korea' WHEN 'iran' THEN 'iran' ELSE 'rest_of_world' END AS nexus FROM reports)", "reports"))
def x16(spark, sf):
    label = rules.adversary_label(F.col("crowdstrike_adversary"), rules.nexus_of_country(F.col("country")), text_of("title", "description"), F.col("country"))
    return view(spark, sf, "reports").select("id", label.alias("label"))


@query("x34_model_tier", matched(f"SELECT r.id, CASE WHEN NOT {hit('title', rules.DESIGNATOR)} AND b.id IS NULL AND {hit('title', rules.BULLETIN)} THEN 'cheap' ELSE 'standard' END AS tier FROM reports r LEFT JOIN (SELECT r.id FROM reports r WHERE EXISTS (SELECT 1 FROM grp g WHERE regexp_matches(lower(title), '(^|[^a-z0-9])' || g.alias || '($|[^a-z0-9])'))) b ON r.id = b.id"))
def x34(spark, sf):
    return view(spark, sf, "reports").select("id", rules.model_tier(F.col("title"), attribution.match(F.col("title"), groups(spark, sf)).isNotNull()).alias("tier"))


@query("a2_country_cards", with_views("SELECT label, total, CAST(row_number() OVER (ORDER BY CASE WHEN label = 'Non Attributed' THEN 1 ELSE 0 END, total DESC, label) AS INT) AS place FROM (SELECT coalesce(country, 'Non Attributed') AS label, count(*) AS total FROM reports WHERE motivation = 'nation_state' GROUP BY 1)", "reports"))
def a2(spark, sf):
    return attribution.cards(view(spark, sf, "reports").where("motivation = 'nation_state'"), "country")


NAMED = f"CASE WHEN crowdstrike_adversary IS NOT NULL AND upper(trim(crowdstrike_adversary)) NOT IN {GENERIC} THEN trim(crowdstrike_adversary) WHEN adversary_label IS NOT NULL AND upper(trim(adversary_label)) NOT IN {GENERIC} THEN trim(adversary_label) END"
BOTH = f"e AS (SELECT id, cs FROM (SELECT h.id, h.cs, row_number() OVER (PARTITION BY h.id ORDER BY rk) AS q FROM hits h WHERE motive = 'ecrime') WHERE q = 1), h AS (SELECT id, cs FROM (SELECT h.id, h.cs, row_number() OVER (PARTITION BY h.id ORDER BY rk) AS q FROM hits h WHERE motive = 'hacktivism') WHERE q = 1), j AS (SELECT r.*, e.cs AS ecs, h.cs AS hcs, {hit(TEXT, rules.HACKTIVISM)} AS hk, {NAMED} AS named FROM reports r LEFT JOIN e ON r.id = e.id LEFT JOIN h ON r.id = h.id)"


@query("a3_actor_sections", matched(", " + BOTH + " SELECT section, coalesce(actor, 'Non Attributed') AS actor, count(*) AS n FROM (SELECT CASE WHEN motivation IN ('ecrime', 'hacktivism') THEN motivation WHEN hcs IS NOT NULL OR hk THEN 'hacktivism' WHEN ecs IS NOT NULL THEN 'ecrime' END AS section, CASE WHEN motivation = 'ecrime' THEN coalesce(named, ecs) WHEN motivation = 'hacktivism' THEN coalesce(named, hcs) ELSE coalesce(hcs, CASE WHEN NOT hk THEN ecs END) END AS actor FROM j WHERE kind = 'research') WHERE section IS NOT NULL GROUP BY 1, 2").replace("best AS (SELECT * FROM hits WHERE rn = 1) ,", "best AS (SELECT * FROM hits WHERE rn = 1),"))
def a3(spark, sf):
    rows = attribution.section_rows(view(spark, sf, "reports").where("kind = 'research'"), groups(spark, sf, "ecrime"), groups(spark, sf, "hacktivism"))
    return rows.groupBy("section", "actor").agg(F.count("*").alias("n"))


LANE_NAMED = f"CASE WHEN crowdstrike_adversary IS NOT NULL AND upper(trim(crowdstrike_adversary)) NOT IN {GENERIC} THEN trim(crowdstrike_adversary) WHEN trim(adversary_label) <> '' THEN trim(adversary_label) END"
EVENTS = BOTH.replace(NAMED, LANE_NAMED) + """, ev AS (SELECT id, published_at AS date, kind, CASE WHEN kind = 'exploit' THEN CASE WHEN exploit_status = 'poc' THEN 'exploit' END
    WHEN kind = 'breach' THEN CASE WHEN hcs IS NOT NULL THEN 'hacktivism' WHEN coalesce(named, ecs) IS NOT NULL THEN 'ecrime' ELSE 'breach' END
    WHEN kind = 'research' THEN CASE WHEN motivation IS NOT NULL THEN motivation WHEN hcs IS NOT NULL OR hk THEN 'hacktivism' WHEN ecs IS NOT NULL THEN 'ecrime' END END AS category,
    CASE WHEN kind = 'exploit' THEN 'Exploits' WHEN kind = 'breach' THEN CASE WHEN hcs IS NOT NULL THEN coalesce(named, hcs) ELSE coalesce(named, ecs, 'Breaches') END
    ELSE CASE motivation WHEN 'nation_state' THEN coalesce(named, 'UNID BAT') WHEN 'ecrime' THEN coalesce(named, 'UNID SPIDER') WHEN 'hacktivism' THEN coalesce(named, 'UNID JACKAL') ELSE CASE WHEN hcs IS NOT NULL THEN hcs WHEN hk THEN 'UNID JACKAL' ELSE ecs END END END AS actor
    FROM j WHERE published_at IS NOT NULL)"""  # fmt: skip


def timeline(spark, sf):
    return attribution.events(view(spark, sf, "reports"), groups(spark, sf, "ecrime"), groups(spark, sf, "hacktivism"))


@query("g7_timeline", matched(", " + EVENTS + " SELECT id, date, actor, category, CASE WHEN kind IN ('exploit', 'breach') THEN kind ELSE 'report' END AS kind FROM ev WHERE category IS NOT NULL").replace(") , e AS", "), e AS"))
def g7(spark, sf):
    return timeline(spark, sf)


@query("f8_visible_events", matched(", " + EVENTS + " SELECT id FROM ev WHERE category IS NOT NULL AND category NOT IN ('breach', 'ecrime') AND NOT (category = 'hacktivism' AND kind = 'breach')").replace(") , e AS", "), e AS"))
def f8(spark, sf):
    return timeline(spark, sf).where(attribution.visible({"ecrime": False, "breaches": False})).select("id")


@query("a4_lanes", matched(", " + EVENTS + """, ln AS (SELECT actor, count(*) AS n, arg_min(category, id) AS category FROM ev WHERE category IS NOT NULL GROUP BY actor),
    o AS (SELECT *, CAST(row_number() OVER (ORDER BY list_position(['nation_state', 'ecrime', 'hacktivism', 'breach', 'exploit'], category), CASE WHEN regexp_matches(actor, '(?i)^unid\\b') THEN 1 ELSE 0 END, n DESC, actor) AS INT) AS place, NOT regexp_matches(actor, '(?i)^unid\\b') AND category NOT IN ('exploit', 'breach') AS nm FROM ln)
    SELECT actor, n, category, place, CAST(CASE WHEN nm THEN (sum(CASE WHEN nm THEN 1 ELSE 0 END) OVER (ORDER BY place) - 1) % 12 END AS INT) AS hue FROM o""").replace(") , e AS", "), e AS"))
def a4(spark, sf):
    return attribution.lanes(timeline(spark, sf))


def periods(select: str, extra: str = "") -> str:
    return " UNION ALL ".join(select.format(name=n, cut=f"published_at >= {AS_OF} - {d}") for n, d in (("last24h", 1), ("last7d", 7), ("last30d", 30)))


@query("a5_a6_window_counts", with_views(periods("SELECT '{name}' AS period, count(*) FILTER ({cut} AND kind = 'research' AND motivation = 'nation_state') AS nation_state, count(*) FILTER ({cut} AND kind = 'breach') AS breaches, count(*) FILTER ({cut} AND kind = 'exploit') AS vulns, count(*) FILTER ({cut} AND kind = 'exploit' AND exploit_status = 'confirmed') AS confirmed, count(*) FILTER ({cut} AND kind = 'exploit' AND exploit_status = 'poc') AS poc, count(*) FILTER ({cut} AND kind = 'exploit' AND exploit_status = 'suspected') AS suspected FROM reports"), "reports"))
def a5(spark, sf):
    return views.window_counts(view(spark, sf, "reports"), F.expr(AS_OF))


@query("a5_by_actor", with_views(f"SELECT coalesce(country, CASE WHEN motivation = 'nation_state' THEN 'Non Attributed' ELSE 'Unattributed' END) AS label, count(*) FILTER (published_at >= {AS_OF} - 1) AS last24h, count(*) FILTER (published_at >= {AS_OF} - 7) AS last7d, count(*) AS last30d FROM reports WHERE kind = 'research' AND published_at >= {AS_OF} - 30 GROUP BY 1", "reports"))
def a5b(spark, sf):
    return views.by_actor(view(spark, sf, "reports"), F.expr(AS_OF))


REASONS = "SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN 'missing title or URL' WHEN 1 THEN 'marketing / product (pre-gate)' WHEN 2 THEN 'LLM: not intelligence' WHEN 3 THEN 'screened out: routine' WHEN 4 THEN 'low-signal crew mention' WHEN 5 THEN ' LLM: a marketing list' END AS reason FROM documents"


@query("a11_x30_drop_reasons", f"SELECT category, n, CAST(list_position(['incomplete', 'marketing', 'not_intelligence', 'screened', 'low_signal', 'other'], category) AS INT) AS place FROM (SELECT CASE doc_id % 7 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'marketing' WHEN 2 THEN 'not_intelligence' WHEN 3 THEN 'screened' WHEN 4 THEN 'low_signal' WHEN 5 THEN 'screened' ELSE 'other' END AS category, count(*) AS n FROM documents GROUP BY 1)")
def a11(spark, sf):
    return views.drop_histogram(run(spark, sf, braced(REASONS)))


@query("a12_keep_rate", with_views("SELECT name, CAST(floor(100.0 * posts_kept / (posts_kept + posts_dropped) + 0.5) AS INT) AS percent, CAST(floor(140.0 * posts_kept / (posts_kept + posts_dropped) + 0.5) AS INT) AS hue, floor(least(1.0, (posts_kept + posts_dropped) / 5.0) * 100 + 0.5) / 100 AS alpha FROM feeds WHERE posts_kept + posts_dropped > 0", "feeds"))
def a12(spark, sf):
    return view(spark, sf, "feeds").select("name", views.keep_rate(F.col("posts_kept"), F.col("posts_dropped")).alias("r")).where("r is not null").select("name", "r.*")


@query("a13_tally", "SELECT source AS source_name, count(*) FILTER (quality = 1) AS kept, count(*) FILTER (quality = 0) AS dropped FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a13(spark, sf):
    return views.tally(run(spark, sf, "SELECT d.source AS source_name, l.quality = 1 AS kept FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"))


AS_SEEN = "CAST(DATE '2024-04-24' + CAST(source_id % 9 AS INT) AS TIMESTAMP)"


@query("a14_watermark", with_views(f"""SELECT name, CASE WHEN m IS NOT NULL AND (seen IS NULL OR seen < CAST(m AS TIMESTAMP) + INTERVAL '23:59:59') THEN CAST(m AS TIMESTAMP) + INTERVAL 12 HOUR ELSE seen END AS last_item_at
    FROM (SELECT source_name AS name, CASE WHEN source_id % 6 = 0 THEN NULL WHEN source_id % 5 = 0 THEN {AS_SEEN} + INTERVAL '23:59:59' ELSE {AS_SEEN} + to_hours(CAST(source_id % 24 AS INT)) END AS seen FROM (SELECT source_name, row_number() OVER (ORDER BY source_name) AS source_id FROM (SELECT DISTINCT source_name FROM reports UNION SELECT 'silent'))) LEFT JOIN (SELECT source_name, max(published_at) AS m FROM reports GROUP BY 1) ON name = source_name""", "reports"))  # fmt: skip
def a14(spark, sf):
    """Sources last seen on days before, on and after their newest report's, at every hour, at a day's last second, or never."""
    r = view(spark, sf, "reports")
    names = r.select("source_name").distinct().unionByName(spark.range(1).select(F.lit("silent").alias("source_name")))
    n = F.row_number().over(Window.orderBy("source_name"))
    day = F.col("day").cast("timestamp")
    s = names.select(F.col("source_name").alias("name"), n.alias("n")).withColumn("day", F.date_add(F.lit("2024-04-24").cast("date"), F.col("n") % 9))
    seen = F.when(F.col("n") % 6 == 0, F.lit(None)).when(F.col("n") % 5 == 0, day + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59))).otherwise(day + F.make_dt_interval(F.lit(0), F.col("n") % 24))
    return views.advanced(s.select("name", seen.alias("last_item_at")), r)


@query("a23_latest", with_views("SELECT kind, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC NULLS LAST, id) AS n FROM reports) WHERE n = 1", "reports"))
def a23(spark, sf):
    return views.latest(view(spark, sf, "reports"), "kind", "created_at").select("kind", "id", "created_at")


@query("a22_unread", with_views("SELECT id, (SELECT count(*) FROM reports WHERE published_at IS NULL) AS unread FROM reports ORDER BY created_at DESC, id LIMIT 30", "reports"))
def a22(spark, sf):
    return views.unread(view(spark, sf, "reports").withColumn("read_at", F.col("published_at"))).select("id", F.col("unread").cast("long").alias("unread"))


@query("w1_evidence", with_views(f"""SELECT CAST(row_number() OVER (ORDER BY band, n) AS INT) AS id_no, period, id FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY published_at DESC, id) AS n FROM (
    SELECT *, CASE WHEN published_at >= {AS_OF} - 1 THEN 'last24h' WHEN published_at >= {AS_OF} - 7 THEN 'days2to7' ELSE 'days8to30' END AS period, CASE WHEN published_at >= {AS_OF} - 1 THEN 0 WHEN published_at >= {AS_OF} - 7 THEN 1 ELSE 2 END AS band
    FROM (SELECT *, row_number() OVER (PARTITION BY raw_hash ORDER BY published_at DESC, id) AS f FROM reports WHERE published_at >= {AS_OF} - 30) WHERE f = 1)) WHERE n <= CASE band WHEN 2 THEN 16 ELSE 18 END""", "reports"))  # fmt: skip
def w1(spark, sf):
    return views.evidence(view(spark, sf, "reports"), F.expr(AS_OF)).select("id_no", "period", "id")


@query("w2_page", with_views("SELECT id, CAST((SELECT count(*) FROM reports) AS INT) AS total FROM reports ORDER BY published_at DESC NULLS LAST, id LIMIT 10 OFFSET 10", "reports"))
def w2(spark, sf):
    return views.page(view(spark, sf, "reports"), 2, 10, *views.newest()).select("id", F.col("total").cast("int").alias("total"))


@query("w3_card_items", with_views("SELECT id, label, place FROM (SELECT id, coalesce(country, 'Non Attributed') AS label, CAST(row_number() OVER (PARTITION BY coalesce(country, 'Non Attributed') ORDER BY published_at DESC NULLS LAST, id) AS INT) AS place FROM reports WHERE motivation = 'nation_state') WHERE place <= 5", "reports"))
def w3(spark, sf):
    return attribution.card_items(view(spark, sf, "reports").where("motivation = 'nation_state'"), "country").select("id", "label", "place")


@query("w4_notable", with_views(f"SELECT id FROM reports WHERE kind = 'research' AND published_at >= {AS_OF} - 7 ORDER BY published_at DESC, id LIMIT 12", "reports"))
def w4(spark, sf):
    return views.window(view(spark, sf, "reports"), "research", F.expr(AS_OF), 7).orderBy(*views.newest()).limit(12).select("id")


@query("w5_capped", with_views("SELECT value, CAST(greatest(0, (SELECT count(DISTINCT value) FROM iocs) - 60) AS INT) AS overflow FROM (SELECT value, min(ioc_id) AS o FROM iocs GROUP BY value) ORDER BY o LIMIT 60", "iocs"))
def w5(spark, sf):
    return views.capped(view(spark, sf, "iocs").withColumn("ord", F.col("ioc_id"))).select("value", F.col("overflow").cast("int").alias("overflow"))


@query("o2_ticker", with_views("SELECT id, kind FROM reports WHERE published_at >= DATE '2024-04-28' - 1 AND (kind = 'breach' OR kind = 'exploit' AND exploit_status = 'poc')", "reports"))
def o2(spark, sf):
    return views.ticker(view(spark, sf, "reports"), F.expr("DATE '2024-04-28'")).select("id", "kind")


@query("s4_newest_per_source", with_views("SELECT id, place FROM (SELECT id, CAST(row_number() OVER (PARTITION BY source_name ORDER BY published_at DESC NULLS LAST, id) AS INT) AS place FROM reports) WHERE place <= 40", "reports"))
def s4(spark, sf):
    return views.top_per(view(spark, sf, "reports"), "source_name", 40, *views.newest()).select("id", "place")


@query("x1_u6_dedup", with_views("""SELECT id, h AS raw_hash FROM (SELECT id, h, row_number() OVER (PARTITION BY h ORDER BY id) AS n FROM (SELECT id, sha256(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) || '|' || CAST(id % 70 AS VARCHAR)) AS h FROM reports))
    WHERE n = 1 AND h NOT IN (SELECT sha256(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) || '|' || CAST(id % 70 AS VARCHAR)) FROM reports WHERE id % 10 = 3)""", "reports"))  # fmt: skip
def x1(spark, sf):
    from tidewatch.functions.text import item_hash

    r = view(spark, sf, "reports").withColumns({"raw_hash": item_hash(F.col("title"), (F.col("id") % 70).cast("string")), "ord": F.col("id")})
    known = r.where("id % 10 = 3").select("raw_hash")
    return sinks.dedup(r, known, known.limit(0)).select("id", "raw_hash")


@query("j10_subscription_match", with_views("SELECT subscription_id, id, kind FROM (SELECT s.id AS subscription_id, r.id, s.kind FROM subscriptions s JOIN reports r ON s.kind = 'country' AND lower(trim(s.value)) = lower(r.country) UNION SELECT s.id, r.id, s.kind FROM subscriptions s JOIN reports r ON s.kind = 'adversary' AND lower(s.value) IN (lower(r.crowdstrike_adversary), lower(r.adversary_label)) UNION SELECT s.id, l.id, s.kind FROM subscriptions s JOIN report_labels l ON s.kind = 'label' AND (lower(s.value) = lower(l.name) OR starts_with(lower(l.name), lower(s.value) || '/')))", "reports", "report_labels", "subscriptions"))
def j10(spark, sf):
    return notify.matches(notifiable(spark, sf), view(spark, sf, "subscriptions")).select("subscription_id", "id", "kind")


def notifiable(spark, sf):
    labels = view(spark, sf, "report_labels").groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("labels"))
    return view(spark, sf, "reports").join(labels, "id", "left").withColumn("adversaries", F.array("crowdstrike_adversary", "adversary_label")).drop("kind")


NOTIFIED = """SELECT s.user_id, r.id, s.kind, CASE s.kind WHEN 'country' THEN r.country WHEN 'adversary' THEN CASE WHEN lower(trim(s.value)) = lower(trim(r.crowdstrike_adversary)) THEN r.crowdstrike_adversary ELSE r.adversary_label END ELSE (SELECT min(name) FROM report_labels l WHERE l.id = r.id AND (lower(l.name) = lower(trim(s.value)) OR starts_with(lower(l.name), lower(trim(s.value)) || '/'))) END AS reason
    FROM subscriptions s JOIN reports r ON CASE s.kind WHEN 'country' THEN lower(trim(s.value)) = lower(r.country) WHEN 'adversary' THEN coalesce(lower(trim(s.value)) = lower(trim(r.crowdstrike_adversary)), false) OR coalesce(lower(trim(s.value)) = lower(trim(r.adversary_label)), false) ELSE EXISTS (SELECT 1 FROM report_labels l WHERE l.id = r.id AND (lower(l.name) = lower(trim(s.value)) OR starts_with(lower(l.name), lower(trim(s.value)) || '/'))) END"""


@query("n8_queue", with_views(f"SELECT DISTINCT user_id, id, kind, reason FROM ({NOTIFIED}) WHERE id % 3 <> 0", "reports", "subscriptions", "report_labels"))
def n8(spark, sf):
    m = notify.matches(notifiable(spark, sf), view(spark, sf, "subscriptions")).withColumn("reason", F.col("matched"))
    return notify.queue(m, m.where("id % 3 = 0").select("user_id", "id", "kind", F.upper("reason").alias("reason")))


@query("n11_broadcast", with_views("SELECT u.user_id, 'poc:' || CAST(r.id AS VARCHAR) AS dedupe_key FROM (SELECT DISTINCT user_id FROM subscriptions) u, reports r WHERE r.kind = 'exploit' AND r.exploit_status = 'poc' AND r.id > 50", "reports", "subscriptions"))
def n11(spark, sf):
    poc = view(spark, sf, "reports").where("kind = 'exploit' and exploit_status = 'poc'")
    users = view(spark, sf, "subscriptions").select("user_id").distinct()
    old = notify.broadcast_rows(poc.where("id <= 50"), users, users.select("user_id", F.lit("").alias("dedupe_key")))
    return notify.broadcast_rows(poc, users, old).select("user_id", "dedupe_key")


@query("a17_options", with_views("SELECT DISTINCT kind, value FROM (SELECT 'adversary' AS kind, trim(crowdstrike_adversary) AS value FROM reports UNION ALL SELECT 'adversary', trim(adversary_label) FROM reports UNION ALL SELECT 'country', trim(country) FROM reports UNION ALL SELECT 'label', trim(name) FROM report_labels) WHERE value <> ''", "reports", "report_labels"))
def a17(spark, sf):
    return notify.options(view(spark, sf, "reports"), view(spark, sf, "report_labels"))


@query("a18_digest_groups", with_views("SELECT user_id, kind, value, n, reports, CAST(row_number() OVER (PARTITION BY user_id ORDER BY list_position(['label', 'adversary', 'country'], kind), value) AS INT) AS place FROM (SELECT id % 5 AS user_id, 'country' AS kind, country AS value, count(*) AS n FROM reports WHERE country IS NOT NULL GROUP BY 1, 3) JOIN (SELECT id % 5 AS user_id, count(DISTINCT title || '|' || url) AS reports FROM reports WHERE country IS NOT NULL GROUP BY 1) USING (user_id)", "reports"))
def a18(spark, sf):
    entries = view(spark, sf, "reports").where("country is not null").select((F.col("id") % 5).alias("user_id"), F.lit("country").alias("reason_kind"), F.col("country").alias("reason_value"), "title", "url", F.col("id").alias("ord"))
    return notify.digest_groups(entries)


@query("a20_memory", "SELECT kind, subject, content, CAST(mentions AS BIGINT) AS mentions FROM (SELECT 'trend' AS kind, arg_min(event_type, event_id) AS subject, 'c' || CAST(max(event_id) AS VARCHAR) AS content, 5 + count(*) AS mentions FROM events GROUP BY event_type)")
def a20(spark, sf):
    e = run(spark, sf, "SELECT * FROM {events}")
    old = e.groupBy("event_type").agg(F.min("event_id").alias("i")).select(F.lit("trend").alias("kind"), F.col("event_type").alias("subject"), F.lit("old").alias("content"), F.lit(5).alias("mentions"), F.lit(0).cast("long").alias("last_seen"))
    notes = e.select(F.lit("trend").alias("kind"), F.upper("event_type").alias("subject"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("content"), F.col("event_id").alias("ord"), F.col("event_id").alias("seen"))
    return views.memory_update(old, notes).select("kind", "subject", "content", F.col("mentions").cast("long").alias("mentions"))


@query("s15_upsert_iocs", with_views("SELECT value, coalesce(n, ioc_type) AS ioc_type FROM (SELECT value, min(ioc_type) AS ioc_type FROM iocs GROUP BY value) FULL JOIN (SELECT value, arg_max(t, ioc_id) AS n FROM (SELECT CASE WHEN ioc_id % 2 = 0 THEN value ELSE 'new' || value END AS value, 't' || CAST(ioc_id % 3 AS VARCHAR) AS t, ioc_id FROM iocs WHERE ioc_id % 6 < 3) GROUP BY value) USING (value)", "iocs"))
def s15(spark, sf):
    i = view(spark, sf, "iocs")
    table = i.groupBy("value").agg(F.min("ioc_type").alias("ioc_type")).withColumn("comment", F.lit("kept"))
    rows = i.where("ioc_id % 6 < 3").select(F.when(F.col("ioc_id") % 2 == 0, F.col("value")).otherwise(F.concat(F.lit("new"), "value")).alias("value"), F.concat(F.lit("t"), (F.col("ioc_id") % 3).cast("string")).alias("ioc_type"), F.col("ioc_id").alias("ord"))
    return sinks.upsert_iocs(table, rows).select("value", "ioc_type")


@query("s20_counters", with_views("SELECT source_id, posts_kept + CASE source_id WHEN 1 THEN 7 WHEN 3 THEN 1 ELSE 0 END AS posts_kept, posts_dropped + CASE source_id WHEN 1 THEN 3 ELSE 0 END AS posts_dropped FROM feeds", "feeds"))
def s20(spark, sf):
    stats = '[{"source_id":1,"kept":5,"dropped":2},{"source_id":3,"kept":1,"dropped":0},{"source_id":1,"kept":2,"dropped":1},{"source_id":999999,"kept":1,"dropped":1}]'
    return sinks.bump(view(spark, sf, "feeds"), F.lit(stats))


@query("i9_merge_names", with_views("SELECT DISTINCT id AS item_id, CASE WHEN upper(name) IN ('MALWAREANALYSIS', 'MALWARE') THEN 'Malware/General' ELSE name END AS name FROM report_labels", "report_labels"))
def i9(spark, sf):
    return sinks.merge_names(view(spark, sf, "report_labels").withColumnRenamed("id", "item_id"), ["malwareanalysis", "Malware"], "Malware/General")


LOWER_TEXT = "lower(concat_ws(chr(1), title, description, cve_id, target))"
SEARCHES = {
    "zimbra OR ivanti NOT label:AI/Claude": f"(contains({LOWER_TEXT}, 'zimbra') OR contains({LOWER_TEXT}, 'ivanti') AND NOT EXISTS (SELECT 1 FROM report_labels l WHERE l.id = r.id AND contains(lower(l.name), 'ai/claude')))",
    "label:Malware/* -adv:fancy": "EXISTS (SELECT 1 FROM report_labels l WHERE l.id = r.id AND regexp_matches(l.name, '(?i)^malware/.*$')) AND NOT coalesce(contains(lower(crowdstrike_adversary), 'fancy'), false) AND NOT coalesce(contains(lower(adversary_label), 'fancy'), false)",
    "src:src1 (cve:~2024-10[0-4] || adv:qilin)": "contains(source_name, 'src1') AND (coalesce(regexp_matches(cve_id, '(?i)2024-10[0-4]'), false) OR coalesce(contains(lower(adversary_label), 'qilin'), false) OR coalesce(contains(lower(crowdstrike_adversary), 'qilin'), false))",
}


def _search(number: int, text: str, test: str):
    @query(f"q_search_{number}", with_views(f"SELECT r.id, CASE WHEN kind IN ('research', 'other') THEN 'reports' WHEN kind = 'breach' THEN 'breaches' ELSE 'exploits' END AS section FROM reports r WHERE {test}", "reports", "report_labels"))
    def run_search(spark, sf):
        return search.search(text, view(spark, sf, "reports"), view(spark, sf, "report_labels"), spark.createDataFrame([], "id long, value string, ioc_type string")).select("id", "section")


for _i, (_text, _test) in enumerate(SEARCHES.items(), 1):
    _search(_i, _text, _test)

assert REPORTS
