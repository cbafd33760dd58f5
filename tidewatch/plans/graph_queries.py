"""Queries on the network of reports and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import network, views
from tidewatch.plans.adapters import view, with_views
from tidewatch.plans.registry import query
from tidewatch.sources import sinks

CAP = 25
USABLE = f"fan AS (SELECT ioc_id, count(*) AS n FROM links GROUP BY 1 HAVING count(*) >= 2), few AS (SELECT l.* FROM links l JOIN fan f ON l.ioc_id = f.ioc_id AND f.n <= {CAP})"
PAIRS = f"{USABLE}, pairs AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS weight FROM few x JOIN few y ON x.ioc_id = y.ioc_id AND x.item_id < y.item_id GROUP BY 1, 2)"
def behind(sql: str, *names: str) -> str:
    return with_views(sql, *names).replace(") ,", "),")


@query("a7_fan_out", behind(f", {USABLE} SELECT n AS fan_out, count(*) AS iocs FROM fan WHERE n <= {CAP} GROUP BY 1", "links"))
def a7(spark, sf):
    return network.usable(view(spark, sf, "links"), CAP)[0].groupBy("fan_out").agg(F.count("*").alias("iocs"))


@query("a7_dropped", behind(f", {USABLE} SELECT count(*) AS dropped FROM fan WHERE n > {CAP}", "links"))
def a7d(spark, sf):
    return network.usable(view(spark, sf, "links"), CAP)[1]


@query("g1_report_network", behind(f", {PAIRS} SELECT a, b, weight FROM pairs", "links"))
def g1(spark, sf):
    return network.pairs(view(spark, sf, "links"), CAP)


@query("g1_hidden_first", with_views("SELECT x.item_id AS a, y.item_id AS b, count(*) AS weight FROM v x JOIN v y ON x.ioc_id = y.ioc_id AND x.item_id < y.item_id WHERE x.ioc_id IN (SELECT ioc_id FROM v GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20) GROUP BY 1, 2", "links").replace(") SELECT x", "), v AS (SELECT * FROM links WHERE item_id % 3 <> 0) SELECT x"))
def g1h(spark, sf):
    links = view(spark, sf, "links")
    return network.pairs(links, 20, links.where("item_id % 3 = 0").select("item_id"))


@query("a9_reports_per_ioc", with_views("SELECT ioc_id, count(DISTINCT item_id) AS reports FROM links GROUP BY 1 HAVING count(DISTINCT item_id) > 1", "links"))
def a9(spark, sf):
    return view(spark, sf, "links").groupBy("ioc_id").agg(F.count_distinct("item_id").alias("reports")).where("reports > 1")


#: Rounds of minima over neighbours that the oracle unrolls; the network of a catalogue of parts is a few steps wide.
ROUNDS = 8
LABELS = "both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), l0 AS (SELECT DISTINCT a AS node, a AS c FROM both_ways), " + ", ".join(f"l{k} AS (SELECT w.a AS node, least(min(m.c), min(n.c)) AS c FROM both_ways w JOIN l{k - 1} m ON m.node = w.a JOIN l{k - 1} n ON n.node = w.b GROUP BY 1)" for k in range(1, ROUNDS + 1))


@query("g2_components", behind(f", {PAIRS}, {LABELS} SELECT node, c AS component FROM l{ROUNDS}", "links"))
def g2(spark, sf):
    return network.linked(view(spark, sf, "links"), CAP)


@query("g2_network_slice", behind(f", {PAIRS.replace('GROUP BY 1, 2)', 'GROUP BY 1, 2 HAVING count(*) >= 2)')}, {LABELS} SELECT min(CAST(node AS VARCHAR)) AS component, count(*) AS size, count(*) AS reports, 0 AS actors FROM l{ROUNDS} GROUP BY c", "links"))
def g2s(spark, sf):
    edges = network.pairs(view(spark, sf, "links"), CAP)
    kinds = view(spark, sf, "links").select(F.col("item_id").alias("id")).distinct().withColumn("kind", F.lit("research"))
    none = spark.createDataFrame([], "actor string, item string")
    return network.network_slice(edges, kinds, none, 2).select("component", "size", "reports", F.col("actors").cast("int").alias("actors"))


@query("g3_neighbours", with_views("SELECT a, b FROM (SELECT item_id AS a, ioc_id AS b, row_number() OVER (PARTITION BY item_id ORDER BY ioc_id) AS n FROM links WHERE item_id IN (1, 2, 33)) WHERE n <= 3", "links"))
def g3(spark, sf):
    edges = view(spark, sf, "links").select(F.col("item_id").alias("a"), (F.col("ioc_id") + 10**9).alias("b"))
    seeds = spark.range(1).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(33)).cast("array<long>")).alias("node"))
    return network.neighbours(edges, seeds, per_node=3).select("a", (F.col("b") - 10**9).alias("b"))


@query("g5_two_hops", with_views("SELECT count(*) AS n, depth FROM (SELECT DISTINCT ioc_id AS node, 1 AS depth FROM links WHERE item_id = 1 UNION ALL SELECT DISTINCT l.item_id, 2 FROM links l JOIN links k ON l.ioc_id = k.ioc_id WHERE k.item_id = 1 AND l.item_id <> 1) GROUP BY depth", "links"))
def g5(spark, sf):
    edges = view(spark, sf, "links").select(F.col("item_id").alias("a"), (F.col("ioc_id") + 10**9).alias("b"))
    seed = spark.range(1, 2).withColumnRenamed("id", "node")
    return network.two_hops(edges, seed, per_node=10**6, second=10**6).where("depth > 0").groupBy("depth").agg(F.count("*").alias("n"))


@query("g8_reach", behind(f", {PAIRS}, both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), r0 AS (SELECT min(a) AS node FROM both_ways), r1 AS (SELECT DISTINCT b AS node FROM both_ways WHERE a IN (SELECT node FROM r0)), r2 AS (SELECT DISTINCT b AS node FROM both_ways WHERE a IN (SELECT node FROM r1)) SELECT node, min(d) AS depth FROM (SELECT node, 0 AS d FROM r0 UNION ALL SELECT node, 1 FROM r1 UNION ALL SELECT node, 2 FROM r2) GROUP BY 1", "links"))
def g8(spark, sf):
    edges = network.pairs(view(spark, sf, "links"), CAP)
    return network.reach(edges, edges.agg(F.min("a").alias("node")), 2, most=10**9)


NAME = "coalesce(crowdstrike_adversary, adversary_label)"
GENERIC = "('PANDA', 'BEAR', 'CHOLLIMA', 'KITTEN', 'TIGER', 'WOLF', 'BUFFALO', 'LEOPARD', 'CRANE', 'BAT', 'SPIDER', 'JACKAL', '', 'UNKNOWN', 'UNID', 'UNATTRIBUTED', 'N/A')"


@query("a15_degrees", with_views(f"SELECT node, count(*) AS degree FROM (SELECT unnest([a, b]) AS node FROM (SELECT 'item:' || CAST(item_id AS VARCHAR) AS a, CASE WHEN ioc_type = 'cve' THEN 'cve:' || value ELSE 'ioc:' || value END AS b FROM links JOIN iocs USING (ioc_id) UNION SELECT 'item:' || CAST(id AS VARCHAR), 'cve:' || cve_id FROM reports WHERE cve_id IS NOT NULL UNION SELECT 'item:' || CAST(id AS VARCHAR), 'adv:' || {NAME} FROM reports WHERE upper(trim({NAME})) NOT IN {GENERIC})) GROUP BY 1", "links", "iocs", "reports"))
def a15(spark, sf):
    return network.degrees(view(spark, sf, "reports"), view(spark, sf, "links"), view(spark, sf, "iocs"))


@query("a16_actor_ties", with_views(f"SELECT actor, id AS item FROM (SELECT *, count(*) OVER (PARTITION BY actor) AS n FROM (SELECT id, trim({NAME}) AS actor FROM reports WHERE upper(trim({NAME})) NOT IN {GENERIC} AND NOT upper(trim({NAME})) LIKE 'UNID%')) WHERE n >= 2", "reports"))
def a16(spark, sf):
    r = view(spark, sf, "reports")
    return network.ties(r, r.select("id"))


@query("j11_shared_indicators", with_views("SELECT DISTINCT ioc_type, value FROM iocs WHERE ioc_id IN (SELECT ioc_id FROM links WHERE item_id = 1) AND ioc_id IN (SELECT ioc_id FROM links WHERE item_id <> 1)", "links", "iocs"))
def j11(spark, sf):
    links = view(spark, sf, "links")
    merged = links.withColumn("item_id", F.when(F.col("item_id") != 1, -1).otherwise(1)).distinct()  # the first report against all others
    return network.shared(merged, view(spark, sf, "iocs"), F.lit(1), F.lit(-1)).distinct()


@query("j12_ioc_lookup", with_views("SELECT t.term, h.id, CAST(h.place AS INT) AS place, coalesce(h.total, 0) AS total FROM (SELECT unnest(['45.4.1.4', 'CVE-2024-1002', 'nothing.example']) AS term) t LEFT JOIN (SELECT term, id, total, row_number() OVER (PARTITION BY term ORDER BY published_at DESC NULLS LAST, id) AS place FROM (SELECT *, count(*) OVER (PARTITION BY term) AS total FROM (SELECT DISTINCT value AS term, r.id, published_at FROM iocs JOIN links USING (ioc_id) JOIN reports r ON r.id = item_id WHERE value IN ('45.4.1.4', 'CVE-2024-1002')))) h ON h.term = t.term AND h.place <= 50", "links", "iocs", "reports"))
def j12(spark, sf):
    terms = spark.range(1).select(F.explode(F.array(*map(F.lit, ("45.4.1.4", "CVE-2024-1002", "nothing.example")))).alias("term"))
    return views.ioc_lookup(terms, view(spark, sf, "iocs"), view(spark, sf, "links"), view(spark, sf, "reports"))


@query("j13_reading_list", with_views("SELECT id, title FROM reports WHERE id % 17 = 0", "reports"))
def j13(spark, sf):
    marks = spark.range(0, 17 * 10**6, 17).select("id", (F.col("id") * 2).alias("bookmarked_at"))
    return views.reading_list(marks, view(spark, sf, "reports")).select("id", "title")


@query("j7_allowlist", with_views("SELECT ioc_id FROM iocs WHERE NOT (ioc_type = 'domain' AND regexp_matches(value, '(^|\\.)(bad\\.test|twitter\\.com)$')) AND NOT (ioc_type = 'ip' AND value = '45.4.1.4')", "iocs"))
def j7(spark, sf):
    from tidewatch.functions.indicators import not_allowed

    allow = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(v).alias("value"), F.lit(t).alias("ioc_type")) for v, t in (("bad.test", "domain"), (" Twitter.com", "domain"), ("45.4.1.4", "ip"))))))
    return not_allowed(view(spark, sf, "iocs"), allow).select("ioc_id")


@query("a10_review_candidates", with_views("SELECT ioc_id, reports FROM (SELECT i.ioc_id, i.value, count(DISTINCT item_id) AS reports FROM iocs i JOIN links USING (ioc_id) WHERE ioc_type IN ('ip', 'domain') AND i.ioc_id % 8 <> 0 AND NOT (ioc_type = 'domain' AND value LIKE '%.twitter.com') GROUP BY 1, 2 HAVING count(DISTINCT item_id) >= 2) ORDER BY reports DESC, value LIMIT 80", "iocs", "links"))
def a10(spark, sf):
    iocs = view(spark, sf, "iocs")
    allow = spark.range(1).select(F.lit("twitter.com").alias("value"), F.lit("domain").alias("ioc_type"))
    return views.candidates(iocs, view(spark, sf, "links"), iocs.where("ioc_id % 8 = 0"), allow).select("ioc_id", "reports")


@query("x31_edge_width", behind(f", {PAIRS} SELECT a, b, round(CASE WHEN m <= 1 THEN 1.0 ELSE 1 + sqrt(weight - 1) / sqrt(m - 1) * 7 END, 6) AS width FROM pairs, (SELECT max(weight) AS m FROM pairs)", "links"))
def x31(spark, sf):
    pairs = network.pairs(view(spark, sf, "links"), CAP)
    return pairs.select("a", "b", F.round(network.width(F.col("weight"), F.lit(pairs.agg(F.max("weight")).first()[0])), 6).alias("width"))


@query("x35_node_ids", with_views("SELECT ioc_id, CASE WHEN ioc_type = 'mitre' THEN 'ttp' WHEN ioc_type = 'cve' THEN 'cve' ELSE 'ioc' END || ':' || CASE WHEN ioc_type = 'cve' THEN upper(value) ELSE value END AS node FROM iocs", "iocs"))
def x35(spark, sf):
    return view(spark, sf, "iocs").select("ioc_id", network.node_id(F.col("ioc_type"), F.col("value")).alias("node"))


@query("g7b_has_more", with_views("SELECT node, degree, drawn FROM (SELECT item_id AS node, count(*) AS degree, count(*) FILTER (ioc_id % 2 = 0) AS drawn FROM links GROUP BY 1) WHERE degree > drawn AND drawn > 0", "links"))
def g7b(spark, sf):
    links = view(spark, sf, "links")
    drawn = links.where("ioc_id % 2 = 0").select(F.col("item_id").alias("a"), (-F.col("ioc_id") - 1).alias("b"))
    return network.has_more(drawn, links.groupBy(F.col("item_id").alias("node")).agg(F.count("*").alias("degree")))


@query("u3_merged_fragments", with_views("SELECT ioc_id AS id, CASE WHEN ioc_id % 2 = 0 THEN 'first' ELSE 'second' END AS src FROM iocs", "iocs"))
def u3(spark, sf):
    ids = view(spark, sf, "iocs").select(F.col("ioc_id").alias("id"))
    return network.merged(ids.where("id % 2 = 0").withColumn("src", F.lit("first")), ids.withColumn("src", F.lit("second")))


@query("s16_replace_sets", with_views("SELECT item_id, ioc_id FROM links WHERE item_id % 5 <> 0 UNION SELECT item_id, -1 FROM links WHERE item_id % 5 = 0", "links"))
def s16(spark, sf):
    links = view(spark, sf, "links")
    return sinks.replace_sets(links, links.where("item_id % 5 = 0").select("item_id", F.lit(-1).cast("long").alias("ioc_id")), "item_id")


@query("s18_unlink_orphans", with_views("SELECT 'ioc' AS what, NULL::BIGINT AS item_id, ioc_id FROM iocs WHERE ioc_id NOT IN (SELECT ioc_id FROM links) OR ioc_id IN (SELECT ioc_id FROM links WHERE item_id % 50 <> 0) UNION ALL SELECT 'link', item_id, ioc_id FROM links WHERE item_id % 50 <> 0", "links", "iocs"))
def s18(spark, sf):
    links = view(spark, sf, "links")
    left, kept = sinks.unlink(links, view(spark, sf, "iocs"), links.where("item_id % 50 = 0"))
    return left.select(F.lit("link").alias("what"), "item_id", "ioc_id").unionByName(kept.select(F.lit("ioc").alias("what"), F.lit(None).cast("long").alias("item_id"), "ioc_id"))


@query("s14_insert_absent", with_views("SELECT item_id, min(ioc_id) AS ioc_id FROM links WHERE item_id % 4 <> 0 GROUP BY 1", "links"))
def s14(spark, sf):
    links = view(spark, sf, "links")
    return sinks.insert_absent(links.where("item_id % 4 = 0"), links, "item_id", order="ioc_id")


def _expanded(node_sql: str, *rows: str) -> str:
    return with_views(f"SELECT DISTINCT {node_sql} AS a, b FROM (" + " UNION ALL ".join(rows) + ")", "reports", "links", "iocs", "hidden")


LINKED = "SELECT CASE ioc_type WHEN 'cve' THEN 'cve:' || upper(value) WHEN 'mitre' THEN 'ttp:' || value ELSE 'ioc:' || value END AS b, ioc_type FROM (SELECT * FROM links JOIN iocs USING (ioc_id) WHERE item_id = {0} ORDER BY ioc_id LIMIT 40)"
OPEN = "SELECT 'item:' || CAST(id AS VARCHAR) AS b FROM (SELECT id FROM reports WHERE {0} AND raw_hash NOT IN (SELECT raw_hash FROM hidden) ORDER BY published_at DESC NULLS LAST, id LIMIT 40)"


@query("g6_expand_item", _expanded("'item:34'", f"SELECT b FROM ({LINKED.format(34)}) WHERE ioc_type IN ('cve', 'domain')", "SELECT 'cve:' || cve_id FROM reports WHERE id = 34 AND cve_id IS NOT NULL"))
def g6_item(spark, sf):
    """A report's CVEs, and of its indicators the domains alone."""
    v = lambda n: view(spark, sf, n)
    return network.expand("item:34", v("reports"), v("links"), v("iocs"), v("hidden"), ("cve", "ioc"), ["domain"])


@query("g6_expand_report", _expanded("'item:22'", f"SELECT b FROM ({LINKED.format(22)})", "SELECT 'cve:' || cve_id FROM reports WHERE id = 22 AND cve_id IS NOT NULL", "SELECT 'adv:' || coalesce(crowdstrike_adversary, adversary_label) FROM reports WHERE id = 22 AND upper(coalesce(crowdstrike_adversary, adversary_label)) NOT IN ('SPIDER', 'KITTEN') AND coalesce(crowdstrike_adversary, adversary_label) NOT LIKE 'UNID%'"))
def g6_report(spark, sf):
    """All neighbours of a report: no types and no subtypes ask for everything."""
    v = lambda n: view(spark, sf, n)
    return network.expand("item:22", v("reports"), v("links"), v("iocs"), v("hidden"), (), [])


@query("g6_expand_actor", _expanded("'adv:FANCY BEAR'", OPEN.format("(crowdstrike_adversary = 'FANCY BEAR' OR adversary_label = 'FANCY BEAR')")))
def g6_actor(spark, sf):
    v = lambda n: view(spark, sf, n)
    return network.expand("adv:FANCY BEAR", v("reports"), v("links"), v("iocs"), v("hidden"), ("item",))


@query("g6_expand_cve", _expanded("'cve:CVE-2024-1018'", OPEN.format("(cve_id = 'CVE-2024-1018' OR id IN (SELECT item_id FROM links JOIN iocs USING (ioc_id) WHERE value = 'CVE-2024-1018'))")))
def g6_cve(spark, sf):
    v = lambda n: view(spark, sf, n)
    return network.expand("cve:CVE-2024-1018", v("reports"), v("links"), v("iocs"), v("hidden"))
