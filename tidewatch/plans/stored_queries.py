"""Queries that go through stored tables and the index of keys, and those of the analyst's memory, new sources and typed walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import verdicts
from tidewatch.operators import network, views
from tidewatch.plans.adapters import braced, run, view, with_views
from tidewatch.plans.registry import query
from tidewatch.session import shared_path
from tidewatch.sources import feeds, stores
from tidewatch.sources.stores import KeyedTable, KeyIndex


def stored(spark, name: str, schema: str, *keys: str, buckets: int = 8) -> KeyedTable:
    """A new stored table in the shared folder."""
    return KeyedTable(spark, shared_path(spark, name), schema, *keys, buckets=buckets)


@query("s14_stored_insert", with_views("SELECT item_id, ioc_id FROM links WHERE item_id % 4 = 0 UNION ALL SELECT item_id, min(ioc_id) FROM links WHERE item_id % 4 <> 0 GROUP BY 1", "links"))
def s14_stored(spark, sf):
    """Twice the same insert: the second finds all keys there."""
    links = view(spark, sf, "links")
    table = stored(spark, "insert", "item_id long, ioc_id long", "item_id")
    table.replace(links.where("item_id % 4 = 0"))
    for _ in range(2):
        table.insert_absent(links, order="ioc_id")
    return table.read()


@query("s15_stored_upsert", with_views("SELECT value, coalesce(n, ioc_type) AS ioc_type, CASE WHEN ioc_type IS NOT NULL THEN 'kept' END AS comment FROM (SELECT value, min(ioc_type) AS ioc_type FROM iocs GROUP BY value) FULL JOIN (SELECT value, arg_max(t, ioc_id) AS n FROM (SELECT CASE WHEN ioc_id % 2 = 0 THEN value ELSE 'new' || value END AS value, 't' || CAST(ioc_id % 3 AS VARCHAR) AS t, ioc_id FROM iocs WHERE ioc_id % 6 < 3) GROUP BY value) USING (value)", "iocs"))
def s15_stored(spark, sf):
    i = view(spark, sf, "iocs")
    table = stored(spark, "iocs", "value string, ioc_type string, comment string", "value")
    table.upsert(i.groupBy("value").agg(F.min("ioc_type").alias("ioc_type")).withColumn("comment", F.lit("kept")))
    rows = i.where("ioc_id % 6 < 3").select(F.when(F.col("ioc_id") % 2 == 0, F.col("value")).otherwise(F.concat(F.lit("new"), "value")).alias("value"), F.concat(F.lit("t"), (F.col("ioc_id") % 3).cast("string")).alias("ioc_type"), F.col("ioc_id").alias("ord"))
    for _ in range(2):
        stores.upsert_iocs(table, rows)
    return table.read()


@query("s16_stored_sets", with_views("SELECT item_id, ioc_id FROM links WHERE item_id % 5 NOT IN (0, 1) UNION SELECT item_id, -1 FROM links WHERE item_id % 5 = 0", "links"))
def s16_stored(spark, sf):
    """Sets of some reports are replaced, those of others emptied."""
    links = view(spark, sf, "links")
    table = stored(spark, "links", "item_id long, ioc_id long", "item_id")
    table.replace(links)
    for _ in range(2):
        table.replace(links.where("item_id % 5 = 0").select("item_id", F.lit(-1).cast("long").alias("ioc_id")), owners=links.where("item_id % 5 = 1"))
    return table.read()


@query("s18_stored_unlink", with_views("SELECT 'ioc' AS what, NULL::BIGINT AS item_id, ioc_id FROM iocs WHERE ioc_id NOT IN (SELECT ioc_id FROM links) OR ioc_id IN (SELECT ioc_id FROM links WHERE item_id % 3 <> 0) UNION ALL SELECT 'link', item_id, ioc_id FROM links WHERE item_id % 3 <> 0", "links", "iocs"))
def s18_stored(spark, sf):
    links, iocs = stored(spark, "links", "item_id long, ioc_id long", "item_id"), stored(spark, "iocs", "ioc_id long, value string", "ioc_id")
    links.replace(view(spark, sf, "links"))
    iocs.upsert(view(spark, sf, "iocs").select("ioc_id", "value"))
    for _ in range(2):
        stores.unlink(links, iocs, view(spark, sf, "links").where("item_id % 3 = 0"))
    return links.read().select(F.lit("link").alias("what"), "item_id", "ioc_id").unionByName(iocs.read().select(F.lit("ioc").alias("what"), F.lit(None).cast("long").alias("item_id"), "ioc_id"))


@query("s19_stored_tombstones", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'deleted' WHEN doc_id % 3 = 1 THEN 'report' ELSE 'new' END AS state, doc_id % 3 = 1 AS stored FROM documents")
def s19_stored(spark, sf):
    """Two thirds of all reports are taken in, half of these deleted: what the index says of each when it comes again, and what is stored."""
    docs = run(spark, sf, "SELECT doc_id FROM {documents}").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("raw_hash"))
    path = shared_path(spark, "index")
    reports, index = KeyedTable(spark, f"{path}/reports", "raw_hash string, doc_id long", "raw_hash", buckets=8), KeyIndex(spark, f"{path}/keys", buckets=8, pages=4, most=0)
    taken = docs.where("doc_id % 3 <> 2")
    reports.upsert(taken)
    index.add(taken, "run-1")
    index.fold()  # half of what is looked up lies in the old part
    for _ in range(2):
        stores.delete_reports(reports, index, docs.where("doc_id % 3 = 0"), "deleted-1")
    known, gone, there = (df.select(F.col("raw_hash").alias(n)) for n, df in (("k", index.known(docs)), ("g", index.deleted()), ("r", reports.read())))
    j = docs.join(known, F.col("raw_hash") == F.col("k"), "left").join(gone, F.col("raw_hash") == F.col("g"), "left").join(there, F.col("raw_hash") == F.col("r"), "left")
    return j.select("doc_id", F.when(F.col("g").isNotNull(), "deleted").when(F.col("k").isNotNull(), "report").otherwise("new").alias("state"), F.col("r").isNotNull().alias("stored"))


@query("s24_stored_marks", with_views("SELECT id, user_id FROM (SELECT id, 1 AS user_id FROM reports WHERE id % 3 = 0 UNION SELECT id, 1 FROM reports WHERE id % 5 = 0) WHERE id % 7 <> 0", "reports"))
def s24_stored(spark, sf):
    r = view(spark, sf, "reports").select("id", F.lit(1).alias("user_id"))
    table = stored(spark, "marks", "id long, user_id int", "id", "user_id")
    for _ in range(2):
        table.upsert(r.where("id % 3 = 0"))
        table.upsert(r.where("id % 5 = 0"))
        table.delete(r.where("id % 7 = 0"))
    return table.read()


NOTES = "SELECT 'adversary' AS kind, p_brand AS subject, 'Né ' || p_type AS content, p_size AS mentions, p_partkey AS last_seen FROM part UNION ALL SELECT 'trend', p_type, p_name, p_size, p_partkey FROM part UNION ALL SELECT 'label', p_name, '', p_size, p_partkey FROM part"


def brief_sql(kind: str, order: str, most: int, line: str, between: str) -> str:
    return f"(SELECT string_agg({line}, {between} ORDER BY n) FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM notes WHERE kind = '{kind}') WHERE n <= {most})"


@query("a21_memory_text", f"""WITH notes AS ({NOTES}) SELECT substr(replace('Known adversaries:' || chr(10) || {brief_sql('adversary', 'last_seen DESC, mentions DESC, subject', 16, "'- ' || subject || ': ' || content", 'chr(10)')}
    || chr(10) || 'Tracked trends:' || chr(10) || {brief_sql('trend', 'last_seen DESC, mentions DESC, subject', 6, "'- ' || subject || ': ' || content", 'chr(10)')}
    || chr(10) || 'Known labels (reuse the exact label when it applies): ' || {brief_sql('label', 'mentions DESC, last_seen DESC, subject', 40, 'subject', "', '")}, 'é', 'e'), 1, 2600) AS brief""")
def a21_text(spark, sf):
    return views.memory_text(run(spark, sf, braced(NOTES)))


@query("n2_memory_notes", """WITH t AS (SELECT conv_id, turn, coalesce(regexp_replace(text, '[^ A-Za-z0-9]', '', 'g'), '') AS w FROM conversations)
    SELECT conv_id, turn, kind, subject, CAST(length(content) AS INT) AS length, md5(content) AS content FROM (
        SELECT conv_id, turn, 'adversary' AS kind, 'CREW ' || CAST(conv_id AS VARCHAR) AS subject, rtrim(substr(trim(regexp_replace(w || ' long', ' +', ' ', 'g')), 1, 1000)) AS content, turn % 3 <> 1 AS ok FROM t
        UNION ALL SELECT conv_id, turn, 'trend', 'rising', 'n' || CAST(turn AS VARCHAR), turn % 3 = 0 FROM t) WHERE ok""")
def n2_notes(spark, sf):
    """Notes in prose around each turn's words: whole ones, ones with a wrong list or a broken end, and entries that are none."""
    t = run(spark, sf, "SELECT conv_id, turn, text FROM {conversations}")
    word = F.coalesce(F.regexp_replace("text", "[^ A-Za-z0-9]", ""), F.lit(""))
    crew = F.concat(F.lit('Here: {"adversaries": [{"subject": " CREW '), F.col("conv_id").cast("string"), F.lit('", "content": "'), word, F.lit(' long"}, 7, {"subject": "", "content": "x"}, {"subject": "no content"}, {"subject": 5, "content": "x"}]'))
    trend = F.concat(F.lit(', "trends": [{"content": "n'), F.col("turn").cast("string"), F.lit('", "subject": "rising", "more": [1]}, null]} done'))
    said = F.when(F.col("turn") % 3 == 0, F.concat(crew, trend)).when(F.col("turn") % 3 == 1, F.concat(crew, F.lit(', "trends": [} '))).otherwise(F.concat(crew, F.lit(', "trends": "none"}')))
    rows = t.select("conv_id", "turn", F.inline(verdicts.notes(said)))
    return rows.select("conv_id", "turn", "kind", "subject", F.length(F.rtrim("content")).alias("length"), F.md5(F.rtrim("content")).alias("content"))


TAKEN = "SELECT 'site ' || CAST(s_suppkey % 20 AS STRING) || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE ' (' || CAST(2 + s_suppkey % 7 AS STRING) || ')' END AS name, '' AS feed_url, 'https://known' || CAST(s_suppkey AS STRING) || '.example/' AS url FROM supplier"
ARTICLES = "SELECT doc_id AS ord, 'https://' || CASE WHEN doc_id % 5 = 0 THEN 'known' || CAST(doc_id % 100 AS STRING) ELSE 'www.blog' || CAST(doc_id % 400 AS STRING) END || '.example/' || CAST(doc_id AS STRING) AS url, 'site ' || CAST(doc_id % 23 AS STRING) AS site_name FROM documents"


@query("j14_new_sources", f"""WITH taken AS (SELECT DISTINCT name, url FROM ({TAKEN})), a AS (SELECT ord, site_name, regexp_extract(url, '^https://[^/]*', 0) AS origin, regexp_replace(regexp_extract(url, '^https://([^/]*)', 1), '^www\\.', '') AS domain FROM ({ARTICLES})),
    fresh AS (SELECT domain, arg_min(site_name, ord) AS base, arg_min(origin, ord) AS url, min(ord) AS first FROM a WHERE domain NOT IN (SELECT regexp_extract(url, '^https://([^/]*)', 1) FROM taken) GROUP BY domain),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY first) AS k FROM fresh),
    slots AS (SELECT base, CASE WHEN n = 1 THEN base ELSE base || ' (' || CAST(n AS VARCHAR) || ')' END AS name, n FROM (SELECT base, unnest(range(1, CAST(count(*) AS BIGINT) + 12)) AS n FROM fresh GROUP BY base)),
    free AS (SELECT base, name, row_number() OVER (PARTITION BY base ORDER BY n) AS k FROM slots WHERE name NOT IN (SELECT name FROM taken))
    SELECT domain, free.name, url FROM ranked JOIN free USING (base, k)""")
def j14_new(spark, sf):
    """Blogs that no source has, many of one name, beside sources that hold some of its numbers."""
    return feeds.created(run(spark, sf, braced(ARTICLES)), run(spark, sf, braced(TAKEN)).distinct())


NODE = "CASE ioc_type WHEN 'cve' THEN 'cve:' || upper(value) WHEN 'mitre' THEN 'ttp:' || value ELSE 'ioc:' || value END"
NAMED = "coalesce(crowdstrike_adversary, adversary_label)"
GENERIC = "('PANDA', 'BEAR', 'CHOLLIMA', 'KITTEN', 'TIGER', 'WOLF', 'BUFFALO', 'LEOPARD', 'CRANE', 'BAT', 'SPIDER', 'JACKAL', '', 'UNKNOWN', 'UNID', 'UNATTRIBUTED', 'N/A')"
EDGES = f"""told AS (SELECT id, 'item:' || CAST(id AS VARCHAR) AS a, b, min(struct_pack(o0 := o0, o1 := o1, type := type, subtype := subtype)) AS r FROM (
        SELECT item_id AS id, {NODE} AS b, 0 AS o0, ioc_id AS o1, CASE ioc_type WHEN 'cve' THEN 'cve' WHEN 'mitre' THEN 'ttp' ELSE 'ioc' END AS type, ioc_type AS subtype FROM links JOIN iocs USING (ioc_id)
        UNION ALL SELECT id, 'cve:' || upper(cve_id), 1, 0, 'cve', NULL FROM reports WHERE cve_id <> '' UNION ALL SELECT id, 'adv:' || {NAMED}, 2, 0, 'adversary', NULL FROM reports WHERE upper(trim({NAMED})) NOT IN {GENERIC} AND NOT starts_with(upper({NAMED}), 'UNID ')) GROUP BY ALL),
    edges AS (SELECT a, b, r.type AS type, r.subtype AS subtype, r.o0 AS o0, r.o1 AS o1 FROM told UNION ALL
        SELECT t.b, t.a, 'item', NULL, coalesce(-date_diff('day', DATE '1970-01-01', s.published_at), 1099511627776), s.id FROM told t JOIN reports s ON s.id = t.id WHERE s.raw_hash NOT IN (SELECT raw_hash FROM hidden))"""


def walk_sql(root: str, levels: int, allowed: str, requests: int, new_nodes: int, told: int) -> str:
    """The same walk, level by level, as one query: each level's queue, what it may ask, whom it meets first."""
    parts = [EDGES, f"near AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY o0, o1, b) AS n FROM edges WHERE {allowed})", f"s0 AS (SELECT {root} AS node, 0 AS depth, 0::BIGINT AS place, false AS capped, 0::BIGINT AS asked)"]
    for d in range(1, levels + 1):
        before = f"s{d - 1}"
        parts += [
            f"q{d} AS (SELECT *, row_number() OVER (ORDER BY place) AS i FROM {before} WHERE depth = {d - 1} AND NOT (SELECT bool_or(capped) FROM {before}))",
            f"m{d} AS (SELECT b, min(struct_pack(place := q.place, n := e.n)) AS spot FROM q{d} q JOIN near e ON e.a = q.node AND e.n <= {told} WHERE q.i <= {requests} - (SELECT max(asked) FROM {before}) AND b NOT IN (SELECT node FROM {before}) GROUP BY b)",
            f"t{d} AS (SELECT q.place, q.i, coalesce(sum(c) OVER (ORDER BY q.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (SELECT count(*) FROM {before}) - 1 AS had FROM q{d} q LEFT JOIN (SELECT spot.place AS place, count(*) AS c FROM m{d} GROUP BY 1) USING (place))",
            f"o{d} AS (SELECT place FROM t{d} WHERE had < {new_nodes} AND i <= {requests} - (SELECT max(asked) FROM {before}))",
            f"s{d} AS (SELECT node, depth, place, (SELECT count(*) FROM o{d}) < (SELECT count(*) FROM q{d}) OR capped AS capped, asked + (SELECT count(*) FROM o{d}) AS asked FROM {before} UNION ALL SELECT b, {d}, row_number() OVER (ORDER BY spot.place, spot.n, b) + (SELECT count(*) FROM {before}) - 1, (SELECT count(*) FROM o{d}) < (SELECT count(*) FROM q{d}), (SELECT max(asked) FROM {before}) + (SELECT count(*) FROM o{d}) FROM m{d} WHERE spot.place IN (SELECT place FROM o{d}))",
        ]
    body = ", ".join(parts)
    return with_views(f"SELECT node, depth, place, (SELECT bool_or(capped) FROM s{levels}) AS capped FROM s{levels}", "reports", "links", "iocs", "hidden").replace(") SELECT node, depth, place, (SELECT", f"), {body} SELECT node, depth, place, (SELECT", 1)


def walked(spark, sf, root: str, depth: int, types, subtypes, **caps):
    v = lambda n: view(spark, sf, n)
    return network.walk(network.typed_edges(v("reports"), v("links"), v("iocs"), v("hidden")), root, depth, types, subtypes, **caps)


@query("g8_walk_capped", walk_sql("'item:34'", 4, "type IN ('item', 'cve', 'ttp', 'adversary') OR type = 'ioc' AND subtype = 'domain'", 20, 60, 10))
def g8_capped(spark, sf):
    """From a report through domains, techniques, CVEs and actors, with small caps."""
    return walked(spark, sf, "item:34", 4, ("ioc", "cve", "ttp", "adversary"), ["domain"], requests=20, new_nodes=60, told=10)


@query("g8_walk_cves", walk_sql("'cve:CVE-2024-1010'", 3, "type IN ('item', 'cve')", 300, 800, 40))
def g8_cves(spark, sf):
    """From a CVE through reports and CVEs alone, with the caps of the application."""
    return walked(spark, sf, "cve:CVE-2024-1010", 3, ("cve",), None)
