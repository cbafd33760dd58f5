"""Views with the shape of the reporting domain over the driver's tables.

Each is one SQL text that Spark and DuckDB read alike: integer arithmetic on keys picks titles, kinds and attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "DATE '2024-04-30'"

PHRASES = (
    "Volt Typhoon targets critical infrastructure", "CVE-2026-12345 actively exploited in the wild", "Introducing our new managed detection webinar", "LockBit affiliate hits a small firm",
    "LockBit tops the quarter rankings", "Weekly security roundup", "Hacktivists deface government portals", "KillNet claims outage", "Data breach at a retailer exposes records",
    "Analysis of a new loader used by FANCY BEAR", "Vendor joins forces with partner", "Podcast S07E15 on malware", "Proof-of-concept exploit code for CVE-2025-777 released",
    "Multiple vulnerabilities in Ivanti Sentry", "Indian operators use spyware", "Exploits lead the field", "Beacon to 8.8.8[.]8 via hxxps://bad[.]tld/x and T1059.003",
    "Range 104.192.108.0/22, host 45.86.230.12 and sharer.php on evil.example.com", "Acquisition news: merger talks", "Dark Halo returns with a backdoor",
    "Security advisory for TA505 tooling", "Hash d41d8cd98f00b204e9800998ecf8427e seen at 10.1.2.3", "Quiet day", "Ransomware attack on hospitals: widespread outages",
)


def pick(key: str, values, default: str = "NULL") -> str:
    """CASE over key modulo the number of values; None gives NULL."""
    arms = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} ELSE {default} END"


REPORTS = f"""
    SELECT doc_id AS id,
        {pick('doc_id', PHRASES)} || ' no ' || CAST(doc_id % 40 AS STRING) AS title,
        CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END AS description,
        'https://' || {pick('doc_id', ('www.alpha.example', 'news.beta.example', 'Gamma.example', 'blog.delta.example'))} || '/p/' || CAST(doc_id AS STRING) AS url,
        source AS source_name, 'h' || CAST(doc_id % 900 AS STRING) AS raw_hash,
        {pick('doc_id', ('research', 'breach', 'exploit', 'other', 'research', 'research'))} AS kind,
        {pick('doc_id', ('nation_state', 'ecrime', 'hacktivism', None, None))} AS motivation,
        {pick('doc_id', ('China', 'Russia', 'Iran', None, 'North Korea', 'India', 'Brazil'))} AS country,
        {pick('doc_id', ('poc', 'confirmed', 'suspected'))} AS exploit_status,
        CASE WHEN doc_id % 4 = 2 THEN 'CVE-2024-' || CAST(1000 + doc_id % 50 AS STRING) END AS cve_id,
        {pick('doc_id', ('FANCY BEAR', 'Spider', 'LockBit', None, None, None, None, None, None, None, None))} AS crowdstrike_adversary,
        {pick('doc_id', ('UNID KITTEN', 'Kitten', 'Qilin', None, None, None))} AS adversary_label,
        {pick('doc_id', ('Zimbra', None, 'Ivanti', None))} AS target,
        {pick('doc_id', ('news', 'government', 'vendor'))} AS category,
        CASE WHEN doc_id % 37 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id % 120 AS INT) END AS published_at,
        CAST(DATE '2024-01-01' + CAST(doc_id % 200 AS INT) AS TIMESTAMP) AS created_at
    FROM documents"""

LINKS = "SELECT DISTINCT l_orderkey AS item_id, l_partkey AS ioc_id FROM lineitem"
IOCS = f"SELECT p_partkey AS ioc_id, CASE p_partkey % 4 WHEN 0 THEN '45.' || CAST(p_partkey % 200 AS STRING) || '.1.' || CAST(p_partkey % 7 AS STRING) WHEN 1 THEN 'h' || CAST(p_partkey AS STRING) || {pick('p_partkey', ('.evil.example', '.twitter.com', '.bad.test'))} WHEN 2 THEN 'CVE-2024-' || CAST(1000 + p_partkey % 50 AS STRING) ELSE 'T' || CAST(1000 + p_partkey % 90 AS STRING) END AS value, {pick('p_partkey', ('ip', 'domain', 'cve', 'mitre'))} AS ioc_type FROM part"
LABELS = f"SELECT doc_id AS id, {pick('doc_id', ('Malware/BRICKSTORM', 'Target/Zimbra', 'AI/Claude', 'MalwareAnalysis', 'Malware/Loader/Small'))} AS name FROM documents UNION SELECT doc_id AS id, {pick('doc_id', ('Target/Zimbra', 'Vector/Phishing', 'Malware'))} AS name FROM documents"
HIDDEN = "SELECT DISTINCT 'h' || CAST(doc_id % 900 AS STRING) AS raw_hash FROM documents WHERE doc_id % 13 = 0"
SOURCES = "SELECT CAST(s_suppkey AS BIGINT) AS source_id, 'src' || CAST(s_suppkey AS STRING) AS name, s_suppkey % 10 <> 0 AS active, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'https://feed.example/' || CAST(s_suppkey AS STRING) END AS feed_url, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(s_suppkey % 120 AS INT) AS TIMESTAMP) END AS last_item_at, CASE WHEN s_suppkey % 8 = 0 THEN 'timeout' END AS last_error, s_suppkey * 3 AS posts_kept, s_suppkey % 11 AS posts_dropped FROM supplier"
# Subscriptions as (id, user_id, kind, value).
SUBSCRIPTIONS = "SELECT * FROM (VALUES (1, 10, 'label', 'malware'), (2, 10, 'label', 'Malware/BRICKSTORM'), (3, 11, 'adversary', 'fancy bear'), (4, 11, 'country', ' Iran '), (5, 12, 'label', 'Mal'), (6, 12, 'adversary', 'Qilin'), (7, 13, 'label', 'Malware/Loader'), (8, 13, 'country', 'Atlantis')) AS s(id, user_id, kind, value)"
# An actor catalogue; arrays are written as text with bars.
ACTORS = "SELECT * FROM (VALUES (1, 'FANCY BEAR', 'russia', 'nation_state', 'APT28|Sofacy', ''), (2, 'VANGUARD PANDA', 'china', 'nation_state', 'Volt Typhoon|Lead', ''), (3, 'BITWISE SPIDER', 'other', 'ecrime', 'LockBit', 'LockBit affiliate'), (4, 'KillNet', 'other', 'hacktivism', '', ''), (5, 'COZY BEAR', 'russia', 'nation_state', 'Dark Halo|Nobelium', ''), (6, 'RAZOR TIGER', 'rest_of_world', 'nation_state', 'SideWinder', '')) AS a(ord, name, nexus, motive, community, internal)"

VIEWS = {"reports": REPORTS, "links": LINKS, "iocs": IOCS, "report_labels": LABELS, "hidden": HIDDEN, "feeds": SOURCES, "subscriptions": SUBSCRIPTIONS, "actors": ACTORS}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Tables of texts, whose rows are dear to work on.
TEXTS = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its files are fewer: a small table is one file of one row group, which one task alone would work on.

    Large tables have many files; they are read as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the driver's tables, which are named in braces."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    used |= {t: spread(df) for t, df in used.items() if t in TEXTS}
    return spark.sql(sql, **used)


def braced(sql: str) -> str:
    import re

    return re.sub(r"\bFROM (" + "|".join(TABLES) + r")\b", r"FROM {\1}", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, braced(VIEWS[name]))


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    split = lambda c: F.filter(F.split(c, r"\|"), lambda v: v != "")
    return view(spark, sf_dir, "actors").select("ord", "name", "nexus", F.array("motive").alias("motivation"), split("community").alias("community_identifiers"), split("internal").alias("internal_alternative_names"))


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL behind the views it reads."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + sql
