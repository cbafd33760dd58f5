"""Golden cases of attribution, CVE priority, timeline, network, notifications, views, sinks, feeds and the stream."""

from datetime import date, datetime
from pathlib import Path
from time import sleep

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import attribution, cve, network, notify, views
from tidewatch.plans import ingest, registry
from tidewatch.session import checkpoint_dir
from tidewatch.sources import feeds, sinks
from tidewatch.streaming import ingest as stream

VULN = "ord int, cve_id string, exploit_status string, published_at date, created_at timestamp, adversary_label string, target string, description string, url string, source_name string, raw_hash string"


def vuln(ord, cve_id, status, day="2026-07-20", at="2026-07-20 00:00:00", target=None):
    return (ord, cve_id, status, date.fromisoformat(day), datetime.fromisoformat(at), None, target, None, None, None, f"h{ord}")


def test_cve_priority(spark):
    rows = [vuln(1, "CVE-2026-1", "poc"), vuln(2, "cve-2026-1 ", "confirmed"), vuln(3, "CVE-2026-2", "poc"), vuln(4, "CVE-2026-3", "confirmed"), vuln(5, "CVE-2026-4", "suspected"), vuln(6, " ", "poc"), vuln(7, "CVE-2026-5", "poc", "2026-07-01", target="old"), vuln(8, "CVE-2026-5", "suspected", "2026-07-22", target=None)]
    got = {r.cve_id.strip().upper(): r for r in cve.prioritised(spark.createDataFrame(rows, VULN)).collect()}
    assert {k: (r.priority, r.report_count) for k, r in got.items()} == {"CVE-2026-1": ("critical", 2), "CVE-2026-2": ("high", 1), "CVE-2026-3": ("medium", 1), "CVE-2026-5": ("high", 2)}
    assert got["CVE-2026-5"].target == "old" and got["CVE-2026-5"].added_at == date(2026, 7, 22) and got["CVE-2026-1"].cve_id == "CVE-2026-1"
    tie = [vuln(i, f"CVE-2026-{n}", "poc") for i, n in enumerate((9108, 53264, 20127))]
    assert [r.cve_id for r in cve.prioritised(spark.createDataFrame(tie, VULN)).orderBy(*cve.order()).collect()] == ["CVE-2026-53264", "CVE-2026-20127", "CVE-2026-9108"]


ACTOR = "ord int, name string, nexus string, motivation array<string>, community_identifiers array<string>, internal_alternative_names array<string>"


@pytest.fixture(scope="module")
def crews(spark):
    rows = [(1, "VANGUARD PANDA", "china", ["nation_state"], ["Volt Typhoon", "Lead"], None), (2, "BITWISE SPIDER", "other", ["ecrime"], ["LockBit"], []), (3, "KillNet", "other", ["hacktivism"], None, None), (4, None, "other", None, None, None), (5, "APT (X)", "iran", None, ["T.A+1"], None)]
    return attribution.aliases(spark.createDataFrame(rows, ACTOR))


def test_alias_match(spark, crews):
    texts = {1: "the lead researcher", 2: "Volt  Typhoon", 3: "volt typhoon, and LockBit", 4: "xLockBit", 5: "LockBit2", 6: "(lockbit)", 7: "by T.A+1!", 8: "TxA+1", 9: None}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    groups = attribution.catalogue(crews)
    want = {3: "VANGUARD PANDA", 6: "BITWISE SPIDER", 7: "APT (X)"}
    assert {r.id: r.cs for r in df.select("id", attribution.match(F.col("t"), groups)["cs"].alias("cs")).where("cs is not null").collect()} == want
    assert {r.id: r.cs for r in attribution.match_join(df, crews, "id", F.col("t")).collect()} == want


def test_timeline(spark, crews):
    schema = "id int, kind string, motivation string, crowdstrike_adversary string, adversary_label string, exploit_status string, title string, description string, published_at date"
    d = date(2026, 7, 1)
    rows = [(1, "research", "nation_state", "Kitten", "UNID KITTEN", None, "x", None, d), (2, "research", "nation_state", None, None, None, "x", None, d), (3, "research", "ecrime", None, None, None, "x", None, d), (4, "breach", None, None, None, None, "x", None, d), (5, "breach", None, None, None, None, "LockBit did", None, d), (6, "breach", None, None, None, None, "KillNet did", None, d),
            (7, "exploit", None, None, None, "poc", "x", None, d), (8, "exploit", None, None, None, "confirmed", "x", None, d), (9, "research", None, None, None, None, "nothing", None, d), (10, "breach", None, None, "Qilin", None, "LockBit did", None, d), (11, "research", "ecrime", None, None, None, "x", None, None)]
    by = lambda m: attribution.catalogue(crews.where(F.col("motivation") == m))
    events = attribution.events(spark.createDataFrame(rows, schema), by("ecrime"), by("hacktivism"))
    got = {r.id: (r.actor, r.category) for r in events.collect()}
    assert got == {1: ("UNID KITTEN", "nation_state"), 2: ("UNID BAT", "nation_state"), 3: ("UNID SPIDER", "ecrime"), 4: ("Breaches", "breach"), 5: ("BITWISE SPIDER", "ecrime"), 6: ("KillNet", "hacktivism"), 7: ("Exploits", "exploit"), 10: ("Qilin", "ecrime")}
    lanes = attribution.lanes(events).orderBy("place").collect()
    assert [r.category for r in lanes] == ["nation_state"] * 2 + ["ecrime"] * 3 + ["hacktivism", "breach", "exploit"] and [r.hue for r in lanes if r.hue is not None] == [0, 1, 2]


def test_network(spark):
    links = spark.createDataFrame([(1, 10), (2, 10), (1, 11), (2, 11), (3, 11), (4, 12)] + [(i, 13) for i in range(30)], "item_id long, ioc_id long")
    assert {(r.a, r.b, r.weight) for r in network.pairs(links, 25).collect()} == {(1, 2, 2), (1, 3, 1), (2, 3, 1)}
    assert network.usable(links, 25)[1].first().dropped == 1
    assert network.pairs(links, 25, spark.createDataFrame([(1,)], "item_id long")).collect()[0][:] == (2, 3, 1)


def test_network_slice(spark):
    edges = spark.createDataFrame([("a", "b", 9), ("b", "c", 4), ("d", "e", 2)], "a string, b string, weight int")
    kinds = spark.createDataFrame([(x, "research") for x in "abcde"], "id string, kind string")
    ties = spark.createDataFrame([("X", "a"), ("X", "d")], "actor string, item string")
    at = lambda t, k=kinds: [(r["size"], r.reports, r.actors) for r in network.network_slice(edges, k, ties, t).collect()]
    assert at(1) == [(6, 5, 1)] and at(3) == [(4, 3, 1)] and at(20) == []
    advisories = kinds.withColumn("kind", F.lit("exploit"))
    assert at(1, advisories) == []


def test_components_and_reach(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a long, b long")
    assert {(r.node, r.component) for r in network.components(path).collect()} == {(i, 0) for i in range(21)} | {(50, 50), (51, 50)}
    assert {(r.node, r.depth) for r in network.reach(path, spark.range(5, 6).withColumnRenamed("id", "node"), 2).collect()} == {(5, 0), (4, 1), (6, 1), (3, 2), (7, 2)}


def test_subscriptions(spark):
    reports = spark.createDataFrame([(1, ["Malware/BRICKSTORM", "Malware/X"], ["FANCY BEAR", None], "Iran"), (2, ["MalwareAnalysis"], [None, None], None), (3, ["Malware"], ["fancy"], "")], "id int, labels array<string>, adversaries array<string>, country string")
    subs = spark.createDataFrame([(1, 7, "label", " malware "), (2, 7, "label", "Malware/BRICKSTORM"), (3, 7, "label", "Mal"), (4, 8, "adversary", "fancy bear"), (5, 8, "country", "FANCY BEAR"), (6, 8, "label", ""), (7, 8, "country", "iran")], "id int, user_id int, kind string, value string")
    got = {(r.subscription_id, r.id): r.matched for r in notify.matches(reports, subs).collect()}
    assert got == {(1, 1): "Malware/BRICKSTORM", (1, 3): "Malware", (2, 1): "Malware/BRICKSTORM", (4, 1): "FANCY BEAR", (7, 1): "Iran"}


def test_linked(spark):
    """Null ids, ids that repeat, an indicator over the cap and a lone report draw no edges; the rest is as by pairs."""
    rows = [(i, 100 + i // 2) for i in range(12)] + [(i, 100 + (i + 1) // 2) for i in range(12)] + [(50 + i, 7) for i in range(30)] + [(50, 8), (57, 8), (70, 9), (None, 9), (None, 3), (71, 3), (72, 3), (73, None), (74, None), (75, 4), (75, 4)]
    links = spark.createDataFrame(rows, "item_id long, ioc_id long")
    want = {(r.node, r.component) for r in network.components(network.pairs(links, 25)).collect()}
    assert {(r.node, r.component) for r in network.linked(links, 25).collect()} == want == {(i, 0) for i in range(12)} | {(50, 50), (57, 50), (71, 71), (72, 71)}


def test_components_free_their_rounds(spark):
    """Of many rounds one table stays in the shared folder and no shuffle file."""
    folders = lambda: set(Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).iterdir())
    shuffled = lambda: {f for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}
    links = spark.range(60).selectExpr("id as item_id", "explode(array(id, id + 1)) as ioc_id").repartition(3)
    checkpoint_dir(spark)
    before, old = shuffled(), folders()
    found = network.components(network.pairs(links))
    for _ in range(50):  # they are removed by and by
        if not shuffled() - before:
            break
        sleep(0.2)
    assert not shuffled() - before
    assert [len(list(f.iterdir())) for f in folders() - old] == [1]
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(60)}


def test_dispatch_counts_its_own(spark, tmp_path):
    """Entry 3520 was sent by an earlier run, on the very day that this one marks its entries with."""
    docs = spark.range(3500, 3530).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit("src").alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.user_id: r.sent for r in registry.QUERIES["n9_dispatch"](spark, str(tmp_path)).collect()}
    assert got == {u: sum(i % 7 == u and i != 3520 for i in range(3500, 3530)) for u in range(7)}


def test_small_views(spark):
    v = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert v(views.keep_rate(F.lit(0), F.lit(0))) is None
    assert v(views.keep_rate(F.lit(1), F.lit(2))).percent == 33 and v(views.keep_rate(F.lit(80), F.lit(20))).percent == 80 and v(views.keep_rate(F.lit(3), F.lit(2))).alpha == 1
    rows = spark.range(23)
    page = lambda n, s: views.page(rows, n, s, F.col("id")).collect()
    assert len(page(2, 10)) == 10 and len(page(3, 10)) == 3 and page(9, 10) == [] and [r.id for r in page(-1, 10)] == list(range(10)) and len(page(1, None)) == 23 and [r.id for r in page(float("nan"), 5)] == [0, 1, 2, 3, 4] and page(2, 10)[0].total == 23
    assert [r.v for r in spark.createDataFrame([(0,), (-30,), (5000,), (45,), (None,), (365,)], "d int").select(views.snapped(F.col("d")).alias("v")).collect()] == [90, 90, 90, 90, 90, 365]
    assert v(network.width(F.lit(544), F.lit(544))) == 8 and v(network.width(F.lit(1), F.lit(544))) == 1 and v(network.width(F.lit(3), F.lit(1))) == 1


def test_sinks(spark):
    t = spark.createDataFrame([("a", "ip", "keep")], "value string, ioc_type string, comment string")
    new = spark.createDataFrame([("a", "domain", 1), ("a", "uri", 2), ("b", "ip", 3)], "value string, ioc_type string, ord int")
    assert {tuple(r) for r in sinks.upsert_iocs(t, new).collect()} == {("a", "uri", "keep"), ("b", "ip", None)}
    names = spark.createDataFrame([("1", "Malware/X")], "id string, name string")
    made = sinks.find_or_create(names, spark.createDataFrame([("malware/x", 1), ("Y", 2), ("y ", 3), ("", 4)], "name string, ord int"))
    assert {r.name for r in made.collect()} == {"Malware/X", "Y"}
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "item_id int, ioc_id int")
    left, iocs = sinks.unlink(links, spark.createDataFrame([(1,), (2,), (3,)], "ioc_id int"), spark.createDataFrame([(1, 1), (1, 2)], "item_id int, ioc_id int"))
    assert left.count() == 1 and {r.ioc_id for r in iocs.collect()} == {2, 3}
    assert spark.range(1).select(feeds.fresh_name(F.lit("Blog"), F.array(F.lit("Blog"), F.lit("Blog (2)")))).first()[0] == "Blog (3)"


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A &amp; B</title><link> https://x.example/1 </link><description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>Thu, 23 Jul 2026 09:13:03 CEST</pubDate></item><item><title>no link</title></item></channel></rss>")
    rows = feeds.rss(spark, str(tmp_path / "f.xml"), "s").collect()
    assert [(r.title, r.url, r.description, str(r.published_at)) for r in rows] == [("A & B", "https://x.example/1", "Hi", "2026-07-23 07:13:03")]


def test_stream(spark, tmp_path, crews):
    schema = "title string, url string, description string, category string, source_name string, published_at date, seen_at timestamp"
    at = datetime(2026, 7, 1)
    rows = [("Volt Typhoon again", "u1", "at evil[.]example", "news", "s", date(2026, 7, 1), at), ("volt  typhoon AGAIN ", "U1", None, "news", "s", date(2026, 7, 1), at), ("Our webinar", "u2", None, "vendor", "s", date(2026, 7, 1), at)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    groups = attribution.catalogue(crews)
    start = lambda: stream.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), groups, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name)).collect()
    for _ in range(2):  # a second start finds nothing new
        start()
    assert [(r.kind, r.crowdstrike_adversary, r.country) for r in read("reports")] == [("research", "VANGUARD PANDA", "China")]
    assert [(r.reason, r.classified_by) for r in read("dropped")] == [("marketing / product", "rules")]
    assert [(r.ioc_type, r.value) for r in read("links")] == [("domain", "evil.example")]
    assert [(r.source_name, r.kept, r.dropped) for r in read("tally")] == [("s", 1, 1)]
    more = [("Volt Typhoon again", "u1", None, "news", "s", date(2026, 7, 1), datetime(2026, 7, 20)), ("Volt Typhoon once more", "u9", None, "news", "s", date(2026, 7, 1), datetime(2026, 7, 20))]
    spark.createDataFrame(more, schema).write.mode("append").parquet(str(tmp_path / "in"))
    start()  # what earlier batches brought is known, also beyond the watermark
    assert sorted(r.title for r in read("reports")) == ["Volt Typhoon again", "Volt Typhoon once more"]


def test_ingest_links(spark, crews):
    c = spark.createDataFrame([(1, "LockBit attack at evil[.]example", "u", "see T1059", "news", "s")], "ord int, title string, url string, description string, category string, source_name string")
    none = spark.createDataFrame([], "raw_hash string")
    out = ingest.run(c, none, none, attribution.catalogue(crews))
    assert {(r.ioc_type, r.value) for r in out["links"].collect()} == {("domain", "evil.example"), ("mitre", "T1059")}
