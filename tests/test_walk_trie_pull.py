"""Typed walks, the trie of aliases, feeds as a data source, new sources, notes and briefings."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import html, text, verdicts
from tidewatch.operators import attribution, network, notify, views
from tidewatch.sources import feeds, pull


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


EDGE = "a string, b string, type string, subtype string, rank struct<o0:long,o1:long>"


def brute_walk(edges, root, depth, types, subtypes, requests, new_nodes, told):
    near = {}
    for a, b, type_, subtype, rank in edges:
        if type_ in {*types, "item"} and (not subtypes or type_ != "ioc" or subtype in subtypes):
            near.setdefault(a, []).append((rank, b))
    met, frontier, asked, capped, level = {root: 0}, [root], 0, False, 0
    while frontier and level < depth:
        following = []
        for a in frontier:
            if asked >= requests or len(met) - 1 >= new_nodes:
                capped = True
                break
            asked += 1
            for _, b in sorted(near.get(a, []))[:told]:
                if b not in met:
                    met[b] = level + 1
                    following.append(b)
        if capped:
            break
        frontier, level = following, level + 1
    return [(n, d, i, capped) for i, (n, d) in enumerate(met.items())]


@pytest.mark.parametrize(("depth", "requests", "new_nodes", "told", "types"), [(1, 300, 800, 40, ("ioc", "cve")), (4, 300, 800, 40, ("ioc",)), (4, 7, 800, 40, ("ioc", "cve")), (6, 300, 11, 3, ("ioc", "cve", "ttp")), (3, 1, 1, 2, ("cve",))])
def test_walk(spark, depth, requests, new_nodes, told, types):
    r = random.Random(4)
    pairs = {(f"item:{r.randrange(30)}", r.choice([f"ioc:{i}" for i in range(25)] + [f"cve:{i}" for i in range(8)] + ["ttp:1"])) for _ in range(120)}
    kind = lambda n: n.partition(":")[0]
    sub = lambda n: ("domain" if int(n[4:]) % 2 else "ip") if n.startswith("ioc") else None
    edges = [e for a, b in pairs for e in ((a, b, kind(b), sub(b), (0, r.randrange(9))), (b, a, "item", None, (r.randrange(9), 0)))]
    df = spark.createDataFrame(edges, EDGE)
    for subtypes in (None, ["domain"]):
        got = network.walk(df, "item:1", depth, types, subtypes, requests, new_nodes, told)
        assert sorted(map(tuple, got.collect()), key=lambda x: x[2]) == brute_walk(edges, "item:1", depth, types, subtypes, requests, new_nodes, told)
    assert [tuple(x) for x in network.walk(df, "item:nobody", 3).collect()] == [("item:nobody", 0, 0, False)]


def test_trie_equals_array_and_join(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["apt", "the", "28"]
    names = {" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3]))) for _ in range(150)} | {"t.a+1", "(x) y", "apt-28", "apt 28", "w1 w2 w3 w4", "28", "w1-w2"}
    rows = [(a, r.choice(["china", "other"]), a.upper(), None, i) for i, a in enumerate(sorted(names))]
    groups = spark.createDataFrame(rows, "alias string, nexus string, cs string, motivation string, ord int")
    said = [" ".join(r.choice([*words, "T.A+1,", "(x) Y", "APT-28", "xw1", "w1  w2", "W1-w2", "кит"]) for _ in range(r.choice([0, 1, 2, 5, 30]))) for _ in range(300)] + [None, "", "w1 w2 w3 w4"]
    df = spark.createDataFrame(list(enumerate(said)), "id int, t string")
    trie, array = attribution.catalogue(groups, few=0), attribution.catalogue(groups, few=10**6)
    assert isinstance(trie, attribution.Trie) and not isinstance(array, attribution.Trie)
    get = lambda c: {(x.id, x.cs) for x in df.select("id", attribution.match(F.col("t"), c)["cs"].alias("cs")).where("cs is not null").collect()}
    assert get(trie) == get(array) == {(x.id, x.cs) for x in attribution.match_join(df, groups, "id", F.col("t")).collect()} and len(get(trie)) > 100
    body = lambda c: {(x.id, x.cs) for x in df.select("id", attribution.match_report(F.lit("x"), F.lit(None), c, F.col("t"))["cs"].alias("cs")).where("cs is not null").collect()}
    assert body(trie) == body(array)
    loose = spark.createDataFrame([("кит", "other", "KIT", None, 1)], "alias string, nexus string, cs string, motivation string, ord int")
    assert one(spark, attribution.match(F.lit("Это КИТ!"), attribution.catalogue(loose, few=0))["cs"]) == "KIT"


RSS = '<?xml version="1.0" encoding="utf-8"?><rss><channel><title>c</title>{}</channel></rss>'
ITEM = "<item><title>{0}</title><link>https://x.example/{0}</link><description>d</description><pubDate>Thu, 23 Jul 2026 09:13:03 GMT</pubDate></item>"


@pytest.fixture()
def listed(tmp_path):
    (tmp_path / "good.xml").write_text(RSS.format(ITEM.format("a") + ITEM.format("b")))
    (tmp_path / "atom.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>e</title><link>https://y.example/e</link><summary>s</summary><updated>2026-07-24T00:00:00Z</updated></entry></feed>')
    (tmp_path / "broken.xml").write_text("<rss><channel><item><title>half")
    return [{"name": n, "url": (tmp_path / f"{n}.xml").as_uri()} for n in ("good", "atom", "broken")]


def told(pulls):
    kept, errors, health = pull.accounts(pulls)
    return sorted((r.source_name, r.title) for r in kept.collect()), {r.source_name: r.error.split(":")[0] for r in errors.collect()}, {r.source_name: (r.items, str(r.latest_item_at)[:10], r.error is not None) for r in health.collect()}


WANT = [("atom", "e"), ("good", "a"), ("good", "b")], {"broken": "ParseError"}, {"good": (2, "2026-07-23", False), "atom": (1, "2026-07-24", False), "broken": (0, "None", True)}


def test_feeds_in_a_batch(spark, listed, tmp_path):
    spark.dataSource.register(pull.FeedSource)
    pulls = spark.read.format("threat_feeds").option("feeds", json.dumps(listed)).load()
    assert pulls.rdd.getNumPartitions() == 3 and told(pulls) == WANT
    (tmp_path / "page.xml").write_text("<html><body/></html>")
    more = [{"name": "page", "url": (tmp_path / "page.xml").as_uri()}, {"name": "gone", "url": (tmp_path / "gone.xml").as_uri()}, {"name": "empty", "url": (tmp_path / "empty.xml").as_uri()}]
    (tmp_path / "empty.xml").write_text(RSS.format(""))
    kept, errors, health = told(spark.read.format("threat_feeds").option("feeds", json.dumps(more)).load())
    assert kept == [] and errors == {"page": "ValueError", "gone": "URLError"} and health["empty"] == (0, "None", False)


def test_feeds_as_a_stream(spark, listed, tmp_path):
    spark.dataSource.register(pull.FeedSource)
    out, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def round_():
        stream = spark.readStream.format("threat_feeds").option("feeds", json.dumps(listed)).option("every", "1").load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(once=True).start().awaitTermination()

    round_()
    assert told(spark.read.parquet(out)) == WANT
    time.sleep(1.1)
    round_()  # goes on with the next round; the entries come again, the index of keys would know them
    assert spark.read.parquet(out).count() == 6


def test_new_sources(spark):
    sources = spark.createDataFrame([("Blog", "", "https://old.example"), ("Blog (2)", "", ""), ("Blog (4)", "", ""), ("X (2)", "", ""), ("blog", "", "")], "name string, feed_url string, url string")
    said = [("a.ex/1", "Blog"), ("www.a.ex/2", "Other"), ("b.ex/", "Blog"), ("c.ex/", "Blog"), ("old.example/p", "Blog"), ("d.ex/", "X"), ("e.ex/", "X"), ("f.ex", "Solo"), ("g.ex", "Solo (2)"), ("h.ex", "Solo")]
    articles = spark.createDataFrame([(i, f"https://{u}", n) for i, (u, n) in enumerate(said)], "ord int, url string, site_name string")
    got = {r.domain: (r.name, r.url) for r in feeds.created(articles, sources).collect()}
    assert {d: n for d, (n, _) in got.items()} == {"a.ex": "Blog (3)", "b.ex": "Blog (5)", "c.ex": "Blog (6)", "d.ex": "X", "e.ex": "X (3)", "f.ex": "Solo", "g.ex": "Solo (2)", "h.ex": "Solo (3)"}
    assert got["a.ex"][1] == "https://a.ex"


def test_guards(spark):
    url = lambda u: one(spark, html.public_url(F.lit(u)))
    assert [url(u) for u in ("http://127.evil.com/", "http://10.evil.com/", "http://a.localhost/", "https://printer.local/", "http://0.1.2.3/", "http://[::1]/", "http://172.160.0.1/")] == [False, False, False, True, True, True, True]
    pdf = lambda u, t: one(spark, html.is_pdf(F.lit(u), F.lit(t).cast("string"), F.lit(b"PK")))
    assert pdf("https://a/b", "application/x-pdf") and pdf("https://a/b", "binary; Application/PDF") and pdf("https://a/b.PDF?x=1", None) and pdf("no url.pdf#p", None) and not pdf("https://a/b.pdf.html", "text/html")
    assert one(spark, text.citations(F.lit("a [12345678901] [3][3] [99999999999999999999999] [x]"))) == [3]


def test_ascii_of_signs_that_become_several(spark):
    folded = lambda t: one(spark, text.to_ascii(F.lit(t)))
    # a sign is kept only if all it decomposes to is ASCII: one half has a fraction slash that is not
    assert folded("ﬁne ﬀ ½ Ａｂ㎏ ⒈ naïve ㏂ Ⅷ ﷺ 🙂 x") == "fine ff Abkg 1. naive a.m. VIII x"
    assert folded("plain & [a-b]") == "plain & [a-b]"


def test_notes_and_briefing(spark):
    said = {
        1: 'so {"adversaries": [{"subject": " A ", "content": "é x"}, {"subject": 5, "content": "n"}, "str", {"subject": "B"}, {"subject": "", "content": "c"}], "trends": [{"subject": "T", "content": "' + "y" * 1200 + '"}]} end',
        2: "{broken", 3: '{"adversaries": 3, "trends": null}', 4: None, 5: '[{"subject": "S", "content": "c"}]', 6: "no object",
    }
    rows = spark.createDataFrame(list(said.items()), "id int, t string").select("id", F.inline(verdicts.notes(F.col("t")))).collect()
    assert [(r.id, r.kind, r.subject, r.content) for r in rows] == [(1, "adversary", "A", "e x"), (1, "trend", "T", "y" * 1000)]
    memory = spark.createDataFrame([("adversary", "X", "old bear", 3, 5), ("adversary", "Y", "née", 1, 9), ("label", "L1", "L1", 2, 1), ("label", "L2", "L2", 7, 1)], "kind string, subject string, content string, mentions int, last_seen int")
    want = "Known adversaries:\n- Y: nee\n- X: old bear\nKnown labels (reuse the exact label when it applies): L2, L1"
    assert views.memory_text(memory).first().brief == want and views.memory_text(memory, 40).first().brief == want[:40] and views.memory_text(memory.limit(0)).first().brief == ""
    notes = spark.createDataFrame([(r.kind, r.subject, r.content, i, 10) for i, r in enumerate(rows)], "kind string, subject string, content string, ord int, seen int")
    assert {(r.kind, r.subject, r.mentions) for r in views.memory_update(memory, notes).collect()} >= {("adversary", "A", 1), ("trend", "T", 1), ("adversary", "X", 3)}


def test_run_messages(spark):
    schema = "run_id string, scoped boolean, summarised boolean, added int, flagged_iocs int, unclassified int, errors array<string>, stale_feeds int"
    rows = [("run-1", False, False, 12, 0, 3, [], None), ("run-2", True, True, 1, 2, 0, ["x" * 200, "y"], 1), ("run-3", False, None, None, None, None, None, None)]
    got = {(r.run_id, r.kind): (r.title, r.body, r.href) for r in notify.run_messages(spark.createDataFrame(rows, schema), 14).collect()}
    assert {k: v for k, v in got.items() if k[0] != "run-2"} == {
        ("run-1", "feeds_ingested"): ("All feeds ingested", "12 new reports added", "/"), ("run-3", "feeds_ingested"): ("All feeds ingested", "No new reports", "/"),
        ("run-1", "unclassified_reports"): ("3 reports stored unclassified", got["run-1", "unclassified_reports"][1], "/settings?tab=unclassified"),
    }
    assert got["run-2", "feed_ingested"] == ("Feed updated", "1 new report added", "/") and got["run-2", "ingest_errors"] == ("Ingest finished with 2 errors", "x" * 160, "/settings?tab=sources")
    assert got["run-2", "suspect_iocs"][0] == "2 suspect indicators to review" and got["run-2", "stale_feeds"] == ("1 feed look stale", "No items in the last 14 days, or failing to fetch.", "/settings?tab=sources")
    assert len(got) == 8
