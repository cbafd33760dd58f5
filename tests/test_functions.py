"""Golden cases of text functions, indicators and rules."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import html, indicators, rules, text, verdicts


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


CASES = [
    ("http://evil.example.com/beacon and 203.0.113.42 T1059.003 T1566", {"ips": ["203.0.113.42"], "domains": ["evil.example.com"], "mitre": ["T1059.003", "T1566"]}),
    ("cve-2026-1234 and CVE-2026-1234; also CVE-2025-98765. Not TCVE-2026-1.", {"cves": ["CVE-2026-1234", "CVE-2025-98765"]}),
    ("beacon to 8.8.8[.]8 via hxxps://bad[.]tld/x", {"ips": ["8.8.8.8"], "domains": ["bad.tld"]}),
    ("dropped mimikatz.dll; ignore 999.1.1.1", {"ips": [], "domains": []}),
    ("104.192.108.0/22 and 45.86.230.12", {"ips": ["104.192.108.0/22", "45.86.230.12"]}),
    ("http://45.86.230.12/24", {"ips": ["45.86.230.12"]}),
    ("45.86.230.12/33", {"ips": ["45.86.230.12"]}),
    ("10.0.0.0/8 and 10.1.2.3", {"ips": []}),
    ("https://discord.com/x https://hooks.slack.com https://github.com https://t.me/a", {"domains": ["discord.com", "hooks.slack.com", "github.com", "t.me"]}),
    ("https://bsky.app/x https://discord.gg https://join.slack.com https://open.spotify.com", {"domains": []}),
    ("%2Funit42.example 2funit42.example", {"domains": ["unit42.example"]}),
    (None, {"ips": [], "domains": [], "files": [], "cves": [], "mitre": []}),
]


def test_indicators(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", indicators.indicators(F.col("t")).alias("x")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert {k: got[i][k] for k in want} == want, CASES[i]
    more = value(spark, indicators.indicators(F.lit("own.blog.example at 8.8.8.8 and 9.9.9.9"), F.array(F.lit(" Blog.example ")), F.array(F.lit("9.9.9.9"))))
    assert more["domains"] == [] and more["ips"] == ["8.8.8.8"]


def test_filename_or_code(spark):
    yes = "sharer.php index.html config.json console.log window.fetch os.path console.info document.id".split()
    no = ["evil.com", "bad.in", "actor.md", "cdn.io", "php.example.com", "0x666.info", "actor.name", "payload.run", "", "php"]
    df = spark.createDataFrame([(v,) for v in yes + no], "v string")
    assert {r.v for r in df.where(indicators.filename_or_code(F.col("v"))).collect()} == set(yes)


def test_valid(spark):
    cases = [("1.2.3.4", "ip", 1), ("1.2.3.04", "ip", 0), ("1.2.3.0/24", "ip", 1), ("1.2.3.0/33", "ip", 0), ("::1", "ip", 1), ("2001:db8::1", "ip", 1), ("2001:db8::/32", "ip", 1), ("2001:db8::/129", "ip", 0), ("::ffff:1.2.3.4", "ip", 1), ("1:2:3:4:5:6:7:8", "ip", 1),
             ("1:2:3:4:5:6:7:8:9", "ip", 0), ("fe80::1::2", "ip", 0), ("a.example", "domain", 1), ("a", "domain", 0), ("-a.example", "domain", 0), ("D" * 32, "file_hash", 1), ("d" * 33, "file_hash", 0), ("CVE-2026-1234", "cve", 1), ("CVE-2026-123", "cve", 0), ("t1059.001", "mitre", 1), ("T1059.1", "mitre", 0), ("http://x", "uri", 0), ("1.2.3.4\n5", "ip", 0)]
    df = spark.createDataFrame(cases, "v string, k string, want int")
    assert df.where(indicators.valid(F.col("v"), F.col("k")) != (F.col("want") == 1)).collect() == []


@pytest.mark.parametrize(("query", "found", "missed"), [("evil.com", ["evil[.]com", "evil(.)com", "evil{.}com", "evil[dot]com", "EVIL(dot)com", "evil.com"], ["evilxcom"]), ("http://evil.com/a", ["hxxp://evil.com/a", "hxxp[://]evil.com/a", "hxxp[:]//evil.com/a", "http[://]evil.com/a"], ["http:evil.com/a"]), ("a@evil.com", ["a[@]evil[.]com"], []), ("185.220.101[.]4", ["185.220.101.4"], []), ("two words", ["two \n words"], ["twowords"])])
def test_find(spark, query, found, missed):
    df = spark.createDataFrame([(v,) for v in found + missed], "v string")
    assert {r.v for r in df.where(F.col("v").rlike(indicators.find_pattern(query))).collect()} == set(found)


def test_ascii(spark):
    cases = {"café &amp;#8211; “x”… &lt;b&gt;": 'cafe - "x"... <b>', "a ​b": "a b", "中文 ok": "ok", "&nbsp; &copy; 5 &euro; £9": "(c) 5 EUR GBP9", "Zürich—Ñu": "Zurich--Nu", "&#x41;&#66;": "AB", None: ""}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.a for r in df.select("v", text.to_ascii(F.col("v")).alias("a")).collect()} == cases
    assert value(spark, text.to_ascii(F.lit("a  b\n\n\n\nc \n d"), True)) == "a b\n\nc\nd"


def test_dates(spark):
    cases = {"Thu, 23 Jul 2026 09:13:03 CEST": "2026-07-23 07:13:03", "Thu, 23 Jul 2026 09:13:03 +0200": "2026-07-23 07:13:03", "2026-07-23T09:13:03Z": "2026-07-23 09:13:03", "Tuesday, April 21, 2026 05:50:00 PM CEST": "2026-04-21 15:50:00", "nonsense": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.t for r in df.select("v", text.feed_date(F.col("v")).cast("string").alias("t")).collect()} == cases


def test_rules(spark):
    df = spark.createDataFrame([("Volt Typhoon targets critical infrastructure", "china", "nation_state", "news"), ("CVE-2026-12345 actively exploited in the wild", None, None, "government"), ("Introducing our new managed detection webinar", None, None, "vendor"), ("LockBit affiliate hits a small firm", "other", "ecrime", "news"), ("LockBit tops this quarter's threat rankings", "other", "ecrime", "news"), ("Weekly security roundup", None, None, "news"), ("Hacktivists deface government portals", None, None, "news")], "t string, nexus string, m string, c string")
    got = df.select(rules.verdict(F.col("t"), F.lit("u"), F.lit(None).cast("string"), F.col("c"), F.col("nexus"), F.col("m")).alias("v"), rules.exploit_status(F.col("t"), F.col("c")).alias("s")).collect()
    assert [r.v.verdict for r in got] == ["keep", "keep", "drop", "keep", "drop", "unsure", "keep"] and got[0].v.item_type == "actor_activity" and got[1].v.item_type == "vuln" and got[1].s == "confirmed"
    reasons = {"missing title or URL": "incomplete", "marketing / product (pre-gate)": "marketing", "LLM: not intelligence": "not_intelligence", "screened out: x": "screened", "low-signal crew mention in a marketing round-up": "low_signal", "": "other", "LLM: a marketing piece": "screened"}
    df = spark.createDataFrame([(k,) for k in reasons], "r string")
    assert {r.r: r.c for r in df.select("r", rules.drop_kind(F.col("r")).alias("c")).collect()} == reasons
    names = {"FANCY BEAR": True, "Kitten": False, " spider ": False, "": False, "n/a": False, "UNID SPIDER": True}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r.n: r.s for r in df.select("n", rules.specific(F.col("n")).alias("s")).collect()} == names


def test_labels(spark):
    assert value(spark, text.label("malware", F.lit("Malware/Flying eagle v2"))) == "Malware/FlyingEagleV2"
    assert value(spark, text.label("ai", F.lit(" !! "))) is None
    assert value(spark, text.labels({"target": F.array(F.lit("a"), F.lit("A")), "ai": F.array(F.lit("x y"))})) == ["AI/XY", "Target/A"]
    assert value(spark, text.label_edit(F.lit("a, b  c,A,, B C"))) == ["a", "b c"]


def test_verdicts(spark):
    assert value(spark, verdicts.first_object(F.lit('x {"a": "}{", "b": {}} y {"c": 1}'))) == '{"a": "}{", "b": {}}'
    assert value(spark, verdicts.first_object(F.lit("none"))) is None
    assert value(spark, verdicts.longest_body(F.array(F.lit("a" * 600), F.lit("b")))).ok
    assert value(spark, verdicts.cited(F.lit("see [2] and [30]"), F.array(F.lit(2), F.lit(3), F.lit(30)))) == [2, 30]


PAGE = """<html><head><title>T &amp; U</title><meta name="description" content=" About "><meta property="article:published_time" content="2026-07-01T10:00:00Z"></head><body><nav>menu</nav>
<article>teaser</article><main><h2>Head</h2><p>First <b>bold</b> <a href="/x">link</a><br>line</p><script>bad()</script><ul><li>one<ul><li>deep</li></ul></li><li>two</li></ul><pre>a  b</pre>
<div class="share buttons">share me</div><img src="/big.png" alt="Chart" width="600"><img src="/logo.png" class="logo"><footer>foot</footer></main></body></html>"""


def test_html(spark):
    h = F.lit(PAGE)
    assert value(spark, html.content(h)).startswith("<main>")
    assert value(spark, html.title(h)) == "T & U" and value(spark, html.meta(h, ["description"])) == "About" and str(value(spark, html.published(h))) == "2026-07-01 10:00:00"
    body = value(spark, html.paragraphs(h)).split("\n")
    assert body[0] == "Head" and "line" in body and not any("foot" in x or "bad()" in x for x in body)
    md = value(spark, html.markdown(h, F.lit("https://e.example/p")))
    assert "## Head" in md.markdown and "**bold** [link](https://e.example/x)" in md.markdown and "\n- one\n  - deep" in md.markdown and "![Chart](https://e.example/big.png)" in md.markdown and "share me" not in md.markdown and md.dropped == ["/logo.png"]
    assert value(spark, html.plain(html.unwrap_images(F.lit("# A\n[![i](u)](v) [Go ![i](u)](v)")))) == "A Go"
    urls = {"https://a.example/": True, "ftp://a.example": False, "http://localhost/x": False, "http://192.168.1.4/": False, "http://172.20.0.1/": False, "http://8.8.8.8/": True, "junk": False}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.ok for r in df.select("u", html.public_url(F.col("u")).alias("ok")).collect()} == urls


def test_markdown_forms(spark):
    """Golden cases of copied markup and of article pages."""
    copied = {
        '<p>Infrastructure:</p><img src="https://vendor.example/i/c2.png" alt="C2 panel">': "Infrastructure:\n\n![C2 panel](https://vendor.example/i/c2.png)",
        "<ol><li>One</li><li>Two</li></ol>": "1. One\n2. Two",
        '<p>See <a href="https://vendor.example/x">the analysis</a> and <a>this</a>.</p>': "See [the analysis](https://vendor.example/x) and this.",
        "<style>.a{color:red}</style><script>alert(1)</script><p>Body text</p>": "Body text",
        "<figure><figcaption>Caption</figcaption></figure>": "Caption",
        "<p>Sandbox &amp; C2 &#8212; &quot;quoted&quot;</p>": 'Sandbox & C2 \u2014 "quoted"',
        "<div></div><div><p></p></div><p>Only line</p><div></div>": "Only line",
        "<h2>Findings</h2><ul><li>First</li><li>Second</li></ul><p><strong>Cobalt</strong> and <em>rundll32</em>.</p>": "## Findings\n\n- First\n- Second\n\n**Cobalt** and *rundll32*.",
        '<img src="data:image/png;base64,iVBORw0KGgo=" alt="Screenshot">': "",
    }
    df = spark.createDataFrame([(k,) for k in copied], "h string")
    got = {r.h: r.m for r in df.select("h", html.copied_markdown(F.col("h"), F.lit("https://vendor.example/blog/report")).alias("m")).collect()}
    assert {k: m.markdown for k, m in got.items()} == copied
    assert got['<img src="data:image/png;base64,iVBORw0KGgo=" alt="Screenshot">'].dropped == ["Screenshot"]
    worth = {"<span>plain</span>": False, "": False, "<p>Body</p>": True, '<img src="https://a.example/x.png">': True, None: False}
    df = spark.createDataFrame([(k,) for k in worth], "h string")
    assert {r.h: r.w for r in df.select("h", html.worth_converting(F.col("h")).alias("w")).collect()} == worth
    body = "Real reporting. " * 20
    page = f'<article><nav>Home</nav><p>{body}</p><div class="ad-slot"><p>Buy this</p></div><section id="related-stories"><p>More</p></section><div class="newsletter-signup"><p>Subscribe now</p></div><blockquote>Quoted line.</blockquote><aside>Also</aside></article>'
    md = value(spark, html.markdown(F.lit(page), F.lit("https://e.example/"))).markdown
    assert "Real reporting." in md and "> Quoted line." in md and not any(x in md for x in ("Buy", "More", "Subscribe", "Home", "Also"))


def test_paragraphs_keep_their_signs(spark):
    """Lines keep digits at their ends, whatever their number."""
    page = "<article>" + "".join(f"<p>{i} ends in {i}{i}00</p>" for i in range(12)) + "</article>"
    assert value(spark, html.paragraphs(F.lit(page))).split("\n") == [f"{i} ends in {i}{i}00" for i in range(12)]


def test_listing_dates(spark):
    cases = {
        "Tuesday, April 21, 2026 05:50:00 PM CEST": "2026-04-21 15:50:00", "Friday, February 13, 2026 04:45:00 PM CET": "2026-02-13 15:45:00", "Monday, June 01, 2026 12:00:00 AM CEST": "2026-05-31 22:00:00",
        "Monday, June 01, 2026 12:00:00 PM CEST": "2026-06-01 10:00:00", "April 21, 2026 05:50 PM CEST": "2026-04-21 15:50:00", "April 21, 2026 15:50:00": "2026-04-21 15:50:00", "April 21, 2026 15:50 XYZ": "2026-04-21 15:50:00",
        "April 31, 2026 01:00": "2026-05-01 01:00:00", "": None, "not a date": None, "Fooruary 21, 2026 05:50:00 PM CEST": None, "April 21, 2026 24:50": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.t for r in df.select("v", text.listing_date(F.col("v")).cast("string").alias("t")).collect()} == cases


def test_match_ranges(spark):
    pattern = indicators.find_pattern("evil.com")
    t = F.lit("at evil[.]com, EVIL.COM and evilcom")
    assert [tuple(r) for r in value(spark, text.match_ranges(t, pattern))] == [(3, 13), (15, 23)]
    assert [tuple(s) for s in value(spark, text.segments(t, pattern))] == [("at ", False), ("evil[.]com", True), (", ", False), ("EVIL.COM", True), (" and evilcom", False)]
    assert value(spark, text.match_ranges(t, "")) == [] and [tuple(s) for s in value(spark, text.segments(F.lit("x"), ""))] == [("x", False)] and value(spark, text.segments(F.lit(""), pattern)) == []
    assert [value(spark, text.step_hit(F.lit(a), F.lit(n), F.lit(d))) for a, n, d in ((0, 3, -1), (2, 3, 1), (1, 0, 1), (0, 3, 7))] == [2, 0, 0, 1]


def test_first_letters():
    from tidewatch.functions.patterns import first_letters

    assert first_letters(r"\b(webinar|introducing|\bacq)\b") == "aiw" and first_letters(r"CVE-[0-9]") == "c" and first_letters(r"x?(y|z+)") == "xyz"
    assert first_letters(r".*a") is None and first_letters(r"x*") is None and first_letters(r"(?<!a)[^b]") is None


# Titles with the answers that rules must give.
OFF_TOPIC_TITLES = [
    "5 High-Impact Use Cases for Falcon Onum", "CrowdStrike Joins the Open Secure AI Alliance to Advance AI Safety and Security", "CrowdStrike Falcon Platform Helps Meet U.S. Government Mandates for CISA BOD-26-04",
    "Real world incident response: Microsoft and AXA XL strengthen cyber resilience", "Preview: Cisco Talos at Black Hat USA 2026", "Pwn2Own Ireland 2026 - New Targets and Categories", "A week in security (July 20 - July 26)",
    "What's your data worth on the dark web? (Lock and Code S07E15)", "Don't get fooled by TikTok resin art scams", "Don't trust that \"FBI agent\" in your DMs", "AI nudify apps spark legal scrutiny of Apple and Google's profits",
]
RELEVANT_TITLES = [
    "New ClickLock Stealer locks your Mac until you hand over your password", "Sextortion scammers are exploiting ShinyHunters data leaks", "Russian State-Supported Cyber Actors Conduct Phishing Campaign Targeting Users of Zimbra Collaboration Suite",
    "Chaos ransomware's msaRAT: Living off the browser to build a covert C2 channel", "Johnson Controls C-CURE 9000 and Victor application server", "Paidwork breach exposes data of 23 million users: Check if you're affected",
    "Iran War Cyber Threat Landscape | A Midyear Assessment on What Matters", "Email threat landscape: Q2 2026 trends and insights", "Mirage Kitten targets Middle East and Africa region with new malware",
    "CISA, NSA, FBI and Partners Warn Zimbra Users of Russian State-Supported Activity", "State-sponsored hackers breach telecom providers", "Use cases for detecting CVE-2026-12345 exploitation",
]
CHEAP_TITLES = [
    "CVE-2026-1234: Remote code execution in Acme Widget", "Cisco Unified CM SQL injection (CVE-2026-20230)", "Multiple vulnerabilities in Ivanti Sentry", "2026-009: Critical Vulnerabilities in Microsoft SharePoint",
    "Oracle Critical Patch Update - July 2026", "August 2026 Patch Tuesday", "Security advisory for Apache Struts", "Vulnerability in Bearing Systems v2",
]
STANDARD_TITLES = [
    "Inside Kali365, a device code phishing campaign", "Fake Flash Player installs AtlasRAT", "North Korean hackers behind open-source supply chain attacks", "Ivanti vulnerability exploited by UNC5221 in the wild",
    "APT28 exploits CVE-2026-1234 against European targets", "TA505 linked to a new vulnerability campaign", "Quarterly threat landscape review", "",
]


def test_relevance_and_tiers(spark):
    titles = [(t, True) for t in RELEVANT_TITLES] + [(t, False) for t in OFF_TOPIC_TITLES]
    df = spark.createDataFrame(titles, "t string, want boolean")
    assert df.where(rules.relevant(F.col("t")) != F.col("want")).collect() == []
    df = spark.createDataFrame([(t, "cheap") for t in CHEAP_TITLES] + [(t, "standard") for t in STANDARD_TITLES], "t string, want string")
    assert df.where(rules.model_tier(F.col("t"), F.lit(False)) != F.col("want")).collect() == []
    assert value(spark, rules.model_tier(F.lit("Volt Typhoon exploits multiple vulnerabilities in edge devices"), F.lit(True))) == "standard"


def test_verdicts_of_titles(spark):
    rows = [
        ("LockBit mass campaign hits hundreds of organizations", "Widespread ransomware across multiple sectors.", "research", "other", "ecrime", "keep", "actor_activity"), ("LockBit's new loader dissected: a technical analysis", "A close look at the loader's obfuscation.", "research", "other", "ecrime", "keep", "actor_activity"),
        ("KillNet launches DDoS attacks against European banks", "The pro-Russia hacktivist collective claimed the campaign.", "news", "other", "hacktivism", "keep", "actor_activity"), ("SideWinder targets South Asian government networks", None, "research", "rest_of_world", "nation_state", "keep", "actor_activity"),
        ("Some ambiguous industry news item", None, "news", None, None, "unsure", None), ("Register now for our product webinar", None, "news", None, None, "drop", None), ("Introducing our new managed detection webinar", "Register now", "research", None, None, "drop", None),
        ("CVE-2026-12345 actively exploited in the wild", "Government advisory confirms exploitation.", "government", None, None, "keep", "vuln"), ("Data breach at a retailer", None, "vendor", None, None, "keep", "breach"), ("Widespread outages hit hospitals", None, "news", None, None, "keep", "breaking"), ("", "x", "news", None, None, "drop", None),
    ]
    df = spark.createDataFrame(rows, "t string, d string, c string, nexus string, m string, want string, kind string")
    got = df.select("t", "want", "kind", rules.verdict(F.col("t"), F.lit("u"), F.col("d"), F.col("c"), F.col("nexus"), F.col("m")).alias("v")).collect()
    assert [(r.t, r.v.verdict, r.v.item_type) for r in got] == [(r.t, r.want, r.kind) for r in got]
    assert value(spark, rules.adversary_label(F.lit(None).cast("string"), F.lit("rest_of_world"), F.lit("Indian APT campaign against neighbours"), F.lit(None).cast("string"))) == "UNID TIGER"
    kinds = [("report", True, None, "breach", "research"), ("report", False, None, "breach", "breach"), ("report", False, None, "exploit", "other"), ("report", False, "CVE-2026-1", "exploit", "exploit")]
    df = spark.createDataFrame(kinds, "k string, a boolean, cve string, choice string, want string")
    assert df.where(rules.report_kind(F.col("k"), F.col("a"), F.col("cve"), F.lit("Security report"), F.col("choice")) != F.col("want")).collect() == []


def test_indicators_among_other_text(spark):
    said = lambda t, *more: value(spark, indicators.indicators(F.lit(t), *more))
    i = said("The actor used T1059.003 and T1566 to drop payload.exe (sha1 da39a3ee5e6b4b0d3255bfef95601890afd80709). C2 at http://evil.example.com/beacon and 203.0.113.42, plus the domain updates.malwarehost.net.")
    assert i.ips == ["203.0.113.42"] and {"evil.example.com", "updates.malwarehost.net"} <= set(i.domains) and "payload.exe" not in i.domains and i.files == ["da39a3ee5e6b4b0d3255bfef95601890afd80709"] and sorted(i.mitre) == ["T1059.003", "T1566"]
    hashes = ["d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"]
    assert sorted(said(f"hashes: {' '.join(hashes)} for evil.dll").files) == sorted(hashes)
    assert said("payload beacons to updates[.]malwarehost[.]net").domains == ["updates.malwarehost.net"] and said("shows photo.jpeg, hero-image.png and index.html").domains == []
    assert said("The loader calls window.fetch and console.log, then exec.command and os.path before beaconing to updates.malwarehost.net").domains == ["updates.malwarehost.net"]
    listed = F.array(F.lit("securelist.com"))
    assert said("Follow us on twitter.com. Reported by securelist.com. C2 at updates.malwarehost.net and cdn.securelist.com/x.", listed).domains == ["updates.malwarehost.net"]
    assert said("https://not-thehackernews.com.evil.ru/x", F.array(F.lit("thehackernews.com"))).domains == ["not-thehackernews.com.evil.ru"]
    assert all(not v for v in said("A generic advisory with no indicators.").asDict().values())


def test_reconciled_claims(spark):
    pair = lambda k, v: F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"))
    claims = F.array(pair("domain", "EVIL[.]example"), pair("domain", "absent.example"), pair("ip", "10.0.0.1"), pair("ip", "::1"), pair("mitre", "t1059"))
    text_ = F.lit("at evil.example, 10.0.0.1 and T1059; ![x](https://cdn.example/a.png)")
    got = lambda *a, **k: sorted(f"{r.kind}:{r.value}" for r in value(spark, indicators.reconcile(*a, **k)))
    assert got(claims, text_) == ["domain:evil.example", "mitre:T1059"] and got(claims, text_, extract=False) == ["domain:evil.example", "mitre:T1059"]
    assert got(claims, F.lit(None).cast("string")) == ["domain:absent.example", "domain:evil.example", "mitre:T1059"]
