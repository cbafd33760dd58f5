"""The search language: grammar, errors and evaluation on golden reports."""

import pytest

from tidewatch.operators import search

SCHEMA = "id long, title string, description string, source_name string, crowdstrike_adversary string, adversary_label string, cve_id string, target string, kind string, published_at date, raw_hash string"


@pytest.fixture(scope="module")
def one(spark):
    rows = spark.createDataFrame([(1, "Russian Hackers Exploit OWA Flaw", "Targets government mailboxes", "The Hacker News", None, "FANCY BEAR", None, None, "research", None, "h")], SCHEMA)
    labels = spark.createDataFrame([(1, n) for n in ("Malware/ZimReaper", "Target/Zimbra", "AI/Claude")], "id long, name string")
    iocs = spark.createDataFrame([(1, "91.108.106.229", "ip"), (1, "evil.example.ru", "domain"), (1, "d41d8cd98f00b204e9800998ecf8427e", "file_hash"), (1, "CVE-2026-42897", "cve"), (1, "T1059.001", "mitre"), (1, "http://x/", "uri")], "id long, value string, ioc_type string")
    return rows, labels, iocs


def test_terms(one):
    yes = ["russian", "label:zimbra", "adv:fancy", 'src:"hacker news"', "ip:91.108", "dom:example.ru", "hash:d41d8cd9", "cve:2026-42897", "ttp:T1059", "ioc:91.108.106.229", "ioc:evil.example.ru", "dom:evil[.]example[.]ru", "label:Zimbra -adv:COZY",
           "(adv:COZY OR adv:FANCY) label:Zimbra", r"dom:~\.(ru|su)$", r"ttp:~^T1059\.\d{3}$", "label:~^Malware/", "label:Malware/*", "NOT label:nothing", "russian && !label:none || x", "hackers exploit"]
    no = ["label:FANCY", "ip:evil.example.ru", "label:Zimbra adv:COZY", "label:Zimbra NOT adv:FANCY", r"dom:~\.(cn|kp)$", "label:~^Malware$", "label:Malware", "ioc:T1059.001", "label:Zim*", "dom:evil*.com", "text:a+b*"]
    docs = search.documents(one[0], set(search.FIELDS.values()), one[1], one[2])
    got = docs.select(*(search.compiled(search.parse(q)).alias(f"c{i}") for i, q in enumerate(yes + no))).first()
    assert [q for q, ok in zip(yes + no, got, strict=True) if ok] == [*yes, "label:Malware"]


@pytest.mark.parametrize(("query", "part"), [("", "Enter something"), ("label:", "needs a value"), ("(a OR b", "Unclosed bracket"), ("a OR b)", "Unbalanced closing bracket"), ('label:"unterminated', "Unclosed quote"), ("a AND", "ends with an operator"), ("dom:~(", "valid regular expression"), ("a" + "*" * 11, "wildcards"), ("text:~" + "a" * 201, "200 characters"), ("(AND a)", "Unexpected")])
def test_errors(query, part):
    with pytest.raises(search.SearchError, match=part.replace("(", r"\(")):
        search.parse(query)


def test_grammar():
    t = lambda v, f="text": search.Term(f, "contains", v)
    assert search.parse("a b OR c") == search.Node("or", (search.Node("and", (t("a"), t("b"))), t("c")))
    assert search.parse("https://evil.com") == t("https://evil.com") and search.parse("ratio:3") == t("ratio:3")
    # a quoted operator is an operator still, as a token does not remember its quotes; an empty quoted text is nothing
    assert search.parse('a "AND" b') == search.parse("a AND b") and search.parse('a "" b') == search.parse("a b") and search.parse('a "or" b') == search.parse("a OR b")
    assert search.parse('a "or" b') == search.Node("or", (t("a"), t("b")))  # operators count even in quotes
    assert search.parse(r'"a \"b\""') == t('a "b"') and search.parse("CVE-2026-1") == t("cve-2026-1") and search.parse("a - b") == search.Node("and", (t("a"), t("-"), t("b")))
    assert search.fields(search.parse("label:a (ip:1 OR -x)")) == {"label", "ip", "text"}


def test_sections_and_relevance(spark):
    rows = spark.createDataFrame([(1, "Zimbra zero-day", None, "s", None, None, None, None, "research", None, "a"), (2, "Zimbra webinar", None, "s", None, None, None, None, "other", None, "b"), (3, "Zimbra webinar", None, "s", None, None, None, None, "exploit", None, "c")], SCHEMA)
    assert {r.id: r.section for r in search.search("zimbra", rows).collect()} == {1: "reports", 3: "exploits"}
    assert {r.id for r in search.search("zimbra OR src:none", rows).collect()} == {1, 2, 3}
