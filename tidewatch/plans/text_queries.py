"""Queries on texts, pages and the evaluation of golden cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import html, indicators, text, verdicts
from tidewatch.plans.adapters import run, view, with_views
from tidewatch.plans.registry import query

def ascii_sql(c: str) -> str:
    """Oracle SQL for to_ascii of a text column: entities twice, punctuation, accents, other signs dropped, white space squeezed."""
    out = f"coalesce({c}, '')"
    for _ in range(2):
        for name, plain in text.ENTITIES.items():
            if name != "amp":
                out = f"replace({out}, '&{name};', '{plain.replace(chr(39), chr(39) * 2)}')"
        out = f"replace({out}, '&amp;', '&')"
    for plain, signs in text.PUNCTUATION.items():
        out = f"regexp_replace({out}, '[{signs}]', '{plain.replace(chr(39), chr(39) * 2)}', 'g')"
    return f"trim(regexp_replace(regexp_replace(strip_accents({out}), '[^\\x09\\x0A\\x0D\\x20-\\x7E]', '', 'g'), '\\s+', ' ', 'g'))"


def without_sql(c: str, *elements: str) -> str:
    for e in elements:
        c = f"regexp_replace({c}, '(?is)<{e}\\b.*?</{e}\\s*>', ' ', 'g')"
    return c


T = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title || ' ' || coalesce(description, ''), '\\[\\.\\]|\\(\\.\\)|\\{\\.\\}|\\[dot\\]|\\(dot\\)', '.', 'gi'), '\\[://\\]', '://', 'g'), '\\[:\\]', ':', 'g'), '\\[/\\]', '/', 'g'), '\\bhxxp(s?)\\b', 'http\\1', 'gi')"
joined = lambda a: f"array_to_string(list_sort(list_distinct({a})), ',')"
words = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
EXCLUDED = "(^|\\.)(" + "|".join(d.replace(".", "\\.") for d in indicators.EXCLUDED_DOMAINS) + ")$"
NON_ROUTABLE = indicators.NON_ROUTABLE


@query("x2_refang", with_views(f"SELECT id, {T} AS plain FROM reports", "reports"))
def x2(spark, sf):
    return view(spark, sf, "reports").select("id", indicators.refang(F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))).alias("plain"))


IPV4 = indicators.IPV4


@query("x3_x7_indicators", with_views(f"""SELECT id, {joined("list_filter(list_transform(raw, lambda v: CASE WHEN regexp_full_match(v, '" + IPV4 + '/' + indicators.PREFIX_32 + "') THEN v ELSE string_split(v, '/')[1] END), lambda v: regexp_full_match(string_split(v, '/')[1], '" + IPV4 + "') AND NOT regexp_matches(v, '" + NON_ROUTABLE + "'))")} AS ips,
    {joined("list_filter(list_transform(names, lambda d: regexp_replace(lower(d), '^2f', '')), lambda d: NOT regexp_matches(d, '" + EXCLUDED + "') AND list_last(string_split(d, '.')) NOT IN " + words([*indicators.FILE_EXTENSIONS, *indicators.CODE_TAILS]) + " AND string_split(d, '.')[1] NOT IN " + words(indicators.CODE_HEADS) + ")")} AS domains,
    {joined("list_transform(hashes, lambda h: lower(h))")} AS files, {joined("list_transform(cves, lambda c: upper(c))")} AS cves, {joined("mitre")} AS mitre
    FROM (SELECT id, regexp_extract_all(regexp_replace(t, '(//(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}})/[0-9]{{1,3}}\\b', '\\1 ', 'g'), '\\b(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}(?:/[0-9]{{1,3}})?\\b') AS raw, regexp_extract_all(t, '(?i)\\b{indicators.DOMAIN}\\b') AS names,
        regexp_extract_all(t, '(?i)\\b{indicators.HASH}\\b') AS hashes, regexp_extract_all(t, '(?i)\\b{indicators.CVE}\\b') AS cves, regexp_extract_all(t, '\\b{indicators.TECHNIQUE}\\b') AS mitre FROM (SELECT id, {T} AS t FROM reports))""", "reports"))  # fmt: skip
def x7(spark, sf):
    r = view(spark, sf, "reports").select("id", indicators.indicators(F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))).alias("i"))
    return r.select("id", *(F.array_join(F.sort_array(f"i.{n}"), ",").alias(n) for n in ("ips", "domains", "files", "cves", "mitre")))


@query("x8_x9_valid_stored", with_views(f"""SELECT ioc_id, CASE WHEN ioc_id % 8 = 7 THEN false WHEN ioc_type = 'ip' THEN bad = 0 OR bad = 2 WHEN ioc_type = 'domain' THEN bad IN (0, 2, 3) WHEN ioc_type = 'cve' THEN bad = 0 ELSE bad IN (0, 3) END AS ok,
    CASE WHEN ioc_id % 8 = 7 THEN v WHEN ioc_type = 'domain' THEN lower(v) WHEN ioc_type IN ('cve', 'mitre') THEN upper(v) ELSE v END AS stored
    FROM (SELECT ioc_id, ioc_type, bad, CASE bad WHEN 0 THEN value WHEN 1 THEN CASE ioc_type WHEN 'cve' THEN 'CVE-24-1' ELSE 'no/' || value END WHEN 2 THEN CASE ioc_type WHEN 'ip' THEN value || '/24' WHEN 'domain' THEN upper(value) ELSE value || 'x' END ELSE CASE ioc_type WHEN 'ip' THEN value || '.7' WHEN 'cve' THEN value || '-1' WHEN 'mitre' THEN lower(value) || '.001' ELSE 'sub.' || value END END AS v
        FROM (SELECT *, CAST(ioc_id // 4 % 4 AS INT) AS bad FROM iocs))""", "iocs"))  # fmt: skip
def x8(spark, sf):
    """Values as they are, with a slash before them, longer, and longer still: each kind has valid and invalid ones; some of unknown kind."""
    v, kind, bad = F.col("value"), F.col("ioc_type"), F.floor(F.col("ioc_id") / 4) % 4
    one = F.when(kind == "cve", "CVE-24-1").otherwise(F.concat(F.lit("no/"), v))
    two = F.when(kind == "ip", F.concat(v, F.lit("/24"))).when(kind == "domain", F.upper(v)).otherwise(F.concat(v, F.lit("x")))
    three = F.when(kind == "ip", F.concat(v, F.lit(".7"))).when(kind == "cve", F.concat(v, F.lit("-1"))).when(kind == "mitre", F.concat(F.lower(v), F.lit(".001"))).otherwise(F.concat(F.lit("sub."), v))
    shown = F.when(bad == 0, v).when(bad == 1, one).when(bad == 2, two).otherwise(three)
    as_kind = F.when(F.col("ioc_id") % 8 == 7, "uri").otherwise(kind)
    return view(spark, sf, "iocs").select("ioc_id", indicators.valid(shown, as_kind).alias("ok"), indicators.stored(shown, as_kind).alias("stored"))


@query("x10_hosts", with_views("SELECT id, regexp_replace(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '^www\\.', '') AS host FROM reports", "reports"))
def x10(spark, sf):
    return view(spark, sf, "reports").select("id", indicators.host(F.col("url")).alias("host"))


@query("x18_to_ascii", f"SELECT doc_id, {ascii_sql('text')} AS plain FROM documents")
def x18(spark, sf):
    return run(spark, sf, "SELECT doc_id, text FROM {documents}").select("doc_id", text.to_ascii(F.col("text")).alias("plain"))


@query("x21_find_in_text", with_views("SELECT id, true AS hit FROM reports WHERE regexp_matches(title, '(?i)8\\.8\\.8(\\.|\\[\\.\\])8')", "reports"))
def x21(spark, sf):
    return view(spark, sf, "reports").where(F.col("title").rlike(indicators.find_pattern("8.8.8[.]8"))).select("id", F.lit(True).alias("hit"))


@query("x22_match_counts", """SELECT doc_id, CAST(len(hits) AS INT) AS n, regexp_replace(coalesce(text, ''), '(?i)the', '[\\0]', 'g') AS marked, CAST(CASE WHEN len(hits) > 0 THEN len(string_split(lower(text), 'the')[1]) END AS INT) AS first_start,
    CAST(CASE WHEN len(hits) > 0 THEN len(text) - len(string_split(lower(text), 'the')[-1]) END AS INT) AS last_end, CAST(CASE WHEN len(hits) > 0 THEN len(hits) - 1 ELSE 0 END AS INT) AS back, CAST(CASE WHEN len(hits) > 0 THEN 2 % len(hits) ELSE 0 END AS INT) AS ahead
    FROM (SELECT doc_id, text, regexp_extract_all(lower(text), 'the') AS hits FROM documents)""")  # fmt: skip
def x22(spark, sf):
    """Ranges, segments with the hits in brackets, and steps to the hit before the first and two after it."""
    pattern, t = indicators.find_pattern("the"), F.col("text")
    marked = F.array_join(F.transform(text.segments(t, pattern), lambda s: F.when(s["hit"], F.concat(F.lit("["), s["text"], F.lit("]"))).otherwise(s["text"])), "")
    d = run(spark, sf, "SELECT doc_id, text FROM {documents}").select("doc_id", text.match_ranges(t, pattern).alias("r"), marked.alias("marked"))
    n = F.size("r")
    return d.select("doc_id", n.alias("n"), "marked", F.get("r", F.lit(0))["start"].alias("first_start"), F.get("r", n - 1)["end"].alias("last_end"), text.step_hit(F.lit(0), n, F.lit(-1)).alias("back"), text.step_hit(F.lit(0), n, F.lit(2)).alias("ahead"))


@query("x27_labels", with_views("SELECT id, 'Malware/' || substr(array_to_string(list_transform(list_filter(regexp_split_to_array(title, '[^a-zA-Z0-9]+'), lambda p: p <> ''), lambda p: upper(substr(p, 1, 1)) || substr(p, 2)), ''), 1, 48) AS label FROM reports", "reports"))
def x27(spark, sf):
    return view(spark, sf, "reports").select("id", text.label("malware", F.col("title")).alias("label"))


@query("x28_label_edit", with_views("SELECT id, array_to_string([source_name, kind], '|') AS names FROM reports", "reports"))
def x28(spark, sf):
    csv = F.concat_ws(",", F.concat(F.lit("  "), "source_name"), "kind", F.upper("source_name"), F.lit(" "))
    return view(spark, sf, "reports").select("id", F.array_join(text.label_edit(csv), "|").alias("names"))


@query("x19_feed_dates", "SELECT o_orderkey, o_orderdate - INTERVAL 2 HOUR AS t FROM orders")
def x19(spark, sf):
    said = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" CEST"))
    return run(spark, sf, "SELECT o_orderkey, o_orderdate FROM {orders}").select("o_orderkey", text.feed_date(said).alias("t"))


@query("n6_citations", "SELECT conv_id, turn, array_to_string(list_filter([1, 2, 3, 30], lambda i: i = turn + 1 OR i = 30 AND turn % 3 = 0), ',') AS ids FROM conversations")
def n6(spark, sf):
    """Answers that cite their turn's number and sometimes 30, of which 1, 2, 3 and 30 are known; 3 is no part of [30]."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("] "), F.when(F.col("turn") % 3 == 0, "see [30]").otherwise("see 30"))
    ids = verdicts.cited(said, F.array(*map(F.lit, (1, 2, 3, 30))))
    return run(spark, sf, "SELECT conv_id, turn, text FROM {conversations}").select("conv_id", "turn", F.array_join(F.transform(ids, lambda n: n.cast("string")), ",").alias("ids"))


PARTS = "regexp_extract(html, '(?is)<article\\b.*?</article>')"
PAGE_FORMS = f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN replace(html, '<article', '<article><p>teaser</p></article><article') WHEN 2 THEN replace(html, '</body>', '<main>' || {PARTS} || ' and more</main></body>')
    WHEN 3 THEN replace(replace(html, '<article', '<div'), '</article>', '</div>') ELSE 'plain ' || CAST(page_id AS VARCHAR) END AS html FROM pages"""


def page_forms(spark, sf):
    """Pages with one article, a short one before it, a longer main behind it, a body only, and no markup at all."""
    parts, n = F.regexp_extract("html", r"(?is)<article\b.*?</article>", 0), F.col("page_id")
    main = F.replace(F.col("html"), F.lit("</body>"), F.concat(F.lit("<main>"), parts, F.lit(" and more</main></body>")))
    bare = F.replace(F.replace(F.col("html"), F.lit("<article"), F.lit("<div")), F.lit("</article>"), F.lit("</div>"))
    form = F.when(n % 5 == 0, F.col("html")).when(n % 5 == 1, F.replace(F.col("html"), F.lit("<article"), F.lit("<article><p>teaser</p></article><article"))).when(n % 5 == 2, main).when(n % 5 == 3, bare).otherwise(F.concat(F.lit("plain "), n.cast("string")))
    return run(spark, sf, "SELECT page_id, html FROM {pages}").select("page_id", form.alias("html"))


@query("s8_content_scope", f"""SELECT page_id, coalesce(CASE page_id % 5 WHEN 0 THEN nullif({PARTS}, '') WHEN 1 THEN coalesce(nullif(regexp_extract(replace(html, '<article><p>teaser</p></article>', ''), '(?is)<article\\b.*?</article>'), ''), nullif({PARTS}, ''))
    WHEN 2 THEN coalesce(nullif(regexp_extract(html, '(?is)<main\\b.*?</main>'), ''), nullif({PARTS}, '')) END, nullif(regexp_extract(html, '(?is)<body\\b.*?</body>'), ''), html) AS scope FROM ({PAGE_FORMS})""")
def s8(spark, sf):
    return page_forms(spark, sf).select("page_id", html.content(F.col("html")).alias("scope"))


ARTICLE = "coalesce(nullif(regexp_extract(html, '(?is)<article\\b.*?</article>'), ''), nullif(regexp_extract(html, '(?is)<body\\b.*?</body>'), ''), html)"
BODY = without_sql(ARTICLE, "script", "style", "noscript")
LINES = "regexp_replace(regexp_replace(" + without_sql(BODY, "header", "nav", "footer", "aside", "form") + ", '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</(p|div|section|article|h[1-6]|li|ul|ol|blockquote|tr|figcaption)>', chr(10), 'g')"


@query("s9_paragraphs", f"SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace({LINES}, '<[^>]+>', ' ', 'g'), chr(10)), lambda x: {ascii_sql('x')}), lambda x: x <> ''), chr(10)) AS body FROM pages")
def s9(spark, sf):
    return run(spark, sf, "SELECT page_id, html FROM {pages}").select("page_id", html.paragraphs(F.col("html")).alias("body"))


@query("s10_metadata", f"""SELECT page_id, nullif({ascii_sql("regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g')")}, '') AS title, CASE page_id % 4 WHEN 0 THEN 'About page ' || CAST(page_id AS VARCHAR) WHEN 1 THEN 'og ' || url END AS description,
    CASE page_id % 3 WHEN 0 THEN TIMESTAMP '2024-05-01 10:00:00' + INTERVAL 1 MINUTE * CAST(page_id % 50 AS INT) WHEN 1 THEN TIMESTAMP '2023-02-03 00:00:00' END AS published FROM pages""")
def s10(spark, sf):
    """Pages with a description under either key, an empty one first, or none; a date in the metadata, in a time element, or none."""
    n = F.col("page_id")
    about = F.when(n % 4 == 0, F.concat(F.lit('<meta name="Description" content=" About page '), n.cast("string"), F.lit(' ">'))).when(n % 4 == 1, F.concat(F.lit('<meta name="description" content="  "><META content=\'og '), "url", F.lit("' property=\"og:description\">"))).otherwise("")
    when = F.date_format(F.lit("2024-05-01 10:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (n % 50).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    said = F.when(n % 3 == 0, F.concat(F.lit('<meta property="article:published_time" content="'), when, F.lit('"><time datetime="2020-01-01">x</time>'))).when(n % 3 == 1, '<time class="t" datetime="2023-02-03">x</time>').otherwise("<time>none</time>")
    p = run(spark, sf, "SELECT page_id, url, html FROM {pages}").select("page_id", F.replace(F.col("html"), F.lit("</head>"), F.concat(about, said, F.lit("</head>"))).alias("html"))
    h = F.col("html")
    return p.select("page_id", html.title(h).alias("title"), html.meta(h, ["description", "og:description"]).alias("description"), html.published(h).alias("published"))


@query("s11_body_text", f"SELECT page_id, nullif({ascii_sql('regexp_replace(' + BODY + ', ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '') AS body FROM pages")
def s11(spark, sf):
    return run(spark, sf, "SELECT page_id, html FROM {pages}").select("page_id", html.body_text(F.col("html")).alias("body"))


# Hosts to try, each with whether a public address may have it.
HOSTS = {
    "LOCALHOST:8080": False, "a.localhost": False, "0.0.0.0": False, "127.0.0.1": False, "127.evil.com": False, "10.0.0.1": False, "10.evil.com": False, "192.168.1.9": False, "169.254.1.1": False, "172.16.0.1": False, "172.31.9.1": False,
    "172.15.0.1": True, "172.32.0.1": True, "172.160.0.1": True, "8.8.8.8": True, "printer.local": True, "db.internal": True, "0.1.2.3": True, "[::1]": True, "110.1.1.1": True, "xn--e1afmkfd.example": True,
}


@query("s12_public_urls", "SELECT page_id, 'own' AS host, true AS ok FROM pages UNION ALL SELECT page_id, 'ftp', false FROM pages UNION ALL SELECT page_id, 'none', false FROM pages UNION ALL SELECT page_id, h, ok FROM pages, (VALUES " + ", ".join(f"('{h}', {str(ok).lower()})" for h, ok in HOSTS.items()) + ") AS t(h, ok)")
def s12(spark, sf):
    """Each page's own URL, and its path with other schemes and every host of a list."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*(.*)$", 1)
    forms = {"own": F.col("url"), "ftp": F.concat(F.lit("ftp://a.example"), path), "none": F.concat(F.lit("no scheme "), "url")} | {h: F.concat(F.lit(f"http://{h}"), path) for h in HOSTS}
    rows = run(spark, sf, "SELECT page_id, url FROM {pages}").select("page_id", F.inline(F.array(*(F.struct(F.lit(h).alias("host"), u.alias("u")) for h, u in forms.items()))))
    return rows.select("page_id", "host", html.public_url(F.col("u")).alias("ok"))


#: Words of a page's heading and its first paragraph, without signs that markup or markdown would read otherwise.
ONLY = "trim(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
HEAD_SQL, PARA_SQL = ONLY.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)"), ONLY.format("regexp_extract(html, '(?s)</h1>(.*?)</p>', 1)")


def fragments(spark, sf):
    only = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9 ]", " "), " +", " "))
    return run(spark, sf, "SELECT page_id, html FROM {pages}").select("page_id", only(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("h"), only(F.regexp_extract("html", "(?s)</h1>(.*?)</p>", 1)).alias("p"), F.col("page_id").cast("string").alias("n"))


def told(*parts):
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


@query("x23_article_markdown", f"""SELECT page_id, trim('# H ' || h || chr(10) || chr(10) || 'P ' || CASE WHEN p = '' THEN '' ELSE p || ' ' END || '**bold** [link ' || n || '](https://e.example/a/' || n || ')' || chr(10) || chr(10) || '- one ' || n || chr(10) || '- two' || chr(10) || chr(10) || '![Chart ' || n || '](https://e.example/img/' || n || '.png)') AS markdown, '/i/' || n || '.png,data:x' AS dropped
    FROM (SELECT page_id, CAST(page_id AS VARCHAR) AS n, {HEAD_SQL} AS h, {PARA_SQL} AS p FROM pages)""")
def x23(spark, sf):
    """Articles with scripts, furniture, a list, a link, and three images of which one is the article's own."""
    f = fragments(spark, sf)
    h, p, n = F.col("h"), F.col("p"), F.col("n")
    page = told("<html><body><nav>menu ", n, "</nav><article><h1>H ", h, "</h1><script>x('", n, "')</script><p>P ", p, " <b>bold</b> <a href='/a/", n, "'>link ", n, "</a></p><ul><li>one ", n, "</li><li>two</li></ul><div class=\"ad-slot\"><p>Buy ", p, "</p></div><img src=\"/i/", n, ".png\" width=\"16\"><img src=\"data:x\"><img data-src=\"/img/", n, ".png\" alt=\"Chart [", n, "]\"><footer>foot</footer></article></body></html>")
    return f.select("page_id", html.markdown(page, F.lit("https://e.example/p/")).alias("m")).select("page_id", "m.markdown", F.array_join("m.dropped", ",").alias("dropped"))


@query("x24_copied_markdown", f"""SELECT page_id, trim('## H ' || h || chr(10) || chr(10) || 'P ' || CASE WHEN p = '' THEN '' ELSE p || ' ' END || '*quiet* [a ' || n || '](https://e.example/a/' || n || ') and b' || chr(10) || chr(10) || '1. one' || chr(10) || '2. two ' || n || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '![C ' || n || '](https://e.example/c.png)' || chr(10) || chr(10) || 'T & "' || n || '"') AS markdown, 'Shot ' || n AS dropped, page_id % 3 > 0 AS worth
    FROM (SELECT page_id, CAST(page_id AS VARCHAR) AS n, {HEAD_SQL} AS h, {PARA_SQL} AS p FROM pages)""")
def x24(spark, sf):
    """Markup copied by hand: emphasis, a link without a target, a numbered list, a rule, entities, empty wrappers, and an inlined image."""
    f = fragments(spark, sf)
    h, p, n = F.col("h"), F.col("p"), F.col("n")
    body = told("<style>.a{}</style><h2>H ", h, "</h2><div></div><p>P ", p, " <em>quiet</em> <a href=\"/a/", n, "\">a ", n, "</a> and <a>b</a></p><ol><li>one</li><li>two ", n, "</li></ol><hr><img src=\"data:image/png;base64,AA\" alt=\"Shot ", n, "\"><img src='/c.png' alt='C ", n, "'><div><p></p></div><ul><li></li></ul><p>T &amp; &quot;", n, "&quot;</p>")
    scrap = F.when(F.col("page_id") % 3 == 0, told("<span>", p, "</span>")).otherwise(body)
    return f.select("page_id", html.copied_markdown(body, F.lit("https://e.example/p/")).alias("m"), html.worth_converting(scrap).alias("worth")).select("page_id", "m.markdown", F.array_join("m.dropped", ",").alias("dropped"), "worth")


@query("x26_content_images", "SELECT page_id, page_id % 8 < 2 AS own FROM pages")
def x26(spark, sf):
    """One image a page: two kinds of the article's own; without address, a placeholder, an advert by text or address, small, and chrome by class."""
    f = fragments(spark, sf)
    n = F.col("n")
    forms = [told("<img src=\"/img/", n, ".jpg\" alt=\"Hero ", n, "\">"), told("<img data-src=\"https://cdn.example/", n, ".jpg\" width=\"900\">"), F.lit("<img src=\"\">"), told("<img src=\"${pick.", n, "}\">"), told("<img src=\"/", n, ".png\" alt=\"Sponsored content\">"), told("<img src=\"https://cdn.example/ads/", n, ".png\">"), told("<img src=\"/", n, ".png\" height=\"16\">"), told("<img src=\"/", n, ".jpg\" class=\"avatar photo\">")]
    page = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        page = F.when(F.col("page_id") % len(forms) == i, form).otherwise(page)
    return f.select("page_id", (F.size(html.markdown(told("<article><p>x</p>", page, "</article>"), F.lit("https://e.example/p/"))["dropped"]) == 0).alias("own"))
