"""Pages to text: main content, paragraphs, metadata, links and markdown. Column expressions unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.patterns import let
from tidewatch.functions.text import to_ascii

# Elements without prose, and words that mark a container as page furniture.
NEVER_PROSE = "script style noscript iframe svg form button select textarea canvas template video audio nav aside footer header".split()
FURNITURE = (
    "ad ads advert advertisement sponsor sponsored promo promotion newsletter subscribe signup related recirc recommended trending share social comment comments cookie consent paywall popup modal "
    "breadcrumb byline-social taboola outbrain logo masthead branding menu sidebar widget author byline bio profile expert popular footer toolbar entry-meta post-meta tags"
).split()
IMAGE_CHROME = "avatar gravatar logo icon thumb thumbnail emoji profile headshot badge pixel spacer placeholder".split()
DATE_KEYS = "article:published_time article:published og:article:published_time datepublished date dc.date dc.date.issued parsely-pub-date sailthru.date".split()


def without(html: Column, *elements: str) -> Column:
    """html with these elements and all in them replaced by a space; texts that have none of them stay as they are."""
    names = "|".join(elements)
    return let(html, lambda h: F.when(h.rlike(rf"<(?i:{names})\b"), F.regexp_replace(h, rf"(?is)<({names})\b.*?</\1\s*>", " ")).otherwise(h))


def visible(html: Column) -> Column:
    """Text between tags, squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(without(html, "script", "style", "noscript"), "<[^>]+>", " "), r"\s+", " "))


def content(html: Column) -> Column:
    """Of all articles and mains the one with the longest text (the first of equals), else the body, else everything."""
    found = F.concat(*(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b.*?</{tag}>"), F.lit(0)) for tag in ("article", "main")))
    rest = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<body\b.*?</body>", 0), F.lit("")), html)

    def longest(found: Column) -> Column:
        sized = F.transform(found, lambda c, i: F.struct(F.length(visible(c)).alias("n"), (-i).alias("i"), c.alias("html")))
        return F.array_max(F.filter(sized, lambda s: s["n"] > 0))["html"]

    # a lone article is measured only if a glance at it finds no letter behind a tag
    lone = lambda f: (F.size(f) == 1) & F.get(f, F.lit(0)).rlike(r"<(?:p|h[1-6]|li|div|article)\b[^>]*>\s*[^<\s]")
    return F.coalesce(let(found, lambda f: F.when(lone(f), F.get(f, F.lit(0))).otherwise(longest(f))), rest)


def body_text(html: Column) -> Column:
    """The article's text in ASCII on one line; null if there is none."""
    return F.nullif(to_ascii(F.regexp_replace(without(content(html), "script", "style", "noscript"), "<[^>]+>", " ")), F.lit(""))


def paragraphs(html: Column) -> Column:
    """The article's paragraphs, one a line, without furniture."""
    t = without(without(content(html), "script", "style", "noscript"), "header", "nav", "footer", "aside", "form")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>(?=\s*\S)", "\n"), r"(?i)</(p|div|section|article|h[1-6]|li|ul|ol|blockquote|tr|figcaption)>", "\n\n")
    lines = F.transform(F.split(F.regexp_replace(to_ascii(F.regexp_replace(t, "<[^>]+>", " "), keep_newlines=True), r"[ \t]+", " "), "\n"), lambda v: F.trim(v))
    return F.array_join(F.filter(lines, lambda v: v != ""), "\n")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, trimmed; null if the tag lacks it."""
    value = F.regexp_extract(tag, rf"(?i)(?<![\w-]){name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.when(value != "", F.trim(F.substring(value, F.lit(2), F.length(value) - 2)))


def meta(html: Column, keys: list[str]) -> Column:
    """The first meta tag's content whose property or name is one of keys, and that is not blank."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    hit = F.filter(tags, lambda t: F.lower(F.coalesce(attribute(t, "property"), attribute(t, "name"), F.lit(""))).isin(*keys) & (F.coalesce(attribute(t, "content"), F.lit("")) != ""))
    return attribute(F.get(hit, F.lit(0)), "content")


def published(html: Column) -> Column:
    """The time a page says it was published, from its metadata or its first time element."""
    said = F.coalesce(meta(html, DATE_KEYS), attribute(F.regexp_extract(html, r"(?i)<time\b[^>]*>", 0), "datetime"))
    return F.try_to_timestamp(said)


def title(html: Column) -> Column:
    return F.nullif(to_ascii(F.regexp_replace(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1), "<[^>]*>", " ")), F.lit(""))


#: Hosts that are local or private, most by how they begin.
LOCAL_HOSTS = r"^(localhost\z|0\.0\.0\.0\z|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)"


def public_url(url: Column) -> Column:
    """Whether a URL is http or https and its host neither local nor private."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.lower(url).rlike("^https?://") & (host != "") & ~host.rlike(LOCAL_HOSTS) & ~host.endswith(".localhost"), F.lit(False))


def is_pdf(url: Column, content_type: Column, head: Column) -> Column:
    """By the path's ending (of what is no URL, by an ending before ? or #), the type or the first bytes."""
    named = F.coalesce(F.lower(F.try_parse_url(url, F.lit("PATH"))).endswith(".pdf"), url.rlike(r"(?i)\.pdf([?#]|\z)"))
    some = lambda test: F.coalesce(test, F.lit(False))
    return some(named) | some(content_type.rlike("(?i)application/(x-)?pdf")) | some(F.substring(head, 1, 5) == F.lit(b"%PDF-"))


def listing(html: Column, item: str, link: str, text: str, time: str) -> Column:
    """Items of a listing page: array of struct(href, title, description, time) by patterns, for items that have a link and a title."""
    blocks = F.regexp_extract_all(html, F.lit(item), F.lit(0))
    plain = lambda c: to_ascii(F.regexp_replace(c, "<[^>]*>", " "))
    rows = F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(b, link, 1)).alias("href"), plain(F.regexp_extract(b, link, 2)).alias("title"), plain(F.regexp_extract(b, text, 1)).alias("description"), plain(F.regexp_extract(b, time, 1)).alias("time")))
    return F.filter(rows, lambda r: (r["href"] != "") & (r["title"] != ""))


class Markdown:
    """One pass over the tags of a page, keeping headings, paragraphs, lists, quotes, code, links and the article's own images.

    For use in a pandas UDF: nesting of lists and links depends on order, which Column expressions don't express.
    """

    TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^>]*)>", re.S)
    WORDS = re.compile(r"(?<![\w])(?:" + "|".join(FURNITURE) + r")(?![\w])")
    CHROME = re.compile(r"(?<![\w])(?:" + "|".join(IMAGE_CHROME) + r")(?![\w])")
    DROP = re.compile(rf"<({'|'.join(NEVER_PROSE)})\b.*?</\1\s*>", re.S | re.I)
    BOX = re.compile(r"<(div|section|aside|ul|figure|span)\b[^>]*(?:class|id|data-testid)\s*=\s*\"[^\"]*(?<![\w])(?:" + "|".join(FURNITURE) + r")(?![\w])[^\"]*\".*?</\1>", re.S | re.I)
    BLOCKS = frozenset("p div section tr figcaption figure article main body table".split())

    def __init__(self, base: str):
        self.base, self.out, self.dropped = base, [], []
        self.lists: list = []
        self.links: list = []
        self.code = 0

    @staticmethod
    def attr(text: str, name: str) -> str | None:
        m = re.search(rf"(?<![\w-]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", text, re.I)
        return (m[1] if m[1] is not None else m[2]).strip() if m else None

    def absolute(self, url: str | None) -> str | None:
        from urllib.parse import urljoin

        full = urljoin(self.base, url) if url else ""
        return full if re.match(r"https?://", full, re.I) else None

    def image(self, text: str) -> None:
        from html import unescape

        raw = next((v for k in ("src", "data-src", "data-original") if (v := self.attr(text, k))), "")
        url, alt, css = self.absolute(raw), (self.attr(text, "alt") or ""), (self.attr(text, "class") or "").lower()
        if not url or not self.content_image(raw, url, alt.lower(), css, self.attr(text, "width"), self.attr(text, "height")):
            self.dropped.append(raw)
        else:
            self.out.append(f"\n\n![{re.sub(r'[\[\]]', '', unescape(alt))}]({url})\n\n")

    @classmethod
    def content_image(cls, raw: str, url: str, alt: str, css: str, *sides: str | None) -> bool:
        """Whether an image is the article's own: no placeholder or inline data, not small on any side, and neither its words nor its address
        those of page furniture."""
        small = any((side or "").isdigit() and 0 < int(side) < 150 for side in sides)
        return not (re.search(r"[${}]|^data:", raw) or small or cls.WORDS.search(alt) or cls.WORDS.search(url.lower()) or cls.CHROME.search(css) or cls.CHROME.search(alt))

    def tag(self, close: bool, name: str, text: str) -> None:
        if name == "img":
            self.image(text)
        elif re.fullmatch("h[1-6]", name):
            self.out.append("\n\n" if close else "\n\n" + "#" * int(name[1]) + " ")
        elif name in ("ul", "ol"):
            if close:
                self.lists = self.lists[:-1]
            else:
                self.lists.append([name, 0])
            self.out.append("" if self.lists and close or len(self.lists) > 1 else "\n\n")
        elif name == "li":
            if not close:
                top = self.lists[-1] if self.lists else ["ul", 0]
                top[1] += 1
                self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{top[1]}. " if top[0] == "ol" else "- "))
        elif name == "blockquote":
            self.out.append("\n\n" if close else "\n\n> ")
        elif name == "pre":
            self.code += -1 if close else 1
            self.out.append("\n```\n\n" if close else "\n\n```\n")
        elif name == "code" and not self.code:
            self.out.append("`")
        elif name in ("strong", "b"):
            self.out.append("**")
        elif name == "br":
            self.out.append("\n")
        elif name == "a":
            if not close:
                self.links.append((len(self.out), self.absolute(self.attr(text, "href"))))
            elif self.links:
                start, url = self.links.pop()
                inner = "".join(self.out[start:])
                label = re.sub(r"\s+", " ", re.sub(r"!\[[^\]]*\]\([^)]*\)", "", inner)).strip()
                self.out[start:] = [(f"[{label}]({url})" if url else label) if label else inner]
        elif name in self.BLOCKS:
            self.out.append("\n\n")

    def convert(self, html: str) -> str:
        from html import unescape

        html, at = self.cleaned(html), 0
        for m in self.TAG.finditer(html):
            self.text(unescape(html[at : m.start()]))
            at = m.end()
            if m[2]:
                self.tag(bool(m[1]), m[2].lower(), m[3])
        self.text(unescape(html[at:]))
        lines, fenced = [], False
        for line in "".join(self.out).split("\n"):
            fenced ^= line.strip() == "```"
            item = re.match(r" *(?=- |[0-9]+\. )", line)
            lines.append(line.rstrip() if fenced else (item[0] if item else "") + re.sub(r"[ \t\u00a0]+", " ", line).strip())
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()

    def cleaned(self, html: str) -> str:
        """Without what is never prose and what the publisher marks as furniture; twice, as containers nest."""
        return self.BOX.sub(" ", self.BOX.sub(" ", self.DROP.sub(" ", html)))

    def text(self, text: str) -> None:
        self.out.append(text if self.code else re.sub(r"\s+", " ", text))


class Copied(Markdown):
    """Markup that was copied out of a page by hand: all of it is wanted, so no furniture is looked for; emphasis and rules are kept, and
    images go only if no address on the web can be made of theirs. Dropped are their texts."""

    DROP = re.compile(r"<(script|style|head|noscript|svg|iframe|form|select)\b[^>]*>.*?</\1>|<(?:script|style|svg)\b[^>]*/?>", re.S | re.I)
    BLOCKS = Markdown.BLOCKS | {"header", "footer"}
    EMPTY = re.compile(r"^[ \t]*(?:#{1,6}|[-*]|[0-9]+\.|>)[ \t]*$", re.M)

    def cleaned(self, html: str) -> str:
        return self.DROP.sub("", html)

    def image(self, text: str) -> None:
        url = self.absolute(self.attr(text, "src") or self.attr(text, "data-src"))
        alt = re.sub(r"[\[\]\n]", " ", self.attr(text, "alt") or "").strip()
        if url:
            self.out.append(f"\n\n![{alt}]({url})\n\n")
        else:
            self.dropped.append(alt)

    def tag(self, close: bool, name: str, text: str) -> None:
        if name in ("em", "i"):
            self.out.append("*")
        elif name == "hr":
            self.out.append("\n\n---\n\n")
        else:
            super().tag(close, name, text)

    def convert(self, html: str) -> str:
        return re.sub(r"\n{3,}", "\n\n", self.EMPTY.sub("", super().convert(html))).strip()


def _converted(html: Column, base: Column, kind: type[Markdown]) -> Column:
    import pandas as pd

    def convert(pages, bases):
        rows = []
        for page, at in zip(pages, bases, strict=True):
            m = kind(at or "")
            rows.append((m.convert(page) if page is not None else None, m.dropped))
        return pd.DataFrame(rows, columns=["markdown", "dropped"])

    convert.__annotations__ = {"pages": pd.Series, "bases": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(convert, "markdown string, dropped array<string>")(html, base)


def markdown(html: Column, base: Column) -> Column:
    """struct(markdown, dropped images) of the article of a page."""
    return _converted(content(html), base, Markdown)


def copied_markdown(html: Column, base: Column) -> Column:
    """struct(markdown, texts of dropped images) of markup that was copied."""
    return _converted(html, base, Copied)


def worth_converting(html: Column) -> Column:
    """Whether markup has any structure that converting would keep."""
    return F.coalesce(html.rlike(r"(?i)<(img|a|h[1-6]|ul|ol|li|p|blockquote|pre|table)\b"), F.lit(False))


def unwrap_images(md: Column) -> Column:
    """Images in links: alone the image stays, beside words the words and the link."""
    image = r"!\[[^\]]*\]\([^)]*\)"
    md = F.regexp_replace(md, rf"\[\s*({image})\s*\]\([^)]*\)", "$1")
    return F.regexp_replace(md, rf"\[([^\[\]]*?)\s*{image}\s*([^\[\]]*)\](\([^)]*\))", "[$1$2]$3")


def plain(md: Column) -> Column:
    """Markdown without its signs."""
    for pattern, to in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+|^>\s?|^\s*[-*]\s+", ""), (r"[*_`]+", ""), (r"\s+", " ")):
        md = F.regexp_replace(md, pattern, to)
    return F.trim(md)
