"""Text: ASCII folding, cleaning, labels, hashes, dates."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.patterns import let, squeezed

# Named entities and punctuation with their ASCII forms.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "...", "mdash": "--", "ndash": "-", "ldquo": '"', "rdquo": '"', "lsquo": "'", "rsquo": "'", "laquo": '"', "raquo": '"', "bull": "-", "middot": "-", "copy": "(c)", "reg": "(R)", "trade": "(TM)", "deg": " deg", "euro": "EUR", "pound": "GBP", "cent": "c", "times": "x"}
PUNCTUATION = {
    "-": "‐‑‒–−•·‧", "--": "—―", "'": "‘’‚‛′", '"': "“”„‟″«»", "...": "…", " ": "   ",
    "": "­​‌‍﻿", "(TM)": "™", "(c)": "©", "(R)": "®", "EUR": "€", "GBP": "£", "->": "→", "<-": "←", "<->": "↔",
}
# Hours that named zones are ahead of UTC.
ZONES = {"UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "BST": 1}
CATEGORIES = {"ai": "AI", "malware": "Malware", "adversary": "Adversary", "target": "Target", "vector": "Vector"}


def item_hash(title: Column, url: Column) -> Column:
    """sha256 of title and url, both trimmed, squeezed and in lower case."""
    return F.sha2(F.concat_ws("|", *(F.lower(squeezed(F.coalesce(c, F.lit("")))) for c in (title, url))), 256)


def _decoded(text: Column) -> Column:
    """Entities by name and number; only those that a text holds are made, by splitting at them."""
    named = text
    for name, plain in ENTITIES.items():
        if name != "amp":
            named = F.replace(named, F.lit(f"&{name};"), F.lit(plain))
    parts = F.split(named, "(?=&#)")

    def one(part: Column) -> Column:
        hexa, deci = F.regexp_extract(part, "^&#[xX]([0-9a-fA-F]{1,6});", 1), F.regexp_extract(part, "^&#([0-9]{1,7});", 1)
        code = F.when(hexa != "", F.conv(hexa, 16, 10).cast("int")).when(deci != "", deci.cast("int"))
        rest = F.regexp_replace(part, "^&#[xX]?[0-9a-fA-F]+;", "")
        sign = F.when((code > 0) & (code <= 0xFFFF), F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")).otherwise("")
        return F.when(code.isNull(), part).otherwise(F.concat(sign, rest))

    return F.replace(F.array_join(F.transform(parts, one), ""), F.lit("&amp;"), F.lit("&"))


def _base_letters() -> dict[str, str]:
    """Signs of the basic plane whose decompositions are plain ASCII once their accents are off, and these: one sign or several."""
    import unicodedata

    plain = {}
    for code in (*range(0xA1, 0xD800), *range(0xE000, 0x10000)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if base and all(" " <= c <= "~" for c in base):
            plain[chr(code)] = base
    return plain


_PLAIN = _base_letters()
LETTERS, BASES = ("".join(part) for part in zip(*((c, base) for c, base in _PLAIN.items() if len(base) == 1), strict=True))
#: Signs that become several (ligatures, enclosed and squared forms), as a class of a pattern.
SEVERAL = {c: base for c, base in _PLAIN.items() if len(base) > 1}
SEVERAL_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in SEVERAL) + "]"


def to_ascii(text: Column, keep_newlines: bool = False) -> Column:
    """Plain ASCII: entities decoded (twice, for those written twice), punctuation and letters folded, the rest dropped.

    Letters that decompose to one ASCII sign are folded by one translate with a table made from Unicode's decompositions; in texts with
    ligatures and other signs that decompose to several, these are looked up sign by sign. Empty for null.
    """
    several = F.from_json(F.lit(json.dumps(SEVERAL)), "map<string,string>")

    def spelt_out(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, f"(?={SEVERAL_CLASS})|(?<={SEVERAL_CLASS})"), lambda c: F.when(c.rlike(f"^{SEVERAL_CLASS}\\z"), F.element_at(several, c)).otherwise(c)), "")

    def folded(t: Column) -> Column:
        for plain, signs in PUNCTUATION.items():
            t = F.translate(t, signs, plain * len(signs)) if len(plain) == 1 else F.regexp_replace(t, f"[{signs}]", plain.replace("$", r"\$"))
        t = let(t, lambda x: F.when(x.rlike(SEVERAL_CLASS), spelt_out(x)).otherwise(x))
        return F.regexp_replace(F.translate(t, LETTERS, BASES), r"[^\x09\x0A\x0D\x20-\x7E]", "")

    # each step runs only where a text has what it is for
    t = F.coalesce(text, F.lit(""))
    for _ in range(2):
        t = let(t, lambda x: F.when(x.contains("&"), _decoded(x)).otherwise(x))
    t = let(t, lambda x: F.when(x.rlike(r"[^\x09\x0A\x0D\x20-\x7E]"), folded(x)).otherwise(x))
    if keep_newlines:
        for pattern, plain in ((r"[^\S\n]+", " "), (r"\n{3,}", "\n\n"), (r"[ \t]*\n[ \t]*", "\n")):
            t = F.regexp_replace(t, pattern, plain)
    else:
        t = F.regexp_replace(t, r"\s+", " ")
    return F.regexp_replace(t, r"^\s+|\s+\z", "")


def clean(html: Column) -> Column:
    """A feed's description: tags off, ASCII, 500 characters; null if nothing is left."""
    return F.nullif(F.substring(to_ascii(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " ")), 1, 500), F.lit(""))


def feed_date(text: Column) -> Column:
    """A timestamp from the forms feeds use; named zones become offsets, a date that cannot be read is null."""
    raw = F.trim(text)
    for zone, hours in ZONES.items():
        raw = F.regexp_replace(raw, rf"\s+{zone}\s*$", f" +{hours:02d}00")
    raw = F.regexp_replace(raw, r"^[A-Za-z]{3,9},\s*", "")
    forms = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "MMMM d, yyyy hh:mm:ss a Z", "MMMM d, yyyy hh:mm:ss a", "MMMM d, yyyy")
    iso = raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    return F.coalesce(F.when(iso, F.try_to_timestamp(raw)), *(F.try_to_timestamp(F.when(~iso, raw), F.lit(f)) for f in forms))


MONTHS = "january february march april may june july august september october november december".split()
LISTED = r"(?i)^(?:\w+,\s*)?([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM)?\s*([A-Z]{3,4})?\z"


def listing_date(text: Column) -> Column:
    """A timestamp from `Weekday, Month d, yyyy h:mm:ss AM ZONE`; weekday, seconds, AM or PM and zone may be missing.

    A zone that is not known is read as UTC; a date that cannot be read is null. Days beyond a month's end run on into the next.
    """
    def read(t: Column) -> Column:
        part = lambda n: F.regexp_extract(t, LISTED, n)
        number = lambda n: F.coalesce(F.nullif(part(n), F.lit("")).cast("int"), F.lit(0))
        month, half, zone = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(1))).cast("int"), F.upper(part(7)), F.upper(part(8))
        hour = F.when((half == "PM") & (number(4) < 12), number(4) + 12).when((half == "AM") & (number(4) == 12), 0).otherwise(number(4))
        ahead = F.lit(0)
        for name, hours in ZONES.items():
            ahead = F.when(zone == name, hours).otherwise(ahead)
        ok = t.rlike(LISTED) & (month > 0) & (hour <= 23) & (number(5) <= 59) & (number(6) <= 59) & number(2).between(1, 31) & (number(3) > 0)
        first = F.make_date(F.when(ok, number(3)), F.when(ok, month), F.lit(1)).cast("timestamp")
        return first + F.make_dt_interval(number(2) - 1, hour - ahead, number(5), number(6))

    return let(to_ascii(text), read)


def label_value(raw: Column) -> Column:
    """Parts of letters and digits, each with a capital first, put together; 48 characters."""
    parts = F.filter(F.split(F.coalesce(raw, F.lit("")), "[^a-zA-Z0-9]+"), lambda p: p != "")
    return F.substring(F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), ""), 1, 48)


def label(category: str, raw: Column) -> Column:
    """Prefix/Value, whatever prefix the value came with; null if nothing is left."""
    value = label_value(F.regexp_replace(raw, r"(?i)^\s*(ai|malware|adversary|target|vector)\s*/\s*", ""))
    return F.when(value != "", F.concat(F.lit(CATEGORIES[category] + "/"), value))


def _first_spellings(names: Column) -> Column:
    """Each name once, case ignored."""
    return let(F.transform(names, F.lower), lambda keys: F.filter(names, lambda n, i: F.array_position(keys, F.lower(n)) == i + 1))


def labels(by_category: dict[str, Column], most: int = 8) -> Column:
    """Labels of arrays of raw values by category, in the order of categories, each once (case ignored), `most` at most."""
    def of(category: str) -> Column:
        return F.transform(F.coalesce(by_category[category], F.array().cast("array<string>")), lambda r: label(category, r))

    every = F.concat(*(of(k) for k in CATEGORIES if k in by_category))
    return F.slice(let(F.filter(every, lambda v: v.isNotNull()), _first_spellings), 1, most)


def label_edit(csv: Column) -> Column:
    """Names typed with commas: trimmed, squeezed, the first spelling of each."""
    names = F.filter(F.transform(F.split(csv, ","), squeezed), lambda n: n != "")
    return let(names, _first_spellings)


def jitter(text: Column) -> Column:
    """A steady offset in about -0.12 to 0.12 from a rolling hash of the characters."""
    # in whole numbers of 32 bits, as a signed product would overflow
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(1 << 32)))
    return (F.pmod(h, F.lit(1000)) / 999 - 0.5) * 0.24


def match_ranges(text: Column, pattern: str) -> Column:
    """array of struct(start, end): where pattern matches, in order, in characters from 0; empty for an empty pattern."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    if not pattern:
        return none
    def ranges(runs: Column) -> Column:
        # each run is the text between two matches; a mark that no text holds divides them
        return F.aggregate(
            runs, F.struct(F.lit(0).alias("at"), none.alias("found")),
            lambda s, run: F.struct(
                (s["at"] + F.length(run["before"]) + F.length(run["hit"])).alias("at"),
                F.when(run["hit"] == "", s["found"]).otherwise(F.concat(s["found"], F.array(F.struct((s["at"] + F.length(run["before"])).alias("start"), (s["at"] + F.length(run["before"]) + F.length(run["hit"])).alias("end"))))).alias("found"),
            ),
            lambda s: s["found"],
        )

    return ranges(_runs(text, pattern))


def _runs(text: Column, pattern: str) -> Column:
    """array of struct(before, hit): the text in front of each match and the match; the last hit is empty."""
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return let(hits, lambda h: F.transform(between, lambda b, i: F.struct(b.alias("before"), F.coalesce(F.get(h, i), F.lit("")).alias("hit"))))


def segments(text: Column, pattern: str) -> Column:
    """array of struct(text, hit): text cut at the matches of pattern, empty runs left out."""
    whole = F.array(F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(False).alias("hit")))
    parts = whole if not pattern else F.flatten(F.transform(_runs(F.coalesce(text, F.lit("")), pattern), lambda r: F.array(F.struct(r["before"].alias("text"), F.lit(False).alias("hit")), F.struct(r["hit"].alias("text"), F.lit(True).alias("hit")))))
    return F.filter(parts, lambda p: p["text"] != "")


def step_hit(active: Column, total: Column, delta: Column) -> Column:
    """The next hit's number, around both ends; 0 without hits."""
    return F.when(total > 0, F.pmod(active + delta, total)).otherwise(0)


def citations(text: Column) -> Column:
    """Numbers in square brackets, each once, in order; one that no id can be is left out."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), 1), lambda n: n.try_cast("int")), lambda n: n.isNotNull()))
