"""Answers of outside models, read tolerantly: JSON in prose, checked against allowed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.patterns import let
from tidewatch.functions.text import labels, to_ascii

# What answers may say, and the spellings of their keys.
KINDS = ("research", "breach", "exploit", "other")
NEXUSES = ("china", "russia", "north_korea", "iran", "rest_of_world", "other")
ITEM_TYPES = ("actor_activity", "breach", "vuln", "report", "breaking")
CONFIDENCES = ("confirmed", "suspected", "poc")
LABEL_KEYS = {"ai": ("ai", "aiText", "ai_text"), "malware": ("malware",), "adversary": ("adversary", "adversaries", "actor", "actors"), "target": ("target", "targets", "targetedSystems", "targeted_systems"), "vector": ("vector", "vectors")}
INDICATOR_KEYS = {"ips": ("ipv4", "ips", "ip"), "ipv6": ("ipv6",), "domains": ("domains", "domain"), "files": ("fileHashes", "file_hashes", "hashes", "files"), "cves": ("cves", "cve")}


def first_object(answer: Column) -> Column:
    """The first balanced {...}, braces in strings not counted: one pass over the signs that matter; null if there is none."""
    rest = F.when(F.instr(answer, "{") > 0, F.substring(answer, F.instr(answer, "{"), F.length(answer)))
    signs = F.regexp_extract_all(rest, F.lit(r'"(?:[^"\\]|\\.)*(?:"|\z)|[{}]|[^{}"]+'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"), F.lit(False).alias("done"))

    def step(s: Column, sign: Column) -> Column:
        depth = s["depth"] + F.when(sign == "{", 1).when((sign == "}") & (s["depth"] > 0), -1).otherwise(0)
        inside = ~s["done"] & ((s["depth"] > 0) | (sign == "{"))
        return F.struct(F.when(s["done"], s["depth"]).otherwise(depth).alias("depth"), F.when(inside, F.concat(s["text"], sign)).otherwise(s["text"]).alias("text"), (s["done"] | (inside & (depth == 0))).alias("done"))

    return F.aggregate(signs, start, step, lambda s: F.when(s["done"], s["text"]))


def techniques(answer: Column) -> Column:
    """array of struct(code, name) from the outermost [...]: well-formed codes, each once, in upper case; unnamed ones by code."""
    rows = F.from_json(F.regexp_extract(answer, r"(?s)\[.*\]", 0), "array<struct<code:string,name:string>>")
    rows = F.transform(F.coalesce(rows, F.array().cast("array<struct<code:string,name:string>>")), lambda r: F.struct(F.upper(F.trim(r["code"])).alias("code"), to_ascii(r["name"]).alias("name")))
    rows = F.filter(rows, lambda r: F.coalesce(r["code"].rlike(r"^T[0-9]{4}(\.[0-9]{3})?\z"), F.lit(False)))

    def once(rows: Column) -> Column:
        codes = F.transform(rows, lambda r: r["code"])
        return F.filter(rows, lambda r, i: F.array_position(codes, r["code"]) == i + 1)

    return F.transform(let(rows, once), lambda r: F.struct(r["code"].alias("code"), F.when(r["name"] == "", r["code"]).otherwise(r["name"]).alias("name")))


def _listed(body: Column, path: str) -> Column:
    """The strings of an array at a path, null if the path is missing; anything else there gives an empty array."""
    said = F.get_json_object(body, path)
    rows = F.from_json(F.when(said.startswith("["), said), "array<string>")
    return F.when(said.isNotNull(), F.filter(F.coalesce(rows, F.array().cast("array<string>")), lambda v: F.trim(v) != ""))


def triage(answer: Column) -> Column:
    """What a model says of a report, from the outermost {...}; null if that is no JSON. What is not allowed falls back.

    struct(relevant, fetch_status, nexus, item_type, kind, confidence, adversary, labels, indicators, techniques, summary, reason)
    """
    body = F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))

    def read(body: Column) -> Column:
        said = lambda key: F.get_json_object(body, f"$.{key}")
        among = lambda key, allowed, other: F.when(said(key).isin(*allowed), said(key)).otherwise(F.lit(other).cast("string"))
        empty = F.array().cast("array<string>")

        def of_label(key: str) -> Column:
            one = F.get_json_object(body, f"$.labels.{key}")
            return F.when(one.startswith("["), F.coalesce(F.from_json(one, "array<string>"), empty)).when(one.isNotNull(), F.array(one)).otherwise(empty)

        names = {category: F.concat(*map(of_label, keys)) for category, keys in LABEL_KEYS.items()}
        found = [F.coalesce(*(_listed(body, f"$.indicators.{k}") for k in keys), empty).alias(name) for name, keys in INDICATOR_KEYS.items()]
        return F.struct(
            F.coalesce(~said("relevant").isin("", "false", "0"), F.lit(False)).alias("relevant"),
            among("fetchStatus", ("full", "feed_only"), "failed").alias("fetch_status"),
            among("nexus", NEXUSES, None).alias("nexus"),
            among("itemType", ITEM_TYPES, "report").alias("item_type"),
            among("dashboardKind", KINDS, "other").alias("kind"),
            among("confidence", CONFIDENCES, "suspected").alias("confidence"),
            F.nullif(said("crowdstrikeAdversary"), F.lit("")).alias("adversary"),
            labels(names).alias("labels"),
            F.struct(*found).alias("indicators"),
            F.transform(F.coalesce(_listed(body, "$.mitreTechniques"), empty), F.upper).alias("techniques"),
            F.trim(F.coalesce(said("summary"), F.lit(""))).alias("summary"),
            F.nullif(F.trim(said("reason")), F.lit("")).alias("reason"),
        )

    return let(F.when(F.try_parse_json(body).isNotNull(), body), lambda b: F.when(b.isNotNull(), read(b)))


#: Characters of a note's content.
NOTE_CHARS = 1000


def notes(answer: Column) -> Column:
    """array of struct(kind, subject, content): what a model wants to remember, from the outermost {...}; empty if that is no JSON.

    Entries of the lists `adversaries` and `trends` need a subject and a content that are text and not blank; all others are passed over.
    Subjects are trimmed, contents are plain ASCII of at most NOTE_CHARS characters. The rows are what views.memory_update takes.
    """
    empty = F.array().cast("array<struct<kind:string,subject:string,content:string>>")

    def of(said: Column, key: str, kind: str) -> Column:
        def one(e: Column) -> Column:
            text = lambda name: F.when(F.schema_of_variant(F.try_variant_get(e, f"$.{name}", "variant")) == "STRING", F.try_variant_get(e, f"$.{name}", "string"))
            return F.struct(F.lit(kind).alias("kind"), F.trim(text("subject")).alias("subject"), F.substring(to_ascii(F.trim(text("content")), keep_newlines=True), 1, NOTE_CHARS).alias("content"))

        rows = F.transform(F.try_variant_get(said, f"$.{key}", "array<variant>"), one)
        return F.coalesce(F.filter(rows, lambda r: (r["subject"] != "") & (r["content"] != "")), empty)

    said = F.try_parse_json(F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit("")))
    return let(said, lambda v: F.concat(of(v, "adversaries", "adversary"), of(v, "trends", "trend")))


def longest_body(bodies: Column, least: int = 600) -> Column:
    """struct(text, ok): the longest of fetched bodies; it counts from `least` characters on."""
    best = F.array_max(F.transform(bodies, lambda b: F.struct(F.length(b).alias("n"), b.alias("text"))))
    return F.struct(best["text"].alias("text"), F.coalesce(best["n"] >= least, F.lit(False)).alias("ok"))


def cited(text: Column, ids: Column) -> Column:
    """The ids that text cites as [id]."""
    return F.filter(ids, lambda i: text.contains(F.concat(F.lit("["), i.cast("string"), F.lit("]"))))


def flags(answer: Column, batch: Column, guarded: Column) -> Column:
    """array of struct(value, category, reason): values flagged in the first {...} that are in the batch, as it spells them, and neither
    guarded nor under a guarded name, each once; categories are cut at 40 characters, reasons at 300, and both have defaults."""
    read = F.from_json(first_object(answer), "flagged array<struct<value:string,category:string,reason:string>>")["flagged"]
    rows = F.coalesce(read, F.array().cast("array<struct<value:string,category:string,reason:string>>"))
    key = lambda r: F.lower(F.trim(r["value"]))

    def once(ok: Column) -> Column:
        keys = F.transform(ok, key)
        return F.filter(ok, lambda r, i: F.array_position(keys, key(r)) == i + 1)

    def standing(lower: Column) -> Column:
        ok = F.filter(rows, lambda r: F.array_contains(lower, F.coalesce(key(r), F.lit(""))) & ~F.exists(guarded, lambda g: (key(r) == g) | key(r).endswith(F.concat(F.lit("."), g))))
        spelt = lambda r: F.element_at(batch, F.array_position(lower, key(r)).cast("int"))
        some = lambda c, most, other: F.coalesce(F.substring(F.nullif(F.trim(c), F.lit("")), 1, most), F.lit(other))
        return F.transform(let(ok, once), lambda r: F.struct(spelt(r).alias("value"), some(r["category"], 40, "unclassified").alias("category"), some(r["reason"], 300, "Flagged without a stated reason.").alias("reason")))

    return let(F.transform(batch, F.lower), standing)
