"""A boolean search language over reports, compiled to one Column.

Terms are bare words, "quoted text" or field:value; a value with * is a pattern anchored at both ends, field:~value a regular
expression; AND, OR, NOT, &&, ||, - and ! combine them, adjacent terms are joined by AND. Operators count as such even in quotes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import rules

# Names of fields as they may be typed.
FIELDS = {"text": "text", "keyword": "text", "label": "label", "tag": "label", "adv": "adversary", "adversary": "adversary", "actor": "adversary", "ttp": "ttp", "mitre": "ttp", "technique": "ttp", "cve": "cve", "ip": "ip", "dom": "domain", "domain": "domain", "hash": "hash", "filehash": "hash", "file": "hash", "ioc": "ioc", "indicator": "ioc", "src": "source", "source": "source"}
INDICATOR_FIELDS = ("ip", "domain", "hash", "cve", "ioc")
MOST_PATTERN, MOST_STARS = 200, 10


class SearchError(ValueError):
    """What is wrong with a query, in words for whoever typed it."""


@dataclass(frozen=True)
class Term:
    field: str
    kind: str  # contains, glob or regex
    value: str


@dataclass(frozen=True)
class Node:
    kind: str  # and, or, not
    parts: tuple


_SIGNS = re.compile(r"\s+|(?P<sign>[()]|[-!](?=[^\s()])|&&|\|\|)")
_FIELD = re.compile(r"([A-Za-z_]+):(~?)")
_WORD, _QUOTED = re.compile(r"[^\s()]*"), re.compile(r'"((?:[^"\\]|\\.|\\(?=\Z))*)"', re.S)
_SIGN_OF = {"-": "not", "!": "not", "&&": "and", "||": "or"}


def _pattern_end(text: str, at: int) -> int:
    """Where an unquoted regular expression ends: at white space, or at a bracket that it did not open."""
    opened, in_class = 0, False
    while at < len(text) and not text[at].isspace():
        if text[at] == "\\" and at + 1 < len(text):
            at += 1
        elif in_class:
            in_class = text[at] != "]"
        elif text[at] == "[":
            in_class = True
        elif text[at] in "()":
            opened += 1 if text[at] == "(" else -1
            if opened < 0:
                break
        at += 1
    return min(at, len(text))


def tokens(text: str) -> list:
    """Signs as strings, terms as Terms."""
    out, at = [], 0
    while at < len(text):
        if m := _SIGNS.match(text, at):
            at = m.end()
            if m["sign"]:
                out.append(_SIGN_OF.get(m["sign"], m["sign"]))
            continue
        field = _FIELD.match(text, at)
        name = FIELDS.get(field[1].lower()) if field else None
        at = field.end() if name else at
        is_pattern = bool(name and field[2])
        if text[at : at + 1] == '"':
            if not (q := _QUOTED.match(text, at)):
                raise SearchError("Unclosed quote in the query.")
            value, at = re.sub(r"\\(.)", r"\1", q[1], flags=re.S), q.end()
        else:
            end = _pattern_end(text, at) if is_pattern else _WORD.match(text, at).end()
            value, at = text[at:end], end
        if name is None and value.upper() in ("AND", "OR", "NOT"):
            out.append(value.lower())
        elif value:
            out.append(_term(name or "text", is_pattern, value))
        elif name:
            raise SearchError(f'"{field[0]}" needs a value.')
    return out


def _plain(value: str) -> str:
    """An indicator as it is stored, however it was typed."""
    value = re.sub(r"\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)", ".", value, flags=re.I)
    for marked in ("://", ":", "/"):
        value = value.replace(f"[{marked}]", marked)
    return re.sub(r"\bhxxp(s?)\b", r"http\1", value, flags=re.I | re.A).strip()


def _term(field: str, is_pattern: bool, value: str) -> Term:
    if is_pattern:
        if len(value) > MOST_PATTERN:
            raise SearchError(f"Regular expressions are limited to {MOST_PATTERN} characters.")
        try:
            re.compile(value)
        except re.error as e:
            raise SearchError(f'"{value}" is not a valid regular expression.') from e
        return Term(field, "regex", value)
    value = _plain(value) if field in INDICATOR_FIELDS else value
    if value.count("*") > MOST_STARS:
        raise SearchError(f"Use at most {MOST_STARS} wildcards in one term.")
    return Term(field, "glob", value) if "*" in value else Term(field, "contains", value.lower())


def parse(text: str) -> Node | Term:
    """The tree of a query; SearchError tells what is wrong with it."""
    items = tokens(text or "")
    if not items:
        raise SearchError("Enter something to search for.")
    items.append("end")

    def level(kind: str, below):
        def read():
            parts = [below()]
            while items[0] == kind or kind == "and" and items[0] not in ("or", ")", "end"):
                if items[0] == kind:
                    items.pop(0)
                parts.append(below())
            return parts[0] if len(parts) == 1 else Node(kind, tuple(parts))

        return read

    def single():
        head = items.pop(0) if items[0] != "end" else "end"
        if isinstance(head, Term):
            return head
        if head == "not":
            return Node("not", (single(),))
        if head == "(":
            inner = either()
            if items[0] != ")":
                raise SearchError("Unclosed bracket in the query.")
            items.pop(0)
            return inner
        raise SearchError("The query ends with an operator." if head == "end" else f'Unexpected "{head.upper()}" in the query.')

    either = level("or", level("and", single))
    tree = either()
    if items[0] != "end":
        raise SearchError("Unbalanced closing bracket in the query.")
    return tree


def fields(tree: Node | Term) -> set[str]:
    """Fields a query asks for; only their data need be joined."""
    return {tree.field} if isinstance(tree, Term) else set().union(*map(fields, tree.parts))


def _test(term: Term) -> Column:
    if term.kind == "contains":
        ok = lambda v: F.lower(v).contains(term.value)
    else:
        body = term.value if term.kind == "regex" else "^" + ".*".join(re.escape(p) if p else "" for p in term.value.split("*")) + r"\z"
        ok = lambda v: v.rlike("(?i)" + body)
    return F.coalesce(F.exists(F.filter(F.col(term.field), lambda v: v.isNotNull() & (v != "")), ok), F.lit(False))


def compiled(tree: Node | Term) -> Column:
    """The query as a predicate over a document's array columns; it is true or false, never null."""
    if isinstance(tree, Term):
        return _test(tree)
    parts = [compiled(p) for p in tree.parts]
    if tree.kind == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if tree.kind == "and" else out | p
    return out


#: Kinds of stored indicators by the field that finds them.
KIND_FIELDS = {"ip": "ip", "domain": "domain", "hash": "file_hash", "ttp": "mitre", "cve": "cve"}


def documents(reports: DataFrame, asked: set[str], labels: DataFrame | None = None, iocs: DataFrame | None = None) -> DataFrame:
    """reports with one array column per field; labels (id, name) and iocs (id, value, ioc_type) are joined only if asked for."""
    none = F.array().cast("array<string>")
    docs = reports
    if labels is not None and "label" in asked:
        docs = docs.join(labels.groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("_labels")), "id", "left")
    else:
        docs = docs.withColumn("_labels", none)
    if iocs is not None and asked & {*INDICATOR_FIELDS, "ttp"}:
        of = [F.sort_array(F.collect_set(F.when(F.col("ioc_type") == kind, F.col("value")))).alias(f"_{field}") for field, kind in KIND_FIELDS.items()]
        docs = docs.join(iocs.groupBy("id").agg(*of), "id", "left")
    else:
        docs = docs.withColumns({f"_{field}": none for field in KIND_FIELDS})
    one = lambda *names: F.array_compact(F.array(*names))
    kept = {field: F.coalesce(f"_{field}", none) for field in KIND_FIELDS}
    cve = F.concat(one("cve_id"), kept["cve"])
    docs = docs.withColumns({"text": one("title", "description", "cve_id", "target"), "source": one("source_name"), "adversary": one("adversary_label", "crowdstrike_adversary"), "label": F.coalesce("_labels", none), "ip": kept["ip"], "domain": kept["domain"], "hash": kept["hash"], "ttp": kept["ttp"], "cve": cve, "ioc": F.concat(kept["ip"], kept["domain"], kept["hash"], cve)})
    return docs.drop("_labels", *(f"_{field}" for field in KIND_FIELDS))


def corpus(reports: DataFrame, hidden: DataFrame | None = None, most: int = 4000) -> tuple[DataFrame, Column]:
    """The newest reports, then without hidden ones; and whether there were more than `most`."""
    order = [F.col("published_at").desc_nulls_last(), F.col("id")]
    newest = reports.orderBy(*order).limit(most)
    more = F.lit(reports.limit(most + 1).count() > most)
    if hidden is not None:
        newest = newest.join(hidden.select("raw_hash").distinct(), "raw_hash", "left_anti")
    return newest, more


def search(query: str, reports: DataFrame, labels: DataFrame | None = None, iocs: DataFrame | None = None) -> DataFrame:
    """Reports that satisfy the query, with section; only a query on text alone also asks for relevance, and not of exploits."""
    tree = parse(query)
    asked = fields(tree)
    hits = documents(reports, asked, labels, iocs).where(compiled(tree))
    section = F.when(F.col("kind").isin("research", "other"), "reports").when(F.col("kind") == "breach", "breaches").when(F.col("kind") == "exploit", "exploits")
    if asked == {"text"}:
        text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
        hits = hits.where((F.col("kind") == "exploit") | rules.relevant(text))
    return hits.withColumn("section", section).drop("text", "source", "adversary", "label", "ip", "domain", "hash", "ttp", "cve", "ioc")
