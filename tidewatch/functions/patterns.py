"""Regular expressions that read the same in every dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[0-9A-Za-z_]"


def first_letters(pattern: str) -> str | None:
    """The ASCII letters and digits that a match of pattern can begin with, in lower case; None if others may begin one or none can be told."""
    from re import _constants as c
    from re import _parser

    def of(items) -> tuple[set[int], bool] | None:
        """What a sequence may begin with, and whether it may be empty."""
        letters: set[int] = set()
        for op, arg in items:
            if op is c.AT:
                continue
            one = part(op, arg)
            if one is None:
                return None
            letters |= one[0]
            if not one[1]:
                return letters, False
        return letters, True

    def part(op, arg) -> tuple[set[int], bool] | None:
        if op is c.LITERAL:
            return {arg}, False
        if op is c.IN and all(o in (c.LITERAL, c.RANGE) for o, _ in arg):
            return {x for o, a in arg for x in (range(a[0], a[1] + 1) if o is c.RANGE else (a,))}, False
        if op is c.BRANCH:
            parts = [of(items) for items in arg[1]]
            return None if None in parts else (set().union(*(p[0] for p in parts)), any(p[1] for p in parts))
        if op is c.SUBPATTERN:
            return of(arg[3])
        if op in (c.MAX_REPEAT, c.MIN_REPEAT):
            inner = of(arg[2])
            return None if inner is None else (inner[0], inner[1] or arg[0] == 0)
        return None

    try:
        found = of(_parser.parse(pattern))
    except Exception:  # what Python cannot read is left without a hint
        return None
    if found is None or found[1] or not all(x < 128 and chr(x).isalnum() for x in found[0]):
        return None
    return "".join(sorted({chr(x).lower() for x in found[0]}))


def java(pattern: str) -> str:
    """pattern with ASCII word boundaries for Java, whose own looks at other letters too; DuckDB reads the same text without this.

    A boundary at the beginning of a pattern, group or alternative stands before a word, any other one behind a word; so each becomes
    one look in one direction, which Java tests much faster than a boundary of either kind.
    """
    parts = pattern.split(r"\b")
    out = parts[0]
    for part in parts[1:]:
        begins = out == "" or out.endswith(("(", "|", "(?:", "(?i)"))
        out += (f"(?<!{WORD})" if begins else f"(?!{WORD})") + part
    return out


def let(value: Column, body) -> Column:
    """body(value), with value computed once: an expression that a lambda refers to would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hinted(pattern: str) -> str:
    """pattern for Java behind a look at the next letter.

    Java tries every alternative at every place; most places are ruled out by the letters that alternatives begin with, in one test.
    """
    letters = first_letters(pattern)
    return java(pattern) if not letters else f"(?=[{letters}{letters.upper()}])(?:{java(pattern)})"


def has(text: Column, pattern: str) -> Column:
    """Whether pattern occurs in text, case ignored; null texts have nothing."""
    return F.coalesce(text.rlike("(?i)" + hinted(pattern)), F.lit(False))


def text_of(*columns: str) -> Column:
    """Columns joined by one space, null as empty."""
    return F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns))


def squeezed(text: Column) -> Column:
    """White space at the ends removed, inside made one space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+\z", ""), r"(?U)\s+", " ")
