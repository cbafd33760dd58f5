"""Matching reports to a catalogue of named actors, cards per actor or country, and the timeline."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import rules
from tidewatch.functions.text import to_ascii
from tidewatch.functions.patterns import has, let

NONE = "Non Attributed"
#: Catalogues are operator-kept lists; beyond this many aliases matching goes by join instead of by a literal array.
MOST_ALIASES = 20_000
#: As many are looked for one by one, which is faster for a handful; more are found by their first words.
FEW_ALIASES = 64


def aliases(actors: DataFrame) -> DataFrame:
    """alias, nexus, cs, motivation and ord for each distinct alias of an actor that may attribute a report.

    actors: name, nexus, motivation (array), community_identifiers, internal_alternative_names (arrays), and ord, its place in the
    catalogue.
    """
    none = F.array().cast("array<string>")
    names = F.concat(F.array("name"), F.coalesce("community_identifiers", none), F.coalesce("internal_alternative_names", none))
    rows = actors.where("name is not null").select("ord", F.posexplode(names).alias("at", "raw"), "name", F.coalesce("nexus", F.lit("other")).alias("nexus"), F.get("motivation", F.lit(0)).alias("motivation"))
    rows = rows.withColumn("alias", F.lower(F.trim("raw"))).where(rules.matchable(F.col("alias")))
    first = rows.groupBy("alias", F.col("name").alias("cs")).agg(F.min_by(F.struct("nexus", "motivation", "ord", "at"), F.struct("ord", "at")).alias("f"))
    return first.select("alias", "f.nexus", "cs", "f.motivation", F.struct("f.ord", "f.at").alias("ord"))


def catalogue(groups: DataFrame, few: int = FEW_ALIASES) -> Column | Trie:
    """The aliases, longest first, then in catalogue order: a literal array of structs, or a Trie if they are more than a few; their number is checked."""
    rows = groups.orderBy(F.length("alias").desc(), "ord", "alias").select("alias", "nexus", "cs", "motivation").limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"over {MOST_ALIASES} aliases: use match_join")
    if not rows:
        return F.array().cast("array<struct<alias:string,nexus:string,cs:string,motivation:string>>")
    if len(rows) > few:
        return Trie([tuple(r) for r in rows])
    text = lambda v: F.lit(v).cast("string")
    return F.array(*(F.struct(text(r.alias).alias("alias"), text(r.nexus).alias("nexus"), text(r.cs).alias("cs"), text(r.motivation).alias("motivation")) for r in rows))


class Trie:
    """Aliases by the words that they begin with, as one literal that Column expressions walk.

    A node is the first word of an alias, or its first two; it holds the aliases that go on from it, in catalogue order. Nodes lie in an
    array by a hash of their words, since looking up a map's key in Spark goes over all keys: so a word of a text finds its node in one
    step, whatever the size of the catalogue. Aliases without ASCII letters or digits have no words and are tried on every text.
    """

    def __init__(self, rows: list[tuple]):
        count = 1 << max(4, len(rows).bit_length())
        nodes: dict[str, list[dict]] = {}
        for rank, row in enumerate(rows):
            words = re.findall("[a-z0-9]+", row[0])[:2]
            nodes.setdefault(" ".join(words), []).append(dict(zip(("alias", "nexus", "cs", "motivation"), row, strict=True)) | {"rank": rank})
        self.loose = F.from_json(F.lit(json.dumps(nodes.pop("", []))), f"array<{self.GROUP}>")
        places: list[list[dict]] = [[] for _ in range(count)]
        for words, groups in nodes.items():
            places[zlib.crc32(words.encode()) % count].append({"words": words, "groups": groups})
        self.count, self.places = count, F.from_json(F.lit(json.dumps(places)), f"array<array<struct<words:string,groups:array<{self.GROUP}>>>>")

    GROUP = "struct<rank:int,alias:string,nexus:string,cs:string,motivation:string>"

    def match(self, text: Column, only: Callable[[Column], Column] | None = None) -> Column:
        """The first group, of those that satisfy only, whose alias stands in text (in lower case)."""

        def at(words: Column) -> Column:
            node = F.get(self.places, F.pmod(F.crc32(words), F.lit(self.count)).cast("int"))
            return F.flatten(F.transform(F.filter(node, lambda n: n["words"] == words), lambda n: n["groups"]))

        def among(words: Column) -> Column:
            pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
            keys = F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())))
            found = F.concat(self.loose, F.flatten(F.transform(keys, at)))
            hits = F.filter(found, lambda g: named_in(text, g["alias"]) & (F.lit(True) if only is None else only(g["alias"])))
            return let(F.array_min(hits), lambda g: F.when(g.isNotNull(), F.struct(*(g[c].alias(c) for c in ("alias", "nexus", "cs", "motivation")))))

        return let(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), among)


def named_in(text: Column, alias: Column) -> Column:
    """Whether alias stands in text with neither a letter nor a digit beside it; both in lower case."""
    quoted = F.regexp_replace(alias, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    return text.contains(alias) & F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])")))


def match(text: Column, groups: Column | Trie) -> Column:
    """The first group whose alias stands in text, null if none; no rows are multiplied."""
    if isinstance(groups, Trie):
        return let(F.lower(text), lambda t: groups.match(t))
    return let(F.lower(text), lambda t: F.get(F.filter(groups, lambda g: named_in(t, g["alias"])), F.lit(0)))


def match_report(title: Column, description: Column, groups: Column | Trie, body: Column | None = None) -> Column:
    """The group named in title or description, else, by a strong alias only, in the body."""
    stated = match(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))), groups)
    if body is None:
        return stated
    if isinstance(groups, Trie):
        return F.coalesce(stated, let(F.lower(F.coalesce(body, F.lit(""))), lambda t: groups.match(t, rules.strong)))
    return F.coalesce(stated, match(F.coalesce(body, F.lit("")), F.filter(groups, lambda g: rules.strong(g["alias"]))))


def match_join(reports: DataFrame, groups: DataFrame, id: str, text: Column) -> DataFrame:
    """id with alias, nexus, cs and motivation of the best match, for catalogues of any size.

    Aliases meet texts by their longest word (which is seldom a common one), an equi-join of ids and words without the texts; texts come
    to the reports that have such a word, and aliases are then checked as a whole. An alias without letters or digits matches nothing.
    """
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0)))
    longest = F.array_max(F.transform(tokens(F.col("alias")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    lower = reports.select(F.col(id).alias("_id"), F.lower(text).alias("t"))
    words = lower.select("_id", F.explode(tokens(F.col("t"))).alias("w"))
    keyed = groups.withColumn("key", longest).where("key is not null")
    # only words that some alias has are shuffled further, and of each report once
    met = words.join(keyed, F.col("w") == F.col("key")).drop("w", "key")
    hits = lower.join(met.withColumnRenamed("_id", id), F.col("_id") == F.col(id)).where(named_in(F.col("t"), F.col("alias")))
    best = F.min_by(F.struct("alias", "nexus", "cs", "motivation"), F.struct(-F.length("alias"), "ord", "alias")).alias("g")
    return hits.groupBy(id).agg(best).select(id, "g.*")


def named_actor(cs: Column, label: Column, any_label: bool = False) -> Column:
    """The specific group a report stores; any_label lets a bare family stand as well, as lanes do and cards don't."""
    c, lab = F.trim(cs), F.trim(label)
    return F.when(rules.specific(c), c).when((F.coalesce(lab, F.lit("")) != "") & (F.lit(any_label) | rules.specific(lab)), lab)


def cards(rows: DataFrame, key: str, last: str = NONE, items: int = 5) -> DataFrame:
    """label, total and place of each card, largest first, ties by label, `last` at the end; counted before the shuffle."""
    totals = rows.groupBy(F.coalesce(F.col(key), F.lit(last)).alias("label")).agg(F.count("*").alias("total"))
    order = Window.orderBy((F.col("label") == last).cast("int"), F.col("total").desc(), "label")
    return totals.withColumn("place", F.row_number().over(order))


def card_items(rows: DataFrame, key: str, items: int = 5, last: str = NONE) -> DataFrame:
    """The first page of each card, newest first, beside the full total."""
    own = Window.partitionBy("label").orderBy(F.col("published_at").desc_nulls_last(), "id")
    return rows.withColumn("label", F.coalesce(F.col(key), F.lit(last))).withColumn("place", F.row_number().over(own)).where(F.col("place") <= items)


def section_rows(reports: DataFrame, ecrime: Column, hacktivism: Column) -> DataFrame:
    """Reports with section (ecrime or hacktivism) and actor; those without a signal for either are left out."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    r = reports.withColumns({"_named": named_actor(F.col("crowdstrike_adversary"), F.col("adversary_label")), "_h": match(text, hacktivism)["cs"], "_e": match(text, ecrime)["cs"], "_k": has(text, rules.HACKTIVISM)})
    other = ~F.coalesce(F.col("motivation").isin("ecrime", "hacktivism"), F.lit(False))
    section = F.when(F.col("motivation").isin("ecrime", "hacktivism"), F.col("motivation")).when(F.col("_h").isNotNull() | F.col("_k"), "hacktivism").when(F.col("_e").isNotNull(), "ecrime")
    actor = F.when(F.col("motivation") == "ecrime", F.coalesce("_named", "_e")).when(F.col("motivation") == "hacktivism", F.coalesce("_named", "_h")).when(other, F.coalesce("_h", F.when(~F.col("_k"), F.col("_e"))))
    return r.withColumns({"section": section, "actor": F.coalesce(actor, F.lit(NONE))}).where("section is not null").drop("_named", "_h", "_e", "_k")


def events(reports: DataFrame, ecrime: Column, hacktivism: Column) -> DataFrame:
    """id, date, actor, category and kind of the timeline's events; a report gives one or none."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    r = reports.where("published_at is not null").withColumns({"_n": named_actor(F.col("crowdstrike_adversary"), F.col("adversary_label"), any_label=True), "_h": match(text, hacktivism)["cs"], "_e": match(text, ecrime)["cs"], "_k": has(text, rules.HACKTIVISM)})
    n, h, e = F.col("_n"), F.col("_h"), F.col("_e")
    to = lambda category, actor: F.struct(F.lit(category).alias("category"), actor.alias("actor"))
    crew = F.coalesce(n, e)
    breach = F.when(h.isNotNull(), to("hacktivism", F.coalesce(n, h))).when(crew.isNotNull(), to("ecrime", crew)).otherwise(to("breach", F.lit("Breaches")))
    unknown = {"nation_state": "UNID BAT", "ecrime": "UNID SPIDER", "hacktivism": "UNID JACKAL"}
    research = None
    for motive, lane in unknown.items():
        hit = to(motive, F.coalesce(n, F.lit(lane)))
        research = F.when(F.col("motivation") == motive, hit) if research is None else research.when(F.col("motivation") == motive, hit)
    research = research.when(h.isNotNull(), to("hacktivism", h)).when(F.col("_k"), to("hacktivism", F.lit("UNID JACKAL"))).when(e.isNotNull(), to("ecrime", e))
    lane = F.when(F.col("kind") == "exploit", F.when(F.col("exploit_status") == "poc", to("exploit", F.lit("Exploits")))).when(F.col("kind") == "breach", breach).when(F.col("kind") == "research", research)
    shown = F.when(F.col("kind").isin("exploit", "breach"), F.col("kind")).otherwise("report")
    return r.withColumn("_lane", lane).where("_lane is not null").select("id", F.col("published_at").alias("date"), "_lane.actor", "_lane.category", shown.alias("kind"))


ORDER = ("nation_state", "ecrime", "hacktivism", "breach", "exploit")


def lanes(found: DataFrame, first: str = "id") -> DataFrame:
    """actor, category of its first event, count, place and hue (a palette index, only for named lanes)."""
    g = found.groupBy("actor").agg(F.min_by("category", first).alias("category"), F.count("*").alias("n"))
    unid = F.col("actor").rlike(r"(?i)^unid(?![0-9A-Za-z_])")
    order = Window.orderBy(F.array_position(F.array(*map(F.lit, ORDER)), F.col("category")), unid.cast("int"), F.col("n").desc(), "actor")
    named = ~unid & ~F.col("category").isin("exploit", "breach")
    hue = F.when(named, (F.sum(named.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1) % 12)
    return g.withColumns({"place": F.row_number().over(order), "hue": hue.cast("int")})


def visible(toggles: dict[str, bool]) -> Column:
    """Whether an event passes the toggles nation_state, ecrime, hacktivism, breaches and exploits."""
    on = lambda k: F.lit(toggles.get(k, True))
    lane = F.when(F.col("category") == "exploit", on("exploits")).when(F.col("category") == "breach", on("breaches"))
    for motive in ("nation_state", "ecrime", "hacktivism"):
        lane = lane.when(F.col("category") == motive, on(motive) & (F.col("kind").isin("breach") & on("breaches") | ~F.col("kind").isin("breach")))
    return F.coalesce(lane, F.lit(True))


def provisional(met: DataFrame, actors: DataFrame) -> DataFrame:
    """Rows of the catalogue for actors first met in reports (name, nexus, ord): names in ASCII that are specific, matchable and not UNID, and
    that no known actor or alias has, each once. A country means a state behind it; aliases are for people to decide."""
    name = F.trim(to_ascii(F.col("name")))
    m = met.withColumn("name", name).where(rules.specific(F.col("name")) & rules.matchable(F.col("name")) & ~F.col("name").rlike(r"(?i)^unid(?![0-9A-Za-z_])"))
    first = m.groupBy(F.lower("name").alias("k")).agg(F.min_by(F.struct("name", "nexus"), "ord").alias("f"))
    none = F.array().cast("array<string>")
    known = actors.select(F.explode(F.concat(F.array("name"), F.coalesce("community_identifiers", none), F.coalesce("internal_alternative_names", none))).alias("raw")).select(F.lower(F.trim("raw")).alias("k")).distinct()
    country = None
    for at, nexus in rules.NEXUS_OF.items():
        country = F.when(F.col("nexus") == nexus, at) if country is None else country.when(F.col("nexus") == nexus, at)
    new = first.join(known, "k", "left_anti").select("f.name", "f.nexus").withColumn("country", country)
    return new.select("name", F.coalesce("nexus", F.lit("other")).alias("nexus"), "country", F.when(F.col("country").isNotNull(), F.array(F.lit("nation_state"))).alias("motivation"), none.alias("community_identifiers"), none.alias("internal_alternative_names"), F.lit("provisional").alias("status"))


def edited(reports: DataFrame, edits: DataFrame, actors: DataFrame) -> DataFrame:
    """reports after attribution by hand (edits: id, typed).

    A name or alias of the catalogue gives the actor with its country and first motivation, a family (alone or behind UNID) its own, and
    the report becomes research unless it is an exploit; what is empty takes the attribution away and leaves the rest; what is neither
    changes nothing. The column recognised tells.
    """
    none = F.array().cast("array<string>")
    every = F.concat(F.array("name"), F.coalesce("community_identifiers", none), F.coalesce("internal_alternative_names", none))
    at = F.col("country") if "country" in actors.columns else F.lit(None).cast("string")
    names = actors.select("ord", "name", at.alias("country"), F.get("motivation", F.lit(0)).alias("motivation"), F.explode(every).alias("raw"))
    known = names.groupBy(F.lower(F.trim("raw")).alias("k")).agg(F.min_by(F.struct("name", "country", "motivation"), "ord").alias("a")).where("k <> ''")
    e = edits.select(F.col("id").alias("_id"), F.trim(F.coalesce("typed", F.lit(""))).alias("typed")).join(known, F.lower("typed") == F.col("k"), "left").drop("k")
    family = F.upper(F.regexp_extract("typed", r"(?i)^(?:unid\s+)?([a-z]+)\z", 1))
    e = e.withColumn("family", F.when(F.col("a").isNull() & family.isin(*rules.FAMILIES), family))
    by_family = lambda of: F.coalesce(*(F.when(F.col("family") == k, F.lit(v).cast("string")) for k, v in of.items()))
    motives = {k: {"SPIDER": "ecrime", "JACKAL": "hacktivism"}.get(k, "nation_state") for k in rules.FAMILIES}
    j = reports.join(e, F.col("id") == F.col("_id"), "left")
    asked, actor, clear = F.col("_id").isNotNull(), F.col("a").isNotNull(), F.col("typed") == ""
    named = asked & (actor | F.col("family").isNotNull())
    pick = lambda new, old: F.when(named, new).otherwise(F.col(old))
    gone = asked & clear
    return j.withColumns({
        "kind": F.when(named & (F.col("kind") != "exploit"), "research").otherwise(F.col("kind")),
        "adversary_label": F.when(gone, None).otherwise(pick(F.coalesce("a.name", F.upper("typed")), "adversary_label")),
        "crowdstrike_adversary": F.when(gone, None).otherwise(pick(F.col("a.name"), "crowdstrike_adversary")),
        "country": pick(F.when(actor, F.col("a.country")).otherwise(by_family(rules.FAMILIES)), "country"),
        "motivation": pick(F.when(actor, F.col("a.motivation")).otherwise(by_family(motives)), "motivation"),
        "recognised": F.when(asked, named | clear),
    }).drop("_id", "typed", "a", "family")


def collisions(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs of actors that share a name or alias, and on which: an equi-join of exploded names."""

    def names(df: DataFrame, as_name: str) -> DataFrame:
        none = F.array().cast("array<string>")
        every = F.concat(F.array("name"), F.coalesce("community_identifiers", none), F.coalesce("internal_alternative_names", none))
        return df.select(F.col("name").alias(as_name), F.explode(every).alias("raw")).select(as_name, F.lower(F.trim("raw")).alias("on")).where(F.col("on") != "").distinct()

    return names(proposed, "proposed").join(names(existing, "existing"), "on").groupBy("proposed", "existing").agg(F.min("on").alias("on"))
