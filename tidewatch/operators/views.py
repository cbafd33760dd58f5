"""Views over reports and sources: windows, counts, caps, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import to_ascii

from tidewatch.functions import rules

NEWEST = ("published_at", "id")


def newest(*tie: str) -> list[Column]:
    return [F.col("published_at").desc_nulls_last(), *(F.col(c) for c in tie or ("id",))]


def since(rows: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Rows of the last days, the first of them included; undated rows are not in any window."""
    return rows.where(F.col("published_at") >= F.date_sub(as_of, days))


def window(rows: DataFrame, kind: str, as_of: Column, days: int) -> DataFrame:
    return since(rows.where(F.col("kind") == kind), as_of, days)


def shown(rows: DataFrame, hidden: DataFrame) -> DataFrame:
    return rows.join(hidden.select("raw_hash").distinct(), "raw_hash", "left_anti")


def snapped(days: Column) -> Column:
    """One of the offered ranges, else 90."""
    return F.when(days.isin(7, 14, 30, 90, 182, 365), days.cast("int")).otherwise(90)


def tooltip(text: Column) -> Column:
    """Trimmed; over 180 characters cut there and marked; null if empty."""
    t = F.trim(text)
    return F.when(F.length(t) > 180, F.concat(F.rtrim(F.substring(t, 1, 180)), F.lit("..."))).when(t != "", t)


def window_counts(rows: DataFrame, as_of: Column) -> DataFrame:
    """period, nation_state, breaches, vulns and exploit statuses: three trailing windows from one pass."""
    cuts = {"last24h": 1, "last7d": 7, "last30d": 30}
    cols = []
    for name, days in cuts.items():
        inside = F.col("published_at") >= F.date_sub(as_of, days)
        count = lambda test, inside=inside: F.count_if(inside & F.coalesce(test, F.lit(False)))
        exploit = F.col("kind") == "exploit"
        cols.append(F.struct(F.lit(name).alias("period"), count((F.col("kind") == "research") & (F.col("motivation") == "nation_state")).alias("nation_state"), count(F.col("kind") == "breach").alias("breaches"), count(exploit).alias("vulns"), *(count(exploit & (F.col("exploit_status") == s)).alias(s) for s in ("confirmed", "poc", "suspected"))))
    return rows.agg(F.array(*cols).alias("w")).select(F.inline("w"))


def by_actor(rows: DataFrame, as_of: Column) -> DataFrame:
    """label, last24h, last7d, last30d over research reports."""
    label = F.coalesce(F.col("country"), F.when(F.col("motivation") == "nation_state", "Non Attributed").otherwise("Unattributed"))
    r = since(rows.where("kind = 'research'"), as_of, 30)
    return r.groupBy(label.alias("label")).agg(*(F.count_if(F.col("published_at") >= F.date_sub(as_of, d)).alias(n) for n, d in (("last24h", 1), ("last7d", 7), ("last30d", 30))))


BANDS = (("last24h", 1, 18), ("days2to7", 7, 18), ("days8to30", 30, 16))


def evidence(rows: DataFrame, as_of: Column) -> DataFrame:
    """id_no, period and the rows of a balanced sample: newest of three bands, each story once."""
    r = since(rows, as_of, 30)
    key = F.coalesce("raw_hash", "url", F.concat_ws(":", "kind", "title"))
    one = r.withColumn("_k", key).withColumn("_first", F.row_number().over(Window.partitionBy("_k").orderBy(*newest()))).where("_first = 1")
    age = F.datediff(as_of, F.col("published_at"))
    period, rank, limit = None, None, None
    for i, (name, days, most) in enumerate(BANDS):
        pick = lambda so_far, v, days=days: F.when(age <= days, v) if so_far is None else so_far.when(age <= days, v)
        period, rank, limit = pick(period, F.lit(name)), pick(rank, F.lit(i)), pick(limit, F.lit(most))
    b = one.withColumns({"period": period, "_band": rank, "_most": limit})
    # each band is cut by its own top rows, so the last numbering sees 52 rows at most
    b = b.withColumn("_n", F.row_number().over(Window.partitionBy("_band").orderBy(*newest()))).where("_n <= _most")
    return b.withColumn("id_no", F.row_number().over(Window.orderBy("_band", "_n"))).drop("_k", "_first", "_band", "_most", "_n")


def evidence_line(line: Column | None = None) -> Column:
    """One line of evidence from the columns of `evidence`."""
    cut = lambda c, n: F.substring(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")), 1, n)
    some = lambda c, other: F.when(c == "", other).otherwise(c)
    return F.concat(F.lit("["), F.col("id_no").cast("string"), F.lit("] window="), "period", F.lit("; date="), F.coalesce(F.col("published_at").cast("string"), F.lit("unknown")), F.lit("; source="), some(cut("source_name", 100), "unknown"), F.lit("; title="), cut("title", 240), F.lit("; synopsis="), some(cut("description", 520), "No synopsis available."))


def page(rows: DataFrame, number: float | None, size: int | None, *order: Column) -> DataFrame:
    """A page with the column total; no size gives all, a bad number the first page."""
    total = rows.count()
    if size is not None:
        n = int(number) if number is not None and number == number and number >= 1 else 1
        rows = rows.orderBy(*order).offset((n - 1) * size).limit(size)
    return rows.withColumn("total", F.lit(total))


def top_per(rows: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)


def ticker(rows: DataFrame, as_of: Column) -> DataFrame:
    """Proofs of concept and breaches since yesterday, newest first."""
    r = since(rows, as_of, 1)
    poc = r.where("kind = 'exploit' and exploit_status = 'poc'")
    return poc.unionByName(r.where("kind = 'breach'")).orderBy(*newest())


def stale(sources: DataFrame, now: Column, days: int = 30) -> DataFrame:
    blank = F.coalesce(F.col("feed_url"), F.lit("")) == ""
    return sources.where(F.col("active") & ~blank & (F.col("last_item_at").isNull() | (F.col("last_item_at") < now - F.make_dt_interval(F.lit(days))))).orderBy(F.col("last_item_at").asc_nulls_first(), "name")


def drop_histogram(dropped: DataFrame) -> DataFrame:
    """category, n, place in the fixed order; categories without rows are not there."""
    order = F.array(*map(F.lit, rules.DROP_KINDS))
    return dropped.groupBy(rules.drop_kind(F.col("reason")).alias("category")).agg(F.count("*").alias("n")).withColumn("place", F.array_position(order, F.col("category")).cast("int"))


def keep_rate(kept: Column, dropped: Column) -> Column:
    """struct(percent, hue, alpha), halves rounded up; null where nothing was seen."""
    n, share = kept + dropped, kept / F.nullif(kept + dropped, F.lit(0))
    up = lambda x: F.floor(x + 0.5).cast("int")
    return F.when(n > 0, F.struct(up(share * 100).alias("percent"), up(share * 140).alias("hue"), (F.floor(F.least(F.lit(1.0), n / 5.0) * 100 + 0.5) / 100.0).alias("alpha")))


def sources_found(sources: DataFrame, name: str = "", category: str | None = None, active: bool | None = None) -> DataFrame:
    """Sources whose name holds a text (case ignored), of a category and active or not, where these are asked for."""
    out = sources.where(F.lower("name").contains(name.strip().lower()))
    out = out if category is None else out.where(F.col("category") == category)
    return out if active is None else out.where(F.col("active") == active)


def actors_found(actors: DataFrame, name: str = "", motivation: str | None = None, alias: str = "") -> DataFrame:
    """Actors by a part of their name, their first motivation, and a part of any alias."""
    none = F.array().cast("array<string>")
    out = actors.where(F.lower("name").contains(name.strip().lower()))
    out = out if motivation is None else out.where(F.get("motivation", F.lit(0)) == motivation)
    every = F.concat(F.coalesce("community_identifiers", none), F.coalesce("internal_alternative_names", none))
    return out if not alias.strip() else out.where(F.exists(every, lambda a: F.lower(a).contains(alias.strip().lower())))


def technique_names(asked: DataFrame, named: DataFrame) -> DataFrame:
    """asked (with code) with the technique's name, or its parent's where a sub-technique has none of its own; named: code, name."""
    known = named.select(F.upper("code").alias("known"), "name")
    own = asked.join(known.withColumnRenamed("name", "_own"), F.upper("code") == F.col("known"), "left").drop("known")
    parent = F.regexp_extract(F.upper("code"), r"^[^.]+", 0)
    return own.join(known, parent == F.col("known"), "left").withColumn("name", F.coalesce("_own", "name")).drop("known", "_own")


def section_totals(rows: DataFrame, key: str) -> DataFrame:
    """The sum of a section's cards; rows without a section are in none."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("total"))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key, undated ones last, ties by id."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(F.col(at).isNotNull(), at, -F.col("id"))).alias("r")
    return rows.groupBy(key).agg(best).select(key, "r.*")


def unclassified(rows: DataFrame, most: int = 500) -> DataFrame:
    """The newest reports that no model has read."""
    return rows.where("classified_by = 'rules'").orderBy(F.col("created_at").desc(), "id").limit(most)


def dropped_list(dropped: DataFrame, now: Column, source: str | None = None, days: int = 30, most: int = 500) -> DataFrame:
    """The newest drops of the last days; a source is chosen before the cut, so that its drops are not lost behind others."""
    rows = dropped.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))
    rows = rows if source is None else rows.where(F.col("source_name") == source)
    return rows.orderBy(F.col("created_at").desc(), "raw_hash").limit(most)


def open_flags(flags: DataFrame, most: int = 500) -> DataFrame:
    return flags.where("resolved_at is null").orderBy(F.col("reports").desc(), "id").limit(most)


def tally(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("source_name").agg(F.count_if(F.col("kept")).alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


def advanced(sources: DataFrame, items: DataFrame) -> DataFrame:
    """sources with last_item_at at noon of their newest item's day, unless it is at the end of that day or later already."""
    latest = items.groupBy(F.col("source_name").alias("s")).agg(F.max("published_at").alias("latest"))
    noon = F.col("latest").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(12))
    end = F.col("latest").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59))
    moved = F.when(F.col("latest").isNotNull() & (F.col("last_item_at").isNull() | (F.col("last_item_at") < end)), noon).otherwise(F.col("last_item_at"))
    return sources.join(latest, F.col("name") == F.col("s"), "left").withColumn("last_item_at", moved).drop("s", "latest")


def memory_update(memory: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes by (kind, subject, case ignored): new ones with one mention, known ones with one more for each note, newest content."""
    n = notes.groupBy("kind", F.lower("subject").alias("k")).agg(F.max_by("subject", "ord").alias("new_subject"), F.max_by("content", "ord").alias("new_content"), F.count("*").alias("times"), F.max("seen").alias("new_seen"))
    m = memory.withColumn("k", F.lower("subject"))
    j = m.join(n, ["kind", "k"], "full_outer")
    return j.select("kind", F.coalesce("subject", "new_subject").alias("subject"), F.coalesce("new_content", "content").alias("content"), (F.coalesce("mentions", F.lit(0)) + F.coalesce("times", F.lit(0))).alias("mentions"), F.coalesce("new_seen", "last_seen").alias("last_seen"))


def memory_brief(memory: DataFrame) -> DataFrame:
    """The notes of a briefing: 16 adversaries and 6 trends by recency, 40 labels by mentions."""
    recent, often = [F.col("last_seen").desc(), F.col("mentions").desc(), F.col("subject")], [F.col("mentions").desc(), F.col("last_seen").desc(), F.col("subject")]
    part = lambda kind, most, order: top_per(memory.where(F.col("kind") == kind), "kind", most, *order)
    return part("adversary", 16, recent).unionByName(part("trend", 6, recent)).unionByName(part("label", 40, often))


#: Characters of a briefing.
BRIEF_CHARS = 2600


def memory_text(memory: DataFrame, most: int = BRIEF_CHARS) -> DataFrame:
    """One row: the briefing as plain ASCII text, cut at `most` characters; empty where there is nothing to tell.

    A heading and a line a note for adversaries and trends, and one line of all labels. The notes are few by then, so they meet in one row.
    """
    note = F.concat(F.lit("- "), "subject", F.lit(": "), "content")
    recent, often = [F.negative("_seen"), -F.col("mentions"), F.col("subject")], [-F.col("mentions"), F.negative("_seen"), F.col("subject")]

    def block(kind: str, order: list[Column], line: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), line.alias("line")))))
        return F.transform(rows, lambda r: r["line"])

    # dates and numbers alike are ordered as numbers
    seen = F.unix_date("last_seen") if dict(memory.dtypes)["last_seen"] == "date" else F.col("last_seen").cast("double")
    notes = memory_brief(memory).withColumn("_seen", seen)
    parts = notes.agg(block("adversary", recent, note).alias("a"), block("trend", recent, note).alias("t"), block("label", often, F.col("subject")).alias("l"))
    headed = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.array(F.lit(title)), rows)).otherwise(F.array().cast("array<string>"))
    labels = F.when(F.size("l") > 0, F.array(F.concat(F.lit("Known labels (reuse the exact label when it applies): "), F.array_join("l", ", ")))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(headed("Known adversaries:", F.col("a")), headed("Tracked trends:", F.col("t")), labels)
    return parts.select(F.substring(to_ascii(F.array_join(lines, "\n"), keep_newlines=True), 1, most).alias("brief"))


def unread(notifications: DataFrame, most: int = 30) -> DataFrame:
    """The newest notifications, each with the number of unread ones in the whole table."""
    n = notifications.where("read_at is null").count()
    return notifications.orderBy(F.col("created_at").desc(), "id").limit(most).withColumn("unread", F.lit(n))


def poll(rows: DataFrame, cursor, most: int = 20) -> DataFrame:
    return rows.where(F.col("created_at") > cursor).orderBy(F.col("created_at").desc(), "id").limit(most)


def lookup(rows: DataFrame, key: str) -> DataFrame:
    """By raw_hash, else by id where the key looks like one."""
    hit = rows.where((F.col("raw_hash") == key) | (F.col("id").cast("string") == key))
    return hit.orderBy((F.col("raw_hash") != key).cast("int"), "id").limit(1)


def browse(rows: DataFrame, hidden: DataFrame, test: Column, most: int = 200) -> DataFrame:
    """The newest rows that satisfy test, then without hidden ones; truncated tells if still more than `most` are left."""
    cut = shown(rows.where(test).orderBy(*newest()).limit(most + 1), hidden)
    n = cut.count()
    return cut.orderBy(*newest()).limit(most).withColumn("truncated", F.lit(n > most))


def ioc_lookup(terms: DataFrame, iocs: DataFrame, links: DataFrame, reports: DataFrame, most: int = 50) -> DataFrame:
    """term, id, place, total for each searched value, newest first; a term without a hit stays with null id."""
    t = terms.select("term", F.lower(F.trim("term")).alias("k")).dropDuplicates(["k"])
    hit = t.join(iocs.select("ioc_id", F.lower("value").alias("k")), "k").join(links, "ioc_id").join(reports.select(F.col("id").alias("item_id"), "published_at"), "item_id").select("term", F.col("item_id").alias("id"), "published_at").distinct()
    total = hit.groupBy("term").agg(F.count("*").alias("total"))
    best = top_per(hit, "term", most, *newest())
    return t.select("term").join(best, "term", "left").join(total, "term", "left").select("term", "id", "place", F.coalesce("total", F.lit(0)).alias("total"))


def capped(values: DataFrame, most: int = 60) -> DataFrame:
    """The first distinct values in order, and on each row how many there are beyond the cap."""
    v = values.groupBy("value").agg(F.min("ord").alias("ord"))
    n = v.count()
    return v.orderBy("ord").limit(most).withColumn("overflow", F.lit(max(0, n - most)))


def reading_list(bookmarks: DataFrame, reports: DataFrame) -> DataFrame:
    return bookmarks.join(reports, "id").orderBy(F.col("bookmarked_at").desc(), "id")


def candidates(iocs: DataFrame, links: DataFrame, judged: DataFrame, allow: DataFrame, most: int = 80) -> DataFrame:
    """Indicators to review: addresses, domains and hashes in two reports or more, neither judged nor on the list."""
    from tidewatch.functions.indicators import not_allowed

    n = links.select("ioc_id", "item_id").distinct().groupBy("ioc_id").agg(F.count("*").alias("reports")).where("reports >= 2")
    c = iocs.where(F.col("ioc_type").isin("ip", "domain", "file_hash")).join(n, "ioc_id").join(judged.select("ioc_id").distinct(), "ioc_id", "left_anti")
    return not_allowed(c, allow).orderBy(F.col("reports").desc(), "value").limit(most)
