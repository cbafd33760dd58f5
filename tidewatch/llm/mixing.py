"""Mixing sources to target weights by exact token budgets.

A document's size is its number of words (runs outside [\\x20\\x09-\\x0D]; null: none). Sources in order of code points, null last,
weigh `weights` in turn and share `share` of all words in these proportions, but none gets more than `epochs` times its own words;
the excess is shared again by weight among the others until none is above. Water-filling gives that in closed form: the target is
min(cap, weight * level), and the level follows from the sources ordered by cap / weight. Places and sums over the sources come from
distributed prefix sums, so there may be very many (web domains).

Within a source, documents are ordered by md5(doc_id) (ties by doc_id, size and the text's crc32, so reruns agree). The order is cut
into 4096 slices by the first three hex digits: rows are range-sorted by a running sum within (source, slice), and each slice starts
at the sum of the slices before it, so a source with a third of all rows is spread over 4096 groups. A source takes each document as
often as its target holds whole epochs, and in the last epoch those up to its budget; the document at the cut is taken in part.

A null doc_id is ordered by the md5 of its text, so rows without one are spread as well. Null and empty texts have no words and take
nothing; a source without words has target 0. Rows that repeat all are taken like different ones. Long texts are counted whole. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import packed, prefix_sums, unpacked, written

WORDS = r"[^\x20\x09-\x0D]+"
SLICE_DIGITS = 3
MADE = ("size", "source_size", "target", "taken", "start")


def budgets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """From (source, source_size): source, source_size and target. The table has a row for each source."""
    by_name = F.col("source").asc_nulls_last()
    s = prefix_sums(sizes, [by_name], "sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", weight.alias("weight"), (F.lit(float(epochs)) * F.col("source_size")).alias("cap")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = prefix_sums(s, [F.col("ratio"), by_name], "ratios", cap_before="cap", weight_before="weight")
    words, all_weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    goal = float(share) * words
    # full if the level that is left when all before it are full would exceed its cap
    s = s.withColumn("full", F.col("weight") * ((F.lit(goal) - F.col("cap_before")) / (F.lit(all_weight) - F.col("weight_before"))) >= F.col("cap"))
    held_cap, held_weight = s.where("full").agg(F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (goal - held_cap) / (all_weight - held_weight) if all_weight > held_weight else 0.0
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _taken(docs: DataFrame, weights: tuple[float, ...], share: float, epochs: int, *drop: str) -> DataFrame:
    """(own, size, source_size, target, taken, start): own holds the columns of docs but those in drop."""
    text = F.col("text").cast("string")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), text, F.lit("")))
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")
    # running sums are taken and starts met by this one key, a null source included, so rows are shuffled once; a slice has always three digits
    at = F.concat("slice", F.coalesce(F.concat(F.lit("."), F.col("source").cast("string")), F.lit("")))
    thin = docs.select(packed(docs, *drop).alias("own"), "source", F.col("doc_id").alias("id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc"), key.alias("order_key"))
    thin = thin.withColumn("slice", F.substring("order_key", 1, SLICE_DIGITS)).withColumn("at", at)

    slices = written(thin.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("source", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("slice_start"))
    sources = budgets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, epochs)
    starts = starts.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(at.alias("at"), "slice_start", "source_size", "target")

    running = Window.partitionBy("at").orderBy("order_key", F.col("id").asc_nulls_last(), "size", "text_crc").rowsBetween(Window.unboundedPreceding, -1)
    rows = thin.withColumn("running", F.coalesce(F.sum("size").over(running), F.lit(0)))
    rows = rows.join(starts, "at").withColumn("start", F.col("slice_start") + F.col("running"))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("start")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select("own", "size", "source_size", "target", taken.cast("long").alias("taken"), "start")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, keep_text: bool = False) -> DataFrame:
    """docs with size, source_size, target, taken (words) and start (words of its source before it), from one shuffle of the rows.

    Columns of docs are kept, text only with keep_text; on a clash of names those computed here win.
    """
    drop = MADE if keep_text else (*MADE, "text")
    rows = _taken(docs, weights, share, epochs, *drop)
    return rows.select(*unpacked(rows, "own", docs, *drop), *MADE)


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """The rows of the mix with all columns of docs, whatever they are called: a document comes once for each epoch that takes any of its words.

    Documents are not cut, so a source may exceed its target by less than its document at the cut. Documents without words cost
    nothing and stay once.
    """
    rows = _taken(docs, weights, share, epochs)
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    rows = rows.withColumn("times", times).where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(*unpacked(rows, "own", docs))
