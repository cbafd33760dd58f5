"""Consistent-hash sharding with virtual nodes and bounded loads.

Each shard stands on a ring at `vnodes` places; a row starts at the arc that its key's hash falls into, whose shard is the next place
clockwise. A shard's load is bounded by its exact share of the rows (n / shards, one more for the first n mod shards), so that counts
are at most one apart; rows that overflow a full shard continue clockwise to the next shard with room. All rows of an arc have
the same way round the ring, hence the counts of the arcs (shards * vnodes, a fixed number) decide everything: the filling is planned
over them, arc by arc in rounds (in round r each arc offers its remaining rows to the r-th shard on its way), and gives runs of ranks
within an arc to shards. A row's rank within its arc is a row number within one of SALTS salts of the arc, plus the salts before it;
what stands before each salt is a running sum in Spark, so only the counts of arcs come to the driver.

With one more shard, an arc's rows move only where its way meets the new shard or where bounds shift; tests measure that.

A null key hashes like an empty text; rows with equal keys are spread over the salts by a hash of their text and take different slots
in the order of that hash. Rows that agree in key and text are interchangeable: they share a salt. Null texts count as empty, long
ones are hashed whole. An empty table gives no rows. All columns of the input stay, whatever they are called, but for columns called
shard and slot, which give way to those made here.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import column, packed, unpacked, written

SALTS = 1024
#: The ring has this many positions: the first 60 bits of an md5.
RING_DIGITS = 15


def place(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:RING_DIGITS], 16)


class Ring:
    """Places of the virtual nodes in order, and the way of shards from each arc."""

    def __init__(self, shards: int, vnodes: int = 64):
        at = sorted((place(f"shard-{s}-{v}"), s) for s in range(shards) for v in range(vnodes))
        self.shards, self.places, self.owners = shards, [p for p, _ in at], [s for _, s in at]

    def way(self, arc: int) -> list[int]:
        """Shards in clockwise order from an arc, each once."""
        return list(dict.fromkeys(self.owners[arc:] + self.owners[:arc]))

    def arc(self, position: int) -> int:
        return bisect.bisect_left(self.places, position) % len(self.places)


def fill(ring: Ring, counts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the ranks of each arc go. At most arcs times shards entries."""
    total, shards = sum(counts.values()), ring.shards
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, ways, done = [0] * shards, {a: ring.way(a) for a in counts}, dict.fromkeys(counts, 0)
    runs = []
    for turn in range(shards):
        for arc in sorted(counts):
            shard = ways[arc][turn]
            n = min(counts[arc] - done[arc], room[shard] - used[shard])
            if n > 0:
                runs.append((arc, done[arc], done[arc] + n, shard, used[shard]))
                used[shard] += n
                done[arc] += n
    return runs


def literal(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """A small table from values known on the driver."""
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def assign(docs: DataFrame, shards: int = 40, vnodes: int = 64, key: str = "doc_id") -> DataFrame:
    """docs with the columns shard and slot (gapless from 0 within its shard)."""
    ring = Ring(shards, vnodes)
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) if "text" in docs.columns else F.lit(0).cast("long")
    at = F.conv(F.substring(F.md5(F.coalesce(column(key).cast("string"), F.lit(""))), 1, RING_DIGITS), 16, 10).cast("long")
    keyed = docs.select(packed(docs, "shard", "slot").alias("own"), column(key).alias("key"), at.alias("ring_at"), text.alias("text_at"))
    # the arc of a position is the number of places before it: those before its cell of a uniform grid, which is known, and in its cell
    places = F.array(*map(F.lit, ring.places))
    cells = len(ring.places)
    width = (1 << (4 * RING_DIGITS)) // cells + 1
    first = F.array(*(F.lit(bisect.bisect_left(ring.places, c * width)) for c in range(cells + 1)))
    cell = F.floor(F.col("ring_at") / F.lit(width)).cast("int")
    low, high = F.element_at(first, cell + 1), F.element_at(first, cell + 2)
    inside = F.size(F.filter(F.slice(places, low + 1, high - low), lambda p: p < F.col("ring_at")))
    keyed = keyed.withColumns({"arc": F.pmod(low + inside, F.lit(cells)).cast("int"), "salt": F.pmod(F.xxhash64("ring_at", "text_at"), F.lit(SALTS)).cast("int")})

    bins = written(keyed.groupBy("arc", "salt").agg(F.count("*").alias("n")), "arcs")  # shards * vnodes * SALTS rows at most
    counts = {r.arc: r.n for r in bins.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # shards * vnodes rows at most
    before = Window.partitionBy("arc").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select("arc", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    runs = literal(docs, [{"run_arc": a, "lo": i, "hi": j, "shard": s, "base": b} for a, i, j, s, b in fill(ring, counts)], "run_arc int, lo long, hi long, shard int, base long")

    order = Window.partitionBy("arc", "salt").orderBy("ring_at", F.col("key").asc_nulls_last(), "text_at")
    ranked = keyed.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["arc", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    out = ranked.join(F.broadcast(runs), (F.col("arc") == F.col("run_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.select(*unpacked(out, "own", docs, "shard", "slot"), "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))


def shard_rows(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    thin = docs.select("doc_id", "text", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    thin = thin.drop("text").withColumn("text", F.col("text_crc32").cast("string"))
    return assign(thin, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
