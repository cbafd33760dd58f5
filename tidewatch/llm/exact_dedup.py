"""Exact deduplication through a persistent digest index.

Texts are equal when they are identical after each run of [\\x20\\x09-\\x0D] is replaced by one space; a null text counts as empty.
Of equal texts the row with the smallest doc_id stays (a null doc_id comes last; of rows that share that doc_id one stays). doc_id is
read as a long, so a text that is no number raises.

The index is a Parquet table bucketed and sorted by digest, so that new data meet it by a sort-merge anti-join that shuffles the new
digests only. Its number of buckets is written beside it and read when it is opened again; another number is refused. Each entry names
the load that brought it. Loads have names, which their sender gives: a load that is repeated under its name, also after it failed
half-way, finds its own entries and keeps the same rows again, while the same rows under another name are a second delivery, of which
nothing is kept. A sender without names may choose to have loads known by what they hold; then a second delivery is a repeat.

Digests of new data are counted before the shuffle, hence a text with millions of copies moves as one row per task. Rows find their
group's entry again by a join; digests that hold at least a thousandth of all rows (a thousand at most) are broadcast and their rows
stay where they are, all others are joined by digest.

Null and empty texts are copies of each other; very long texts are hashed whole; other columns are not read, so their names cannot
clash; an empty table returns no rows and adds none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.shared import WHITE, exists, partitions, shared_path, written

#: A digest is heavy if it has at least one row in so many; so there are at most so many heavy digests.
HEAVY = 1000


def normalised(text: str) -> "F.Column":
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), WHITE, " ")


class DigestIndex:
    """Digests seen so far with the doc_id that stays, the number of rows and the load, under a path in shared storage.

    A new index gets `buckets` buckets (by default as many as there are shuffle partitions). One that exists keeps its own number, and
    asking for another raises. One load is written at a time.
    """

    SCHEMA = "digest BINARY, keep_id BIGINT, group_size BIGINT, load STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        if not exists(spark, f"{path}/layout"):
            spark.range(1).select(F.lit(buckets or partitions(spark)).alias("buckets")).write.parquet(f"{path}/layout")
        self.buckets = spark.read.parquet(f"{path}/layout").first().buckets
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index at {path} has {self.buckets} buckets, not {buckets}")

    def table(self) -> str:
        """The entries as a table of the catalogue, which is needed to read and write buckets; whoever makes it drops it."""
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/entries'")
        return name

    def entries(self) -> DataFrame:
        """The entries there are now. The plan holds their files, so the table of the catalogue need not stay."""
        name = self.table()
        found = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return found

    def append(self, rows: DataFrame) -> None:
        name = self.table()
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(name)
        self.spark.sql(f"DROP TABLE {name}")

    def dedup(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", load: str | None = None, by_content: bool = False) -> DataFrame:
        """One row per row of docs: doc_id, keep_id, group_size, kept and text_sha256; digests not in the index yet are appended.

        keep_id and group_size are those of the index entry, so a copy of an earlier load is not kept, even with a smaller doc_id,
        and group_size counts the rows of the load that brought the text first. load is the load's name; without one, by_content must
        say that the same ids and texts are the same load.
        """
        if (load is None) != by_content:
            raise ValueError("a load needs a name, or by_content in its place")
        columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"))
        thin = written(columns.withColumn("row", F.monotonically_increasing_id()), "digests")  # row is fixed once it is written
        mark = F.xxhash64("doc_id", "digest").cast("decimal(38,0)")
        sums = [F.coalesce(F.sum(mark), F.lit(0)), F.coalesce(F.sum(F.pmod(mark * 31, F.lit(1_000_000_007))), F.lit(0))] if by_content else []
        rows, *marks = thin.agg(F.count("*"), *sums).first()
        load = load or "-".join(map(str, (rows, *marks)))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row"))
        # written, else the optimiser moves the anti-join below the aggregate and shuffles every copy of a text
        groups = written(thin.groupBy("digest").agg(least.alias("first"), F.count("*").alias("group_size")), "digest-groups")
        known = self.entries().select("digest")
        new = groups.join(known.hint("merge"), "digest", "left_anti")
        self.append(new.select("digest", F.col("first.doc_id").alias("keep_id"), "group_size", F.lit(load).alias("load")))

        own = groups.select("digest", F.col("first.row").alias("first_row"))
        entry = F.struct("keep_id", "group_size", F.when(F.col("load") == load, F.col("first_row")).alias("keep_row")).alias("e")
        entries = self.entries().join(own.hint("merge"), "digest").select(F.col("digest").alias("of"), entry)
        hot = groups.where(F.col("group_size") * HEAVY >= rows).select("digest")
        heavy = entries.join(F.broadcast(hot), F.col("of") == F.col("digest")).select(F.col("of").alias("heavy_of"), F.col("e").alias("h"))
        # rows of heavy digests get keys of another length that match nothing and spread evenly
        probe = F.when(F.col("h").isNull(), F.col("digest")).otherwise(F.unhex(F.md5(F.col("row").cast("string"))))
        found = thin.join(F.broadcast(heavy), F.col("digest") == F.col("heavy_of"), "left").withColumn("probe", probe).join(entries, F.col("probe") == F.col("of"), "left")
        entry = F.coalesce("h", "e")
        kept = F.coalesce(F.col("row") == entry["keep_row"], F.lit(False))
        return found.select("doc_id", entry["keep_id"].alias("keep_id"), entry["group_size"].alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, index_path: str | None = None, load: str | None = None) -> DataFrame:
    """docs against a new index, or, as the load of that name, against the one at index_path."""
    spark = docs.sparkSession
    if index_path is None:
        return DigestIndex(spark, shared_path(spark, "digest-index")).dedup(docs, load=load or "first")
    return DigestIndex(spark, index_path).dedup(docs, load=load)
