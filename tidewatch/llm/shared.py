"""Places that driver and executors share, and small helpers used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local master gets a new temporary one, and a cluster raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own for each call."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Tables that this session has written and that plans may still read.
_held: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    _held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Drops what written() has kept, from the since-th table on but for the last `keep`, when nothing will read it any more."""
    end = len(_held) - keep
    delete(spark, *_held[since:end])
    del _held[since:end]


def held() -> int:
    """The number of tables that written() keeps."""
    return len(_held)


class Scratch:
    """Tables in the shared folder by name, so that those no later plan reads can be dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, shared_path(spark, name)
        _held.append(self.at)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        delete(self.spark, *(f"{self.at}/{name}" for name in names))


def column(name: str) -> "F.Column":
    """The column of that very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *drop: str) -> "F.Column":
    """All columns of df but those named, as one struct: whatever they are called, they cannot clash with columns beside it."""
    away = {name.lower() for name in drop}
    rest = [column(c).alias(c) for c in df.columns if c.lower() not in away]
    return F.struct(*rest) if rest else F.struct(F.lit(None).cast("string").alias("none"))


def unpacked(df: DataFrame, own: str, of: DataFrame, *drop: str) -> list:
    """The columns that packed() put into own."""
    away = {name.lower() for name in drop}
    return [F.col(own).getField(c).alias(c) for c in of.columns if c.lower() not in away]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, order: list, name: str, **sums: str) -> DataFrame:
    """df with `place` (from 0) in the order given, and for each new=old of sums the sum of column old over all rows before.

    Rows are range-partitioned and written, so that partitions stay as they are; each starts at the sums of those before it. No task
    holds more than a partition, but for the one that adds up one row per partition.
    """
    parts = partitions(df.sparkSession)
    placed = written(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), name)
    of = {"place": F.count("*")} | {new: F.sum(old) for new, old in sums.items()}
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(*(f.alias(f"total_{new}") for new, f in of.items()))
    totals = totals.select("part", *(F.coalesce(F.sum(f"total_{new}").over(earlier), F.lit(0)).alias(f"from_{new}") for new in of))
    within = Window.partitionBy("part").orderBy(*order)
    before = {"place": F.row_number().over(within) - 1} | {new: F.coalesce(F.sum(old).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for new, old in sums.items()}
    rows = placed.select("*", *(f.alias(f"in_{new}") for new, f in before.items())).join(F.broadcast(totals), "part")
    return rows.select(*df.columns, *((F.col(f"from_{new}") + F.col(f"in_{new}")).alias(new) for new in of))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column) -> "F.Column":
    """crc32(doc_id as text) mod 5; a null doc_id counts as empty text. Rows where it is 0 are held out."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 5


def batches_by_bytes(rows: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of about limit bytes of each batch, so that Python objects for words stay few; null texts count as empty."""
    for batch in rows:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        start = size = 0
        part: list[bytes] = []
        for i, text in enumerate(texts):
            part.append(text.as_py() or b"")
            size += len(part[-1])
            if size >= limit:
                yield batch.slice(start, i + 1 - start), part
                start, size, part = i + 1, 0, []
        if part:
            yield batch.slice(start), part


class WordHash(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finishing step that spreads every bit of a 64-bit number over all others."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def wider(schema: T.StructType, more: str) -> T.StructType:
    """schema with the fields of a DDL string behind its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that share keys, from batches that are sorted by keys; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        values = list(zip(*columns, strict=True))
        start = 0
        for i, v in enumerate(values):
            if v != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, v
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
