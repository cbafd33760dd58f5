"""Stored tables that change in place, and an index of keys over all history.

A keyed table is Parquet in folders by bucket, a hash of its key. A change names keys and says what becomes of the rows of their buckets;
only these buckets are read and rewritten, all others keep their files. The new buckets are staged as a whole first and then put in place
by Spark's dynamic partition overwrite. Whoever opens a table finishes what it finds staged: so a change that fails half-way is either
not begun or can be put in place again, and readers after that see it whole. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources import sinks


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, at = _fs(spark, path)
        fs.delete(at, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty folder, whose name says all."""
    fs, at = _fs(spark, path)
    fs.mkdirs(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in path; none if there is no such folder."""
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def reading(spark: SparkSession, schema: str, path: str, *parts: str) -> DataFrame:
    """A partitioned Parquet table by its schema, whether or not anything has been written to it; parts are its partition columns."""
    kinds = T.StructType([*T.StructType.fromDDL(schema).fields, *T.StructType.fromDDL(", ".join(parts)).fields]) if parts else T.StructType.fromDDL(schema)
    return spark.read.schema(kinds).parquet(path) if exists(spark, path) else spark.createDataFrame([], kinds)


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table in place of what is at path, read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class KeyedTable:
    """A table at path with the columns of schema, dealt into buckets by a hash of keys.

    The number of buckets is fixed when the table is made; another number raises when it is opened. A DataFrame that was read before a
    change must be read again after it. Who only reads beside a writer opens it with writes=False and finishes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, *keys: str, buckets: int = 64, writes: bool = True):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets
        self.columns = T.StructType.fromDDL(schema).names
        if not (have := folders(spark, f"{path}/layout")):
            mark(spark, f"{path}/layout/buckets={buckets}")
        elif have != [f"buckets={buckets}"]:
            raise ValueError(f"the table at {path} has {have[0].partition('=')[2]} buckets, not {buckets}")
        if writes:
            self.recover()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets; only their folders are listed and read."""
        rows = reading(self.spark, self.schema, f"{self.path}/rows", "bucket int")
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select(*self.columns)

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts merge(what is there, rows) in place of the buckets that rows' keys fall into; rows has at least the key columns.

        merge must give rows of these buckets only, that is, keep to the keys it gets. Returns the buckets.
        """
        touched = sorted(r.bucket for r in rows.select(self.bucket()).distinct().collect())  # as many as there are buckets at most
        if touched:
            staged = f"{self.path}/staged"
            for b in touched:
                mark(self.spark, f"{staged}/touched/{b}")
            new = merge(self.read(touched), rows).select(*self.columns).withColumn("bucket", self.bucket())
            new.repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{staged}/rows")
            self.recover()
        return touched

    def recover(self) -> None:
        """Puts a change that is staged in full into place (again), and forgets one that is not."""
        staged = f"{self.path}/staged"
        if exists(self.spark, f"{staged}/rows/_SUCCESS"):
            touched = [int(b) for b in folders(self.spark, f"{staged}/touched")]
            rows = reading(self.spark, self.schema, f"{staged}/rows", "bucket int")
            full = {int(name.partition("=")[2]) for name in folders(self.spark, f"{staged}/rows") if name.startswith("bucket=")}
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
            remove(self.spark, *(f"{self.path}/rows/bucket={b}" for b in touched if b not in full))
        remove(self.spark, staged)

    def insert_absent(self, rows: DataFrame, order: str | None = None) -> list[int]:
        """Rows whose key is not there yet, each key once (the first by order)."""
        return self.change(rows, lambda old, new: old.unionByName(sinks.insert_absent(old, new.select(*self.columns), *self.keys, order=order)))

    def upsert(self, rows: DataFrame) -> list[int]:
        """Rows in place of those with their keys; of rows with one key the greatest by the other columns stands."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            rest = [c for c in self.columns if c not in self.keys]
            last = new.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("r")).select(*self.keys, *(f"r.{c}" for c in rest)) if rest else new.select(*self.keys).distinct()
            return old.join(last, list(self.keys), "left_anti").unionByName(last.select(*self.columns))

        return self.change(rows, merge)

    def replace(self, rows: DataFrame, owners: DataFrame | None = None) -> list[int]:
        """The whole sets of the keys in rows (and of owners that have none any more), where a key stands for many rows."""
        owned = rows.select(*self.keys) if owners is None else rows.select(*self.keys).unionByName(owners.select(*self.keys))
        return self.change(owned.distinct(), lambda old, keys: old.join(keys, list(self.keys), "left_anti").unionByName(rows.select(*self.columns).distinct()))

    def delete(self, rows: DataFrame, *on: str) -> list[int]:
        """Rows that agree with one of rows in the key columns, or in on (which holds the key columns), go."""
        by = list(on or self.keys)
        return self.change(rows.select(*by).distinct(), lambda old, gone: old.join(gone, by, "left_anti"))


def upsert_iocs(iocs: KeyedTable, rows: DataFrame) -> list[int]:
    """The last type given for a value stands; comments stay (see sinks.upsert_iocs)."""
    return iocs.change(rows, sinks.upsert_iocs)


def unlink(links: KeyedTable, iocs: KeyedTable, gone: DataFrame) -> None:
    """Takes links (item_id, ioc_id) out, then the iocs that no report links any more because of it. Again, it changes nothing.

    links is keyed by item_id, iocs by ioc_id; who still links an ioc is looked for in the column ioc_id alone.
    """
    gone = written(gone.select("item_id", "ioc_id").distinct(), f"{links.path}/gone")  # written, as it may be read from links
    links.delete(gone, "item_id", "ioc_id")
    orphans = gone.select("ioc_id").distinct().join(links.read().select("ioc_id"), "ioc_id", "left_anti")
    iocs.delete(orphans)
    remove(links.spark, f"{links.path}/gone")


def delete_reports(reports: KeyedTable, index: "KeyIndex", gone: DataFrame, load: str) -> None:
    """Takes reports (raw_hash) out for good: their keys stay in the index as deleted, so that they are never taken in again."""
    index.add(gone, load, deleted=True)  # first, so that a failure leaves a report too many, never one that could come back
    reports.delete(gone)


class KeyIndex:
    """All keys ever taken in or deleted, found again without reading what cannot hold them.

    Keys of a load (a batch, a run, a deletion) are one small sorted table, written at once and put in place again when the load is
    repeated. Once there are more than `most` such loads, fold() brings them into the old part: folders by the first digits of the key's
    md5, and for each folder Bloom pages of 32,768 bits. A lookup reads the recent loads, the Bloom pages, and of the old part only the
    folders in which a page says that a key may be. Folder, page and the bits of a key are different digits of its md5. At some 3000
    keys a page one in a hundred unknown keys passes for a known one and costs a look into its folder; `pages` and `buckets` are chosen for the
    history that is expected, and stay.
    """

    KEYS = "raw_hash string, deleted boolean"
    BITS, PROBES = 32768, 4

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, pages: int = 64, most: int = 32):
        self.spark, self.path, self.buckets, self.pages, self.most = spark, path, buckets, pages, most
        self.old = _Folders(spark, f"{path}/old", f"folder int, {self.KEYS}", "folder", buckets=buckets)
        self.bloom = _Folders(spark, f"{path}/bloom", "folder int, page int, bits binary", "folder", buckets=buckets)

    def add(self, keys: DataFrame, load: str, deleted: bool = False) -> None:
        """The keys (raw_hash) of a load; a load that is repeated replaces its own keys. load: letters, digits, - and _."""
        if not load.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a load's name has letters, digits, - and _ only, unlike {load!r}")
        rows = keys.select("raw_hash", F.lit(deleted).alias("deleted")).where("raw_hash is not null").distinct()
        rows.sortWithinPartitions("raw_hash").write.mode("overwrite").parquet(f"{self.path}/recent/load={load}")

    def recent(self) -> DataFrame:
        return reading(self.spark, self.KEYS, f"{self.path}/recent", "load string")

    def loads(self) -> list[str]:
        return [name.partition("=")[2] for name in folders(self.spark, f"{self.path}/recent") if name.startswith("load=")]

    def deleted(self) -> DataFrame:
        """raw_hash of all that has been deleted."""
        return self.recent().where("deleted").select("raw_hash").unionByName(self.old.read().where("deleted").select("raw_hash")).distinct()

    def known(self, keys: DataFrame, but: str | None = None) -> DataFrame:
        """raw_hash of those keys that are known, from all loads but one (a load that is being repeated does not know itself)."""
        keys = keys.select("raw_hash").where("raw_hash is not null").distinct()
        recent = self.recent() if but is None else self.recent().where(F.col("load") != but)
        maybe = self.maybe(keys)
        hit = self.folders_of(maybe)
        old = self.old.read(hit).select("raw_hash") if hit else recent.select("raw_hash").limit(0)
        found = keys.join(recent.select("raw_hash"), "raw_hash", "left_semi")
        return found.unionByName(maybe.join(old, "raw_hash", "left_semi")).distinct()

    def folders_of(self, maybe: DataFrame) -> list[int]:
        """The folders that have to be read for keys; as many as there are at most."""
        return sorted(r.folder for r in self._placed(maybe).select("folder").distinct().collect())

    def _placed(self, keys: DataFrame) -> DataFrame:
        """keys with the folder, the page, and the places of their bits in the page."""
        part = lambda at, digits: F.conv(F.substring("d", at, digits), 16, 10).cast("long")
        bits = F.array(*((part(15 + 4 * i, 4) % self.BITS).cast("int") for i in range(self.PROBES)))
        named = keys.withColumn("d", F.md5("raw_hash"))
        return named.withColumns({"folder": (part(1, 8) % self.buckets).cast("int"), "page": (part(9, 6) % self.pages).cast("int"), "at": bits}).drop("d")

    def maybe(self, keys: DataFrame) -> DataFrame:
        """raw_hash of the keys that the Bloom pages do not rule out."""
        found = self._placed(keys.select("raw_hash")).join(self.bloom.read(), ["folder", "page"])
        one = "shiftright(CAST(conv(hex(substring(bits, CAST(floor(x / 8) AS INT) + 1, 1)), 16, 10) AS INT), x % 8) % 2 = 1"
        return found.where(F.expr(f"forall(at, x -> {one})")).select("raw_hash")

    def fold(self, but: str | None = None) -> bool:
        """Brings recent loads (but one that may be repeated) into the old part, if there are too many. Can be repeated after a failure:
        loads go only when their keys and the pages are in place."""
        loads = [name for name in self.loads() if name != but]
        if len(loads) <= self.most:
            return False
        rows = self._placed(self.recent().where(F.col("load").isin(loads)).select("raw_hash", "deleted"))

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.unionByName(new.select(*self.old.columns)).groupBy("folder", "raw_hash").agg(F.max("deleted").alias("deleted"))

        touched = self.old.change(rows, merge)
        bits = self._placed(self.old.read(touched).select("raw_hash")).select("folder", "page", F.explode("at").alias("at"))
        # bit positions count from 1
        self.bloom.replace(bits.groupBy("folder", "page").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(CAST(at AS BIGINT) + 1))").alias("bits")))
        remove(self.spark, *(f"{self.path}/recent/load={name}" for name in loads))
        return True


class _Folders(KeyedTable):
    """A keyed table whose first column says the bucket."""

    def bucket(self) -> Column:
        return F.col("folder").alias("bucket")
