"""Feeds as a data source of Spark: one partition a feed, in a batch or as a stream; a feed that fails is a row, not a failed job.

    spark.dataSource.register(FeedSource)
    pulled = spark.read.format("threat_feeds").option("feeds", json.dumps([{"name": ..., "url": ...}, ...])).load()

A row has source_name, url, body (the XML, null if the pull failed), error (null if it did not) and pulled_at. Spark's own functions do the rest:
feeds.entries() reads the bodies, accounts() makes kept entries, errors and a health row for every feed, with or without entries.

As a stream, a round of pulls is one micro-batch: offsets count intervals of `every` seconds since the epoch, so a restart goes on with the next
round. What a round returns is what the feeds held when it ran; entries that come back are known by the index of keys.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewatch.sources import feeds

SCHEMA = "source_name string, url string, body string, error string, pulled_at timestamp"
#: A feed of more bytes is an error, and so is one that does not answer in time.
MOST_BYTES, SECONDS = 32 << 20, 20
#: Root elements of feeds.
ROOTS = ("rss", "feed", "RDF")


class Feed(InputPartition):
    def __init__(self, name: str, url: str, pull: int = 0):
        super().__init__(pull)
        self.name, self.url, self.pull = name, url, pull


def pulled(name: str, url: str) -> tuple:
    """A row for a feed, whatever happens to it."""
    import urllib.request
    from xml.etree import ElementTree

    body = error = None
    try:
        asked = urllib.request.Request(url, headers={"User-Agent": "tidewatch", "Accept": "application/rss+xml, application/atom+xml, application/xml, text/xml"})
        with urllib.request.urlopen(asked, timeout=SECONDS) as answer:  # noqa: S310  feeds are the operator's own list
            raw = answer.read(MOST_BYTES + 1)
        if len(raw) > MOST_BYTES:
            raise ValueError(f"over {MOST_BYTES} bytes")
        root = ElementTree.fromstring(raw).tag.rpartition("}")[2]
        if root not in ROOTS:
            raise ValueError(f"a feed begins with one of {', '.join(ROOTS)}, not {root}")
        declared = raw[:200].split(b"?>")[0]
        encoding = declared.partition(b"encoding=")[2][1:].split(declared.partition(b"encoding=")[2][:1] or b'"')[0].decode("ascii") if b"encoding=" in declared else "utf-8"
        body = raw.decode(encoding or "utf-8", "replace")
    except Exception as e:  # noqa: BLE001  whatever a feed does wrong is its row's error
        error = f"{type(e).__name__}: {e}"[:300]
    return name, url, body, error, datetime.now(timezone.utc)


class FeedReader(DataSourceReader):
    def __init__(self, listed: list[dict]):
        self.listed = listed

    def partitions(self) -> list[Feed]:
        return [Feed(f["name"], f["url"]) for f in self.listed]

    def read(self, partition: Feed) -> Iterator[tuple]:
        yield pulled(partition.name, partition.url)


class FeedStream(DataSourceStreamReader):
    def __init__(self, listed: list[dict], every: int):
        self.listed, self.every = listed, every

    def initialOffset(self) -> dict:
        return {"pull": 0}

    def latestOffset(self) -> dict:
        return {"pull": int(time.time()) // self.every}

    def partitions(self, start: dict, end: dict) -> list[Feed]:
        return [Feed(f["name"], f["url"], end["pull"]) for f in self.listed] if end["pull"] > start["pull"] else []

    def read(self, partition: Feed) -> Iterator[tuple]:
        yield pulled(partition.name, partition.url)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """Options: feeds, a JSON array of {"name", "url"}; every, the seconds between two rounds of a stream (600)."""

    @classmethod
    def name(cls) -> str:
        return "threat_feeds"

    def schema(self) -> str:
        return SCHEMA

    def _listed(self) -> list[dict]:
        return json.loads(self.options.get("feeds", "[]"))

    def reader(self, schema) -> FeedReader:
        return FeedReader(self._listed())

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self._listed(), max(1, int(self.options.get("every", "600"))))


def accounts(pulls: DataFrame, tags: tuple[str, ...] = ("item", "entry")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows of SCHEMA: the newest entries of each feed, the errors (source_name, error), and the health of every feed that was pulled.

    A feed that was read but has no entries is healthy, with 0 items.
    """
    entries = feeds.entries(pulls.where("body is not null").select("source_name", "body"), tags[0])
    for tag in tags[1:]:
        entries = entries.unionByName(feeds.entries(pulls.where("body is not null").select("source_name", "body"), tag))
    kept = feeds.newest(entries.withColumn("ord", F.xxhash64("url", "title")))
    errors = pulls.where("error is not null").groupBy("source_name").agg(F.max("error").alias("error"))
    health = pulls.select("source_name").distinct().join(feeds.health(kept, errors), "source_name", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    return kept, errors, health
