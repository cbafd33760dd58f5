"""Stored tables, the index of keys, restartable runs and the stream over them."""

from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import attribution
from tidewatch.plans import run as runs
from tidewatch.sources import stores
from tidewatch.sources.stores import KeyedTable, KeyIndex
from tidewatch.streaming import ingest as stream

CREWS = "ord int, name string, nexus string, motivation array<string>, community_identifiers array<string>, internal_alternative_names array<string>"


@pytest.fixture(scope="module")
def groups(spark):
    return attribution.catalogue(attribution.aliases(spark.createDataFrame([(1, "VANGUARD PANDA", "china", ["nation_state"], ["Volt Typhoon"], None)], CREWS)))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", "k", buckets=16)
    t.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    before = files(tmp_path / "t" / "rows")
    touched = t.upsert(spark.createDataFrame([(3, "a"), (3, "b"), (777, "new")], "k long, v string"))
    after = files(tmp_path / "t" / "rows")
    kept = {f for f in before if int(f.split("/")[0].split("=")[1]) not in touched}
    assert 1 <= len(touched) <= 2 and kept and all(after.get(f) == before[f] for f in kept)
    assert rows_of(t.read().where("v <> 'old'")) == [(3, "b"), (777, "new")] and t.read().count() == 201


def test_changes_can_be_repeated(spark, tmp_path):
    iocs = KeyedTable(spark, str(tmp_path / "iocs"), "value string, ioc_type string, comment string", "value", buckets=4)
    iocs.upsert(spark.createDataFrame([("a", "ip", "keep")], "value string, ioc_type string, comment string"))
    new = spark.createDataFrame([("a", "domain", 1), ("a", "uri", 2), ("b", "ip", 3)], "value string, ioc_type string, ord int")
    for _ in range(2):
        stores.upsert_iocs(iocs, new)
        assert rows_of(iocs.read()) == [("a", "uri", "keep"), ("b", "ip", None)]
    links = KeyedTable(spark, str(tmp_path / "links"), "item_id long, ioc_id long", "item_id", buckets=4)
    known = KeyedTable(spark, str(tmp_path / "known"), "ioc_id long, value string", "ioc_id", buckets=4)
    known.upsert(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "ioc_id long, value string"))
    links.replace(spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "item_id long, ioc_id long"))
    for _ in range(2):
        stores.unlink(links, known, spark.createDataFrame([(1, 1), (1, 2)], "item_id long, ioc_id long"))
        assert rows_of(links.read()) == [(2, 2)] and rows_of(known.read()) == [(2, "y"), (3, "z")]
    for _ in range(2):
        links.replace(spark.createDataFrame([(7, 1), (7, 1), (7, 3)], "item_id long, ioc_id long"), owners=spark.createDataFrame([(2,), (7,)], "item_id long"))
        assert rows_of(links.read()) == [(7, 1), (7, 3)]
    for _ in range(2):
        known.insert_absent(spark.createDataFrame([(2, "other"), (9, "n"), (9, "m")], "ioc_id long, value string"), order="value")
        assert rows_of(known.read()) == [(2, "y"), (3, "z"), (9, "m")]
    assert links.change(links.read().limit(0), lambda old, new: old) == []


def test_a_broken_change_is_finished_or_forgotten(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    t = KeyedTable(spark, path, "k long, v string", "k", buckets=4)
    t.upsert(spark.createDataFrame([(k, "old") for k in range(20)], "k long, v string"))
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "recover", lambda self: None)  # fails when all is staged
        t.upsert(spark.createDataFrame([(1, "new")], "k long, v string"))
        t2 = t.read().where("v = 'new'").count()
    assert t2 == 0 and KeyedTable(spark, path, "k long, v string", "k", buckets=4, writes=False).read().where("v = 'new'").count() == 0
    assert KeyedTable(spark, path, "k long, v string", "k", buckets=4).read().where("v = 'new'").count() == 1
    with pytest.raises(ValueError, match="broken"):  # fails while it is staged
        t.change(spark.createDataFrame([(2, "x")], "k long, v string"), lambda old, new: (_ for _ in ()).throw(ValueError("broken")))
    again = KeyedTable(spark, path, "k long, v string", "k", buckets=4)
    assert again.read().count() == 20 and again.read().where("v = 'x'").count() == 0
    again.delete(spark.range(20).select(F.col("id").alias("k")))
    assert again.read().count() == 0
    with pytest.raises(ValueError, match="4 buckets"):
        KeyedTable(spark, path, "k long, v string", "k", buckets=8)


def keyed(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "raw_hash string")


def test_index_reads_only_folders_that_may_hold_a_key(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"), buckets=32, pages=2, most=1)
    old = spark.range(400).select(F.concat(F.lit("k"), "id").alias("raw_hash"))
    index.add(old.where("raw_hash < 'k2'"), "batch-1")
    index.add(old.where("raw_hash >= 'k2'"), "batch-2")
    index.add(keyed(spark, "gone"), "deleted-1", deleted=True)
    assert index.fold() and not index.loads() and not index.fold()
    index.add(keyed(spark, "k5", "fresh"), "batch-3")
    assert rows_of(index.known(keyed(spark, "k7", "k7", "gone", "fresh", "unknown"))) == [("fresh",), ("gone",), ("k7",)]
    assert rows_of(index.known(keyed(spark, "fresh", "k5"), but="batch-3")) == [("k5",)]
    assert rows_of(index.deleted()) == [("gone",)]
    assert index.known(old).count() == 400
    new = spark.range(300).select(F.concat(F.lit("new"), "id").alias("raw_hash"))
    assert index.known(new).count() == 0 and index.maybe(new).count() < 5  # the pages rule nearly all of them out
    hit = index.folders_of(keyed(spark, "k7"))
    for p in Path(tmp_path / "i" / "old" / "rows").glob("bucket=*"):  # all other folders could be lost: they are not read
        if int(p.name.split("=")[1]) not in hit:
            for f in p.glob("*.parquet"):
                f.write_bytes(b"not parquet")
    assert rows_of(index.known(keyed(spark, "k7", "never"))) == [("k7",)]
    with pytest.raises(ValueError, match="letters"):
        index.add(new, "a/b")


def test_fold_can_be_repeated(spark, tmp_path, monkeypatch):
    index = KeyIndex(spark, str(tmp_path / "i"), buckets=4, pages=1, most=0)
    index.add(keyed(spark, "a", "b"), "batch-1")
    with monkeypatch.context() as m:
        m.setattr(index.bloom, "replace", lambda rows: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            index.fold()
    assert rows_of(index.known(keyed(spark, "a", "c"))) == [("a",)]
    assert index.fold() and rows_of(index.known(keyed(spark, "a", "c"))) == [("a",)] and index.old.read().count() == 2


CANDIDATE = "ord long, title string, url string, description string, category string, source_name string, published_at date"
FIRST = [
    (1, "Volt Typhoon again", "u1", "at evil[.]example", "news", "s", date(2026, 7, 1)), (2, "Our webinar", "u2", None, "vendor", "s", date(2026, 7, 3)),
    (3, "CVE-2026-12345 exploited in the wild", "u3", None, "news", "t", date(2026, 6, 1)), (4, "volt typhoon  AGAIN", "u1", None, "news", "t", None),
]
SECOND = [(1, "Volt Typhoon again", "u1", None, "news", "s", date(2026, 6, 1)), (2, "Volt Typhoon once more", "u9 at bad[.]example", None, "news", "s", date(2026, 6, 2))]


def state_of(store):
    tables = {n: rows_of(getattr(store, n).read().drop("started_at", "finished_at")) for n in ("reports", "dropped", "links", "log")}
    return tables | {"totals": rows_of(store.totals()), "loads": sorted(store.index.loads())}


class Stopped(Exception):
    pass


@pytest.fixture(scope="module")
def whole(spark, groups, tmp_path_factory):
    store = runs.Store(spark, str(tmp_path_factory.mktemp("whole")), buckets=4)
    return store, two_runs(spark, store, groups)


def two_runs(spark, store, groups, number=None, step=None):
    health = spark.createDataFrame([("down", "timeout"), ("s", None)], "source_name string, error string")
    for n, rows in ((1, FIRST), (2, SECOND)):
        def after(done, n=n):
            if (n, done) == (number, step):
                raise Stopped

        go = lambda hook, n=n, rows=rows: runs.run(store, n, spark.createDataFrame(rows, CANDIDATE), groups, health if n == 1 else None, F.lit("2026-07-04").cast("timestamp"), after=hook)
        try:
            go(after)
        except Stopped:
            go(lambda done: None)
    return state_of(store)


def test_run(whole):
    _, state = whole
    assert sorted((r[2], r[-1]) for r in state["reports"]) == [("CVE-2026-12345 exploited in the wild", 1), ("Volt Typhoon again", 1), ("Volt Typhoon once more", 2)]
    assert state["totals"] == [("down", 0, 0, None, "timeout"), ("s", 2, 1, date(2026, 7, 3), None), ("t", 1, 0, date(2026, 6, 1), None)]  # the date of s has not moved back
    assert [(r[0], r[1], r[2]) for r in state["log"]] == [(1, "success", 2), (2, "success", 1)] and "down: timeout" in state["log"][0][3]
    assert {r[1:] for r in state["links"]} == {("domain", "evil.example"), ("cve", "CVE-2026-12345")}


@pytest.mark.parametrize(("number", "step"), [(1, "reports"), (2, "sources")])
def test_run_repeated_after_a_step(spark, groups, whole, tmp_path, number, step):
    store = runs.Store(spark, str(tmp_path), buckets=4)
    assert two_runs(spark, store, groups, number, step) == whole[1]


def test_deleted_reports_stay_out(spark, groups, tmp_path):
    store = runs.Store(spark, str(tmp_path), buckets=2, most=0)
    go = lambda n, rows: runs.run(store, n, spark.createDataFrame(rows, CANDIDATE), groups)
    go(1, FIRST)
    store.delete(store.reports.read().where("title = 'Volt Typhoon again'"), "one")
    assert go(2, FIRST)["kept"] == 0 and [r.title for r in store.reports.read().collect()] == ["CVE-2026-12345 exploited in the wild"]
    assert {r.value for r in store.links.read().collect()} == {"CVE-2026-12345"}


def test_stream_knows_all_history(spark, groups, tmp_path):
    schema = "title string, url string, description string, category string, source_name string, published_at date, seen_at timestamp"
    day = lambda m, d=1: datetime(2026, m, d)
    landed, out = str(tmp_path / "in"), str(tmp_path / "out")

    def land(*rows):
        spark.createDataFrame([(t, u, None, "news", "s", at.date(), at) for t, u, at in rows], schema).write.mode("append").parquet(landed)
        stream.start(spark.readStream.schema(schema).parquet(landed), groups, out, str(tmp_path / "checkpoint")).awaitTermination()

    titles = lambda: sorted(r.title for r in spark.read.parquet(f"{out}/reports").collect())
    land(("Volt Typhoon first", "u1", day(1)), ("Volt Typhoon to go", "u2", day(1)))  # nothing is dropped here
    hashes = {r.title: r.raw_hash for r in spark.read.parquet(f"{out}/reports").collect()}
    stream.delete(spark, out, keyed(spark, hashes["Volt Typhoon to go"]), "one")
    land(("Volt Typhoon first", "u1", day(3, 10)), ("Volt Typhoon second", "u3", day(3, 10)), ("Our webinar", "u4", day(3, 10)))  # after more than 60 days
    land(("Volt Typhoon first", "u1", day(12)), ("Volt Typhoon to go", "u2", day(12)), ("Volt Typhoon third", "u5", day(12)))
    assert titles() == ["Volt Typhoon first", "Volt Typhoon second", "Volt Typhoon third", "Volt Typhoon to go"]
    assert sorted(r.title for r in stream.live(spark, out).collect()) == ["Volt Typhoon first", "Volt Typhoon second", "Volt Typhoon third"]
    state = stream.State(spark, out, writes=False)
    assert rows_of(runs.totals(state.sources.read())) == [("s", 4, 1, date(2026, 12, 1), None)]
    assert [(r.status, r.items_added) for r in state.log.read().orderBy("run").collect()] == [("success", 2), ("success", 1), ("success", 1)]


def test_stream_batch_repeated(spark, groups, tmp_path):
    """A batch whose writes are done but whose commit is lost is run again: the same rows, counted once."""
    schema = "title string, url string, description string, category string, source_name string, published_at date, seen_at timestamp"
    landed, out, at = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "checkpoint"
    for n in (1, 2):
        spark.createDataFrame([(f"Volt Typhoon {n}", f"u{n}", None, "news", "s", date(2026, 1, n), datetime(2026, 1, n))], schema).write.mode("append").parquet(landed)
        go = lambda: stream.start(spark.readStream.schema(schema).parquet(landed), groups, out, str(at)).awaitTermination()
        go()
    newest = max((at / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (at / "commits" / f".{newest.name}.crc").unlink(missing_ok=True)
    go()
    assert sorted(r.title for r in spark.read.parquet(f"{out}/reports").collect()) == ["Volt Typhoon 1", "Volt Typhoon 2"]
    assert rows_of(runs.totals(stream.State(spark, out).sources.read())) == [("s", 2, 0, date(2026, 1, 2), None)]
