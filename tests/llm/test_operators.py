"""Each operator against a brute-force version, on a small table that holds the odd cases: null ids and texts, empty and long texts,
repeated rows, equal texts, ties, and extra columns whose names clash with those that operators make."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import blocks, decontamination, exact_dedup, lm_scoring, mixing, near_join, quality, queries, sharding, shared, stages, substring_dedup, toxicity, url_filter
from tidewatch.llm.shared import Scratch, WordHash, prefix_sums, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, block string, score string, slot string"
WORDS = [f"w{i}" for i in range(300)]


def make(seed=1):
    r = random.Random(seed)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    passage = prose(40)
    rows = []
    for i in range(60):
        body = prose(r.choice([0, 1, 3, 5, 19, 20, 21, 60, 200]))
        if i % 4 == 0:
            body = body + " " + passage + "\t" + prose(7)
        rows.append([i, body])
    near = prose(120).split()
    for i in range(60, 70):
        w = list(near)
        w[(i * 7) % 120] = f"x{i}"
        rows.append([i, " ".join(w)])
    rows += [[70, rows[5][1]], [71, rows[60][1].replace(" ", "  \n")], [72, None], [73, ""], [74, " \t "], [None, "lonely " + passage], [None, None], [75, prose(20_000)], [76, "aa " * 50], [76, "aa " * 50], [77, "!!! ???"], [78, "\u00e9t\u00e9 \u2603 Stra\u00dfe " * 9]]
    return [(i, t, "en", None if (i or 0) % 5 == 4 else f"s{(i or 0) % 3}", len(t or ""), "x", "x", "x", "x", "x") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, empty):
    rows = sharding.shard_rows(docs, 7).collect()
    assert len(rows) == len(make())
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    by = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert by == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in make())
    assert sharding.shard_rows(empty, 7).count() == 0
    assert sharding.assign(docs, 7).columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "size", "block"]


def test_sharding_follows_the_ring(spark):
    ring = sharding.Ring(5, 16)
    rows = spark.range(3000).withColumnRenamed("id", "doc_id")
    home = {r.doc_id: r.shard for r in sharding.assign(rows, 5, 16).collect()}
    near = {i: ring.owners[ring.arc(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16))] for i in home}
    room = Counter(near.values())
    # a row leaves its home only if that is full
    assert all(room[near[i]] > 600 for i in home if home[i] != near[i])
    more = {r.doc_id: r.shard for r in sharding.assign(rows, 6, 16).collect()}
    assert sum(home[i] != more[i] for i in home) < 0.5 * len(home)


def test_fill_is_exact():
    ring = sharding.Ring(4, 8)
    runs = sharding.fill(ring, {0: 50, 5: 1, 31: 12})
    assert sum(j - i for _, i, j, _, _ in runs) == 63
    assert sorted(Counter({s: sum(j - i for _, i, j, x, _ in runs if x == s) for s in range(4)}).values()) == [15, 16, 16, 16]


def test_exact_dedup(spark, docs, empty):
    import re

    rows = exact_dedup.dedup(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, *_ in make():
        groups[norm(t)].append(i)
    assert len(rows) == len(make())
    seen = Counter()
    for r in rows:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = groups[text]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        seen[text] += r.kept
    assert set(seen.values()) == {1}
    assert exact_dedup.dedup(empty).count() == 0


def test_digest_index_persists(spark, tmp_path):
    first = spark.createDataFrame([(5, "a b"), (3, "c"), (9, "a  b")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.dedup(first, load="first").collect()} == {(5, 5, True), (3, 3, True), (9, 5, False)}
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)  # as a later session would open it
    more = spark.createDataFrame([(1, "a\tb"), (2, "new")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in again.dedup(more, load="second").collect()} == {(1, 5, False), (2, 2, True)}
    assert again.entries().count() == 3


def test_substring_dedup(docs, empty):
    rows = sorted(make(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, want = set(), Counter()
    for i, t, *_ in rows:
        w = (t or "").split()
        gone = set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone.update(range(s, s + 20))
            seen.add(k)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(docs).collect())
    assert got == want and sum(k[2] for k in want) > 100
    assert substring_dedup.dedup(empty).count() == 0


def test_cover_is_a_difference_cover():
    p, d = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in d for b in d} == set(range(p))


def brute_links(rows):
    cache = WordHash()
    sets = [set(near_join.shingles((t or "").encode(), cache).tolist()) for _, t, *_ in rows]
    return sets, [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]


def test_near_join(docs, empty, monkeypatch):
    rows = make()
    sets, links = brute_links(rows)
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
    group = defaultdict(list)
    for i, r in enumerate(root):
        group[r].append(rows[i][0])
    want = Counter((rows[i][0], min((x for x in group[root[i]] if x is not None), default=None), len(links[i])) for i in range(len(rows)))
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_join.classes(docs).collect())
    assert got == want and max(k[2] for k in want) >= 10
    monkeypatch.setattr(near_join, "LEAF", 2)  # buckets are split to the last, and components verified by pairs of blocks
    monkeypatch.setattr(near_join, "SMALL", 2)
    monkeypatch.setattr(near_join, "GROUP", 3)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in near_join.classes(docs).collect()) == want
    got = Counter((r.doc_id, r.class_id) for r in near_join.classes(docs, count=False).collect())
    assert got == Counter((r, c) for (r, c, _), n in want.items() for _ in range(n))
    assert near_join.classes(empty).count() == 0


def test_recall_of_lone_pairs_in_large_buckets(spark, monkeypatch):
    """Pairs at the threshold that nothing else connects, with every bucket split to the last."""
    monkeypatch.setattr(near_join, "LEAF", 1)
    n, r = 2000, np.random.default_rng(5)
    one = r.integers(0, 1 << 32, (n, near_join.T), dtype=np.uint32)
    two = np.where(r.random(one.shape) < 0.8, one, r.integers(0, 1 << 32, one.shape, dtype=np.uint32))
    rows = [(bytearray(f"{i}{side}".encode()), bytearray(s.tobytes())) for side, of in (("a", one), ("b", two)) for i, s in enumerate(of)]
    nodes = spark.createDataFrame(rows, "sid binary, sketch binary").repartition(4).cache()
    small, large = near_join.candidates(nodes, Scratch(spark, "recall"), 0.8, 0.995)
    edges = small.unionByName(large).collect()
    met = {bytes(e.a)[:-1] for e in edges if bytes(e.a)[:-1] == bytes(e.b)[:-1]}
    assert len(met) >= (0.995 - 3 * (0.005 * 0.995 / n) ** 0.5) * n


def test_runs_reach_the_recall():
    """The stated chance against one counted with the code's own paths."""
    r, n = np.random.default_rng(6), 4000
    runs = near_join.runs_needed(0.995)
    assert near_join.recall_of(runs, 0.8, near_join.DEPTH) >= 0.995 > near_join.recall_of(runs - 1, 0.8, near_join.DEPTH)
    one = r.integers(0, 1 << 32, (n, near_join.T), dtype=np.uint32)
    two = np.where(r.random(one.shape) < 0.8, one, r.integers(0, 1 << 32, one.shape, dtype=np.uint32))
    for few in (6, runs):
        (row, a), (_, b) = near_join.first_children(one, few), near_join.first_children(two, few)
        assert len(row) == few * n  # no run is idle
        row, paths = row[a == b], a[a == b]
        for _ in range(near_join.DEPTH - 1):
            both = [set(zip(row[k].tolist(), p.tolist(), strict=True)) for k, p in (near_join.children(paths, s[row], 0.8) for s in (one, two))]
            kept = sorted(both[0] & both[1])
            row, paths = np.array([k for k, _ in kept]), np.array([p for _, p in kept], dtype=np.uint64)
        want = near_join.recall_of(few, 0.8, near_join.DEPTH)
        assert abs(len(set(row.tolist())) / n - want) < 4 * (want * (1 - want) / n) ** 0.5


def test_one_of_each(docs):
    rows = make()
    sets, links = brute_links(rows)
    kept = near_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert 60 in ids and not {61, 65, 69, 70, 71} & set(ids) and ids[76] == 1 and ids[72] == ids[73] == 1 and ids[75] == 1


def chain(n: int, words: int = 40) -> list[tuple[int, str]]:
    """Texts of which each links the next one only, so that a class hangs together through all of them."""
    return [(i, " ".join(f"v{k}" for k in range(i * 4, i * 4 + words))) for i in range(n)]


def test_classes_through_others(spark, monkeypatch):
    """Beside a representative that links few, the rest is compared with all; classes are those of brute force."""
    rows = chain(30) + [(100 + i, text + " tail") for i, (_, text) in enumerate(chain(6, 80)[:3])] + [(200, "alone " * 9)]
    _, links = brute_links(rows)
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
    monkeypatch.setattr(near_join, "SMALL", 4)
    monkeypatch.setattr(near_join, "GROUP", 5)
    # every set a candidate of every other, as in a bucket that no split divides
    def everything(nodes, *a):
        stars = nodes.crossJoin(nodes.agg(F.min("sid").alias("b"))).select(F.col("sid").alias("a"), "b")
        return stars.limit(0), stars

    monkeypatch.setattr(near_join, "candidates", everything)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {rows[i][0]: rows[root[i]][0] for i in range(len(rows))}
    assert max(len([1 for r in root if r == k]) for k in set(root)) >= 20
    for count in (False, True):
        assert {r.doc_id: r.class_id for r in near_join.classes(df, count=count).collect()} == want
    assert {r.doc_id: r.n_links for r in near_join.classes(df).collect()} == {rows[i][0]: len(links[i]) for i in range(len(rows))}


@pytest.mark.parametrize("count", [True, False])
def test_chains_without_links_come_apart(spark, monkeypatch, count):
    """Texts that share 0.77 with the next chain to one component of candidates; only links and their classes are left of it."""
    texts = [" ".join(f"w{k}" for k in range(i * 13, i * 13 + 104)) for i in range(1500)]
    rows = [*enumerate(texts), *((10_000 + i, texts[i].replace(f"w{i * 13 + 50} ", "other ")) for i in range(0, 1500, 50))]
    seen = []
    kept = near_join.links_of

    def watched(member, texts_of, scratch, similarity, count, name="links"):
        sizes = [r["count"] for r in member.groupBy("root").count().collect()]
        seen.append((name, max(sizes, default=0), len(sizes)))
        return kept(member, texts_of, scratch, similarity, count, name)

    monkeypatch.setattr(near_join, "links_of", watched)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), count=count).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: i % 10_000 for i, _ in rows}
    if count:
        assert {i: n for i, (_, n) in got.items()} == {i: int(i >= 10_000 or i % 50 == 0) for i, _ in rows}
    (first, wide, _), (last, most, _) = seen
    assert (first, last) == ("star-links", "links")
    assert wide <= near_join.SMALL and most <= near_join.SMALL


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100)], "a long, b long")
    found = {r.node: r.root for r in near_join.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, n + 1)}, 101: 100}


def test_decontamination(spark, docs, empty):
    rows = make()
    normal = lambda t: decontamination.words_of((t or "").encode())
    items = [(1, rows[75][1][:400] if rows[75][1] else ""), (2, "  !! "), (3, None), (10, " ".join(rows[40][1].split()[-20:])), (11, "W1, W2"), (12, "\u00e9t\u00e9 \u2603 stra\u00dfe")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.decontaminate(docs, bench).collect())
    want = Counter()
    for i, t, *_ in rows:
        w, hit, of = normal(t), set(), set()
        for item, text in items:
            x = normal(text)
            k = min(10, len(x))
            for a in range(len(x) - k + 1 if k else 0):
                for s in range(len(w) - k + 1):
                    if w[s : s + k] == x[a : a + k]:
                        hit.update(range(s, s + k))
                        of.add(str(item))
        want[i, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)] += 1
    assert got == want
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_parts(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(k, " ".join(make()[k][1].split()[:30])) for k in (4, 8, 9, 12, 60)], "item_id long, text string")
    one = {(r.doc_id, r.n_hit, r.items_sha256) for r in decontamination.decontaminate(docs, bench).collect()}
    for part, sent, chunk in ((100, 1 << 30, 2000), (100, 300, 0), (1 << 20, 200, 5000)):
        monkeypatch.setattr(decontamination, "PART_BYTES", part)
        monkeypatch.setattr(decontamination, "SENT_BYTES", sent)
        monkeypatch.setattr(decontamination, "CHUNK", chunk)
        assert {(r.doc_id, r.n_hit, r.items_sha256) for r in decontamination.decontaminate(docs, bench).collect()} == one


@pytest.mark.parametrize("window", [1, 2, 3, 7, 10])
def test_anchors_find_every_window(window):
    """Against all windows of all items, over texts of few different words, where matches are many and overlap."""
    r = random.Random(window)
    for _ in range(60):
        items = [(str(k), " ".join(r.choice("ab") for _ in range(r.randrange(0, 25))).encode()) for k in range(3)]
        words = [r.choice("ab").encode() for _ in range(r.randrange(0, 60))]
        on, found = np.zeros(len(words), dtype=bool), set()
        decontamination.Part(items, window).hits(words, on, found)
        want, of = np.zeros(len(words), dtype=bool), set()
        for name, text in items:
            for w in decontamination.windows_of(decontamination.words_of(text), window):
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        want[i : i + len(w)] = True
                        of.add(name)
        assert (on == want).all() and found == of


def test_hits_at_the_end_of_a_long_text(spark):
    passage = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "word " * 300_000 + passage)], "doc_id long, text string")
    (r,) = decontamination.decontaminate(docs, spark.createDataFrame([(5, passage)], "item_id long, text string")).collect()
    assert (r.n_words, r.n_hit, r.n_items, [s.asDict() for s in r.spans]) == (300_012, 12, 1, [{"start": 1_500_000, "end": 1_500_000 + len(passage)}])


@pytest.mark.parametrize("part_bytes", [decontamination.PART_BYTES, 20])
def test_decontamination_by_items_without_id(spark, monkeypatch, part_bytes):
    """By brute force, and as the query's SQL has it: null is one item in the count and none in the digest."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(decontamination, "PART_BYTES", part_bytes)
    one, two, three = (" ".join(f"{c}{i}" for i in range(12)) for c in "abc")
    items = [(None, one), (None, two), (7, two), (10, three), (None, None)]
    rows = [(1, f"x {one} y"), (2, f"{one} z {two}"), (3, three), (4, "nothing"), (5, f"{one} {three} {two}"), (6, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sha = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    want = {(1, 14, 12, 1, sha(""), True), (2, 25, 24, 2, sha("7"), True), (3, 12, 12, 1, sha("10"), True), (4, 1, 0, 0, sha(""), False), (5, 36, 36, 3, sha("10,7"), True), (6, 0, 0, 0, sha(""), False)}
    got = decontamination.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    with duckdb.connect() as db:
        for name, columns, values in (("documents", "doc_id BIGINT, text VARCHAR", rows), ("benchmark", "item_id BIGINT, text VARCHAR", items)):
            db.execute(f"CREATE TABLE {name} ({columns})")
            db.executemany(f"INSERT INTO {name} VALUES (?, ?)", values)
        assert set(db.execute(queries.ORACLES["op3_decontamination"]).fetchall()) == want


def test_spans_point_into_the_original():
    text = "Ab, \u00c9t\u00e9 cd-EF  gh".encode()
    words = decontamination.words_of(text)
    on = np.array([False, True, True, False, True])[: len(words)]
    assert [text[s["start"] : s["end"]].decode() for s in decontamination.spans(text, on)] == ["\u00c9t\u00e9 cd", "gh"]


def test_mixing(docs, empty):
    rows = mixing.mix(docs.drop("size", "block")).collect()
    size = lambda t: len((t or "").split())
    total = defaultdict(int)
    for i, t, _, s, *_ in make():
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(total.values()), set(order)
    while left > 1e-6 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= 2 * total[s]:
                left += target[s] - 2 * total[s]
                target[s] = 2.0 * total[s]
                open_.discard(s)
    taken = defaultdict(int)
    for r in rows:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9) and r.source_size == total[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == round(target[s]) for s in order)
    assert len(rows) == len(make()) and mixing.mix(empty.drop("size", "block")).count() == 0
    again = Counter((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7).drop("size", "block")).collect())
    assert again == Counter((r.doc_id, r.taken) for r in rows)


def test_mixed_rows(docs):
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert max(Counter((r.doc_id, r.text) for r in out.where("doc_id <> 76").collect()).values()) == 2


@pytest.fixture
def long_texts(spark, tmp_path):
    """Long texts as a file, among them near and exact copies and a repeated row; joins of small tables are not broadcast."""
    r = np.random.default_rng(8)
    texts = [" ".join(r.bytes(8).hex() for _ in range(1200)) for _ in range(300)]
    rows = [*((i, (None, "a", "b")[i % 3], t) for i, t in enumerate(texts)), (1000, "a", texts[3] + " more"), (1001, None, texts[7]), (5, "b", texts[5]), (5, None, texts[5])]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4).write.parquet(str(tmp_path / "long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.read.parquet(str(tmp_path / "long")), sum(len(t) for _, _, t in rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled(spark) -> int:
    """Bytes that this session has written to shuffles."""
    spark.range(8).count()
    time.sleep(1)  # figures of the last tasks
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_mixed_rows_are_shuffled_once(spark, long_texts):
    docs, size = long_texts
    before = shuffled(spark)
    rows = Counter((r.doc_id, r.source, r.text) for r in mixing.mixed_rows(docs).collect())
    assert size / 2 < shuffled(spark) - before < 1.2 * size
    # sums and starts by plain Python
    all_rows, weight = defaultdict(list), {"a": 5, "b": 2, None: 1}
    for r in docs.collect():
        all_rows[r.source].append((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id, len(r.text.split()), r.text))
    own = {s: sum(x[2] for x in of) for s, of in all_rows.items()}
    goal, target, open_ = 1.5 * sum(own.values()), {}, dict(weight)
    while open_:
        level = (goal - sum(target.values())) / sum(open_.values())
        full = [s for s, w in open_.items() if w * level > 2 * own[s]]
        target |= {s: 2 * own[s] for s in full} or {s: w * level for s, w in open_.items()}
        open_ = {s: w for s, w in open_.items() if full and s not in full}
    want = Counter()
    for s, of in all_rows.items():
        whole, rest = divmod(round(target[s]), own[s])
        for _, i, n, text in sorted(of):
            if whole + (rest > 0):
                want[i, s, text] += whole + (rest > 0)
            rest -= n
    assert rows == want


def test_one_of_each_shuffles_what_meets(spark, long_texts):
    """Texts without copies are not shuffled, also where no side of a join is small."""
    docs, size = long_texts
    before = shuffled(spark)
    ids = Counter(r.doc_id for r in near_join.one_of_each(docs).collect())
    assert shuffled(spark) - before < 0.5 * size
    assert ids == Counter(range(300))


def test_decontamination_has_one_worker_a_task(docs, spark):
    made = decontamination.decontaminate(docs.drop("size", "block"), spark.createDataFrame([("i", "w1 w2 w3")], "item_id string, text string"))
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_marked_loses_none(spark, monkeypatch):
    """Far more hashes than bits, and few: every one of them is marked, and of few hardly another one."""
    rows = spark.range(20_000).select(F.xxhash64("id").alias("text_hash"), "id")
    few = spark.range(0, 20_000, 100).select(F.xxhash64("id").alias("h"))
    got = {r.id for r in near_join.marked(rows, few).where("maybe").collect()}
    assert {*range(0, 20_000, 100)} <= got and len(got) < 250
    assert near_join.marked(rows, few.limit(0)).where("not maybe").count() == 20_000
    monkeypatch.setattr(near_join, "PAGES", 1)
    many = spark.range(0, 400_000, 2).select(F.xxhash64("id").alias("h"))
    got = near_join.marked(rows, many)
    assert got.count() == 20_000 and {*range(0, 20_000, 2)} <= {r.id for r in got.where("maybe").collect()}


def test_lm_scoring(spark, docs, empty):
    rows = make()
    good = {i for i in range(0, 60, 3)}
    target = spark.createDataFrame([(i,) for i in good] + [(None,), (999,)], "doc_id long")

    def model(which):
        one, two = Counter(), Counter()
        for i, t, *_ in rows:
            w = ["<s>", *(t or "").split()]
            if which(i) and len(w) > 1:
                one.update(w)
                two.update(zip(w, w[1:], strict=False))
        return one, two

    models = model(lambda i: i in good), model(lambda i: True)
    v = len(models[1][0]) - 1
    want = Counter()
    for i, t, *_ in rows:
        w = ["<s>", *(t or "").split()]
        losses = []
        for one, two in models:
            n = sum(one.values()) - one["<s>"]
            losses.append(sum(-math.log((two[a, b] + 2 * (one[b] + 1) / (n + v + 1)) / (one[a] + 2)) for a, b in zip(w, w[1:], strict=False)) / max(1, len(w) - 1))
        want[i, len(w) - 1, round(losses[1] - losses[0], 9) + 0.0 if len(w) > 1 else None] += 1
    got = Counter((r.doc_id, r.n_words, None if r.score is None else round(r.score, 9) + 0.0) for r in lm_scoring.score(docs, target).collect())
    assert got == want
    assert lm_scoring.score(empty, target).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, labels).collect()
    assert len(rows) == len(make()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert len({r.score for r in rows if r.doc_id == 76}) == 1  # repeated rows alike
    assert quality.score(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality.score(empty, labels).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.score(table(spark, sf, "documents"), table(spark, sf, "labels")).where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    assert len(out) > 50 and sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)
    # calibrated: the mean score of held-out rows is near their share of quality 1
    assert abs(np.mean([r.score for r in out]) - np.mean([r.quality for r in out])) < 0.05


def plain_vectors(texts: list[bytes], buckets: int) -> np.ndarray:
    """Context vectors by loops over tokens and their neighbours."""
    out = np.zeros((quality.TABLES, buckets, quality.DIM))
    for text in texts:
        distinct, place, _ = quality.tokens_of([text], WordHash())
        h = distinct[place]
        index = quality.index_vectors(h).astype(float)
        for i in range(len(h)):
            for j in range(max(0, i - quality.REACH), min(len(h), i + quality.REACH + 1)):
                if i != j:
                    for t in range(quality.TABLES):
                        out[t, quality.rows_of(h[i : i + 1], t, buckets)[0]] += index[j]
    for t in range(quality.TABLES):
        on = np.linalg.norm(out[t], axis=1) > 0
        unit = out[t][on] / np.linalg.norm(out[t][on], axis=1, keepdims=True)
        unit -= unit.mean(axis=0)
        out[t][on] = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    return out


def test_context_vectors_and_pooling_by_brute_force(spark, docs):
    texts = [(t or "").encode() for _, t, *_ in make() if len(t or "") < 5000]
    short = spark.createDataFrame([(t.decode(),) for t in texts], "text string").repartition(3)
    got, want = quality.context_vectors(short, 64), plain_vectors(texts, 64)
    assert np.allclose(got, want, atol=1e-5) and np.linalg.norm(want) > 5
    x = quality.pooled(*quality.tokens_of(texts, WordHash()), got)
    for text, row in zip(texts, x, strict=True):
        distinct, place, _ = quality.tokens_of([text], WordHash())
        h = distinct[place]
        v = np.array([np.mean([got[t][quality.rows_of(np.array([w]), t, 64)[0]] for t in range(quality.TABLES)], axis=0) for w in h])
        if not len(v):
            assert not row.any()
            continue
        near = sum(v[i] * v[i - 1] for i in range(1, len(v))) / len(v) if len(v) > 1 else np.zeros(quality.DIM)
        assert np.allclose(row, np.concatenate([v.mean(axis=0), v.std(axis=0), near, [math.log1p(len(v))]]), atol=1e-3)


def test_words_have_vectors_of_their_own():
    h = quality.tokens_of([" ".join(f"word{i}" for i in range(20_000)).encode()], WordHash())[0]
    assert len(set(zip(*(quality.rows_of(h, t, quality.BUCKETS).tolist() for t in range(quality.TABLES)), strict=True))) >= len(h) - 10


def test_network_learns_and_is_calibrated():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, quality.SIZE))
    x[:, 6:] = 0
    p = 1 / (1 + np.exp(x[:, 1] - 3 * np.abs(x[:, 0]) + 2))
    y = (r.random(3000) < p).astype(float)
    network = quality.Network(x, y, np.arange(3000) % 5 == 0)
    fresh = r.normal(size=(3000, quality.SIZE))
    fresh[:, 6:] = 0
    truth = 1 / (1 + np.exp(fresh[:, 1] - 3 * np.abs(fresh[:, 0]) + 2))
    got = network.probabilities(fresh)
    assert np.corrcoef(got, truth)[0, 1] > 0.7
    # the temperature is the one of the grid with the least loss on the rows set apart
    z = network.logits(x[::5])
    assert all(network.loss(z / network.temperature, y[::5]) <= network.loss(z / k, y[::5]) + 1e-12 for k in np.geomspace(0.25, 8, 81))


def test_toxicity(spark, docs, empty):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[r.randrange(40)] = "grumbo" + r.choice(["l", "ling", "lotz"])  # a stem that no seed has
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in toxicity.score(d, lab).collect()}
    held = [i for i in out if out[i].held_out]
    assert held and all(out[i].predicted == (i % 4 == 0) for i in held)
    odd = toxicity.score(docs, lab.limit(0))
    assert odd.columns == [*[c for c in docs.columns if c != "score"], "held_out", "score", "predicted"] and odd.where("predicted = 1").count() == 0
    assert toxicity.score(empty, lab).count() == 0


def tags_by_hand(words, weights, threats):
    """What the grammar should make of a clause, word by word, without machines."""
    stem = lambda w: max([v for s, v in weights.items() if (w + " ").startswith(s)], default=0.0)
    out = dict.fromkeys(toxicity.FEATURES, 0.0)
    matched = []
    for i, w in enumerate(words):
        ends = any(words[max(0, i + 1 - k) : i + 1] == t.split() for t in threats for k in (len(t.split()),))
        matched.append(("threat", stem(w) or 1.0) if ends else ("insult", stem(w)) if stem(w) else None)
    target = any(m is None and w in toxicity.TARGETS for m, w in zip(matched, words, strict=True))
    for i, m in enumerate(matched):
        if m:
            reported = any(w in toxicity.REPORTS for w in words[: i + 1])
            # a negation counts for three words behind it, and none does for itself
            negated = words[i] not in toxicity.NEGATIONS and any(w in toxicity.NEGATIONS for w in words[max(0, i - 3) : i])
            kind = "reported" if reported and not negated else "negated" if negated else m[0] if m[0] == "threat" else "targeted" if target else "plain"
            out[kind] += m[1]
    return np.array([out[f] for f in toxicity.FEATURES])


def test_grammar_by_brute_force():
    """Random clauses of words that matter to it."""
    r, weights = random.Random(5), {"idiot ": 4.0, "trash": 2.5, "trashy": 3.0, "scum ": 1.5}
    g = toxicity.Grammar(weights)
    pool = "idiot trash trashy trashiest scum you he not never said i will kill hurt find regret watch your back house burn day".split()
    for _ in range(3000):
        words = [r.choice(pool) for _ in range(r.randrange(1, 12))]
        assert np.allclose(g.clause(" ".join(words).encode()), tags_by_hand(words, weights, toxicity.THREATS)), words


def test_features_add_up_over_clauses():
    r, weights = random.Random(6), {"idiot ": 4.0, "trash": 2.5}
    g = toxicity.Grammar(weights)
    pool = "idiot trashy you not said kill hurt calm day".split()
    for _ in range(300):
        clauses = [" ".join(r.choice(pool) for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(1, 6))]
        want = np.log1p(sum(tags_by_hand(c.split(), weights, toxicity.THREATS) for c in clauses))
        assert np.allclose(g.features("; ".join(clauses).upper().encode()), want)
    assert (g.features(("calm day " * 200_000 + "you idiot").encode()) == np.log1p([0, 4.0, 0, 0, 0])).all()


def test_lexicon_by_brute_force(spark):
    r = random.Random(9)
    rows = []
    for i in range(300):
        words = ["".join(r.choice("abcdef") for _ in range(r.randrange(3, 9))) for _ in range(25)]
        toxic = int(i % 3 == 0)
        if toxic and r.random() < 0.8:
            words.append("grumbo" + r.choice(["", "ling", "lot"]))
        rows.append((i, toxic, sorted(set(words))))
    rows += [(1000 + i, 1, rows[0][2]) for i in range(50)]  # copies prove nothing
    got = toxicity.lexicon(spark.createDataFrame(rows, "doc_id long, toxic int, words array<string>"))
    rows = rows[:300]
    stems = [({f"{w} " for w in ws if len(w) > 2} | {w[:n] for w in ws for n in range(4, min(8, len(w)) + 1)}, t) for _, t, ws in rows]
    bad, good = (Counter(s for of, t in stems if t == k for s in of) for k in (1, 0))
    n, m = 100, 200
    p, needed = n / (n + m), math.log(sum(bad[s] + good[s] >= 4 for s in bad | good) / 0.05)
    want = {}
    for s, a in bad.items():
        b, q = good[s], a / (a + good[s])
        ratio = (a + 0.5) / (n + 1) / ((b + 0.5) / (m + 1))
        if ratio >= 4 and (a + b) * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)) >= needed:
            want[s] = math.log(ratio)
    assert set(got) == set(want) and {"grum", "grumbo"} <= set(got) and all(math.isclose(got[s], want[s]) for s in got)


def test_regression_finds_the_weights():
    r = np.random.default_rng(2)
    x = r.random((4000, 5)) * 3
    y = (r.random(4000) < 1 / (1 + np.exp(-(x @ np.array([2.0, 3.0, 0.0, 1.0, 2.0]) - 8)))).astype(float)
    beta, bias = toxicity.fit(x, y, y.mean())
    assert np.abs(beta - [2, 3, 0, 1, 2]).max() < 0.4 and abs(bias + 8) < 1


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.score(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")).where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    bad, good = ([r.predicted for r in out if r.toxic == k] for k in (1, 0))
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.02 * len(good)


def test_grammar_tells_clauses_apart():
    g = toxicity.Grammar({"idiot ": 4.0, "trash": 4.0})
    names = dict(zip(toxicity.FEATURES, range(5), strict=True))
    f = lambda t: {n: float(v) for n, v in zip(names, g.features(t.encode()), strict=True) if v}
    assert set(f("an idiot wrote it")) == {"plain"} and set(f("you are an idiot")) == {"targeted"}
    assert set(f("he is not an idiot")) == {"negated"} and set(f("she said idiot")) == {"reported"}
    assert set(f("I will find you tonight")) == {"threat"} and f("idiotic") == {} and set(f("trashy idea")) == {"plain"}
    assert set(f("you there. Idiot")) == {"plain"}  # another clause


@pytest.mark.parametrize("text", ["I  will   kill them", "i will\tkill them", 'i will "kill" them', "i - will - hurt them", "now: burn \t your  house", "\n  watch\t\tyour (back)", "  kill   you"])
def test_threats_in_irregular_space(text):
    g = toxicity.Grammar({"idiot ": 4.0})
    whole = text.lower().encode().translate(toxicity.CLAUSES).split(b"\n")
    want = np.log1p(sum(g.clause(c) for c in whole))
    assert want[toxicity.FEATURES.index("threat")] > 0 and (g.features(text.encode()) == want).all()


def test_url_filter(spark, sf):
    cases = {
        None: ("", "", None), "no scheme": ("", "", None), "http://": ("", "", None), "HTTP://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/"),
        "https://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/"), "https://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/"),
        "https://b.com/": ("b.com", "/", "com/"), "https://b.com": ("b.com", "", None), "https://b.com?x": ("b.com", "", None), "ftp://a.net/es/1": ("a.net", "/es/1", "net/es/"),
        "https://a.net/de/": ("a.net", "/de/", None), "https://notexample.com/en/": ("notexample.com", "/en/", "com/"), "a://b://c/d": ("b:", "//c/d", None),
    }
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(cases)], "page_id long, url string, host string")
    out = {r.page_id: r for r in url_filter.judge(df).collect()}
    for k, (host, path, rule) in enumerate(cases.values()):
        assert (out[k].host, out[k].path, out[k].rule) == (host, path, rule)
        if rule:
            assert out[k].verdict == ("allow" if rule in ("com/", "www.example.com/en/") else "block")
        assert out[k].verdict in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0
    pages = table(spark, sf, "pages").select("page_id", "url")
    assert url_filter.judge(pages).count() == pages.count()


def test_url_models_read_query_and_fragment(spark):
    """Undecided URLs of one host and path, told apart by what decided ones have behind them."""
    learnt = [f"https://{host}/es/{'abcd'[i % 4]}{mark}" for i in range(80) for host, mark in (("a.com", "?story=news#text"), ("a.net", "?banner=casino#buy"))]
    asked = ["https://a.org/x?story=news", "https://a.org/x?banner=casino", "https://a.org/x#text", "https://a.org/x#buy"]
    df = spark.createDataFrame([(u,) for u in learnt + asked], "url string")
    out = {r.url: r for r in url_filter.judge(df).collect()}
    good, bad, better, worse = (out[u].score for u in asked)
    assert good > bad and better > worse and all(out[u].rule is None for u in asked)


def witten_bell(texts: list[bytes], of: bytes) -> float:
    """log p of a URL under the counts of texts, from their substrings."""
    order = url_filter.ORDER
    padded = [b"\0" * order + t for t in texts]
    total = 0.0
    for i in range(len(of)):
        p = 1 / 256
        for k in range(order + 1):
            ctx = (b"\0" * order + of)[order + i - k : order + i]
            seen = [x[j : j + 1] for x in padded for j in range(order, len(x)) if x[j - k : j] == ctx]
            if seen:
                p = (seen.count(of[i : i + 1]) + len(set(seen)) * p) / (len(seen) + len(set(seen)))
        total += math.log(p)
    return total


def test_url_models_by_brute_force():
    texts = [b"abcab", b"abd", b"abcab"]
    keys, n = np.unique(url_filter.keys_of(texts)[0], return_counts=True)
    m = url_filter.Model(keys, n)
    for of in (b"ab", b"abcabd", b"zz", b"a"):
        assert math.isclose(m.log_p(url_filter.keys_of([of])[0]).sum(), witten_bell(texts, of))


def test_url_models_count_all_and_the_rest(spark):
    """What Spark counts over partitions and folds, against models of the texts themselves; scores of a batch against single ones."""
    r = random.Random(3)
    urls = [(f"https://h.{'com' if k % 2 else 'net'}/{'abc'[r.randrange(3)]}{r.randrange(30)}", "allow" if k % 2 else "block", k % 5) for k in range(120)] + [("none", "allow", 1)]
    models = url_filter.counted(spark.createDataFrame(urls, "url string, decided string, fold int").repartition(5))
    asked = ["https://h.com/a1", "https://x.org/", "https://h.net/c22?q#f", "nothing", None]
    for kind in ("allow", "block"):
        for name, folds in (("rest", {1, 2, 3, 4}), ("all", {0, 1, 2, 3, 4})):
            texts = [url_filter.cleaned(u) for u, d, f in urls if d == kind and f in folds]
            for u in asked[:3]:
                assert math.isclose(models[kind, name].log_p(url_filter.keys_of([url_filter.cleaned(u)])[0]).sum(), witten_bell(texts, url_filter.cleaned(u)))
    got, full = url_filter.scores(asked, models["allow", "all"], models["block", "all"])
    assert full.tolist() == [True, True, True, False, False] and (got[3:] == 0).all()
    for u, s in zip(asked[:3], got, strict=False):
        texts = [[url_filter.cleaned(x) for x, d, _ in urls if d == kind] for kind in ("allow", "block")]
        assert math.isclose(s, (witten_bell(texts[0], url_filter.cleaned(u)) - witten_bell(texts[1], url_filter.cleaned(u))) / len(url_filter.cleaned(u)))


def test_balanced_cut_by_brute_force():
    r = random.Random(7)
    for _ in range(20):
        rows = [(kind, int(r.gauss(20 if kind == "allow" else -20, 40))) for kind in ("allow", "block") for _ in range(r.randrange(1, 60))]
        cut = url_filter.balanced_cut(Counter(rows))
        value = lambda c: sum(k * url_filter.STEP >= c for t, k in rows if t == "allow") / sum(t == "allow" for t, _ in rows) + sum(k * url_filter.STEP < c for t, k in rows if t == "block") / sum(t == "block" for t, _ in rows)  # noqa: E731, B023
        best = max(value(k * url_filter.STEP) for k in range(-4096, 4097))
        assert math.isclose(value(cut), best)
    assert url_filter.balanced_cut({("allow", 3): 5}) == 0.0


def test_url_filter_of_repeated_and_long_urls(spark):
    rows = [("https://a.com/x",), ("https://b.net/fr/x",), ("https://c.org/" + "y" * 50_000,), ("https://c.org/x",), ("https://c.org/x",), (None,)] + [("https://b.net/es/1",)] * 3
    out = url_filter.judge(spark.createDataFrame(rows, "url string").repartition(3)).collect()
    assert len(out) == len(rows)
    assert len({(r.score, r.verdict) for r in out if r.url == "https://c.org/x"}) == 1
    assert all(math.isfinite(r.score) for r in out) and {r.verdict for r in out if r.url is None} == {"allow"}


def test_pipeline_against_brute_force(spark, sf):
    """Every stage on what its predecessor kept, by other means."""
    docs = table(spark, sf, "documents")
    bench = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    windows = {w for _, t in bench for w in decontamination.windows_of(decontamination.words_of((t or "").encode()), 10)}
    for name, stage in stages.STAGES:
        before, columns = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], docs.columns
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = Counter((r.doc_id, r.text) for r in docs.collect())
        if name != "sharding":
            assert docs.columns == columns
        if name == "toxicity":
            scored = {r.doc_id: r.predicted for r in toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()}
            assert set(after) == {(i, t) for i, t, *_ in before if not scored[i]}
        elif name == "ngram_join":
            _, links = brute_links(before)
            root = list(range(len(before)))
            for _ in range(20):
                root = [min([root[i], *(root[j] for j in links[i])], key=lambda k: before[k][0]) for i in range(len(before))]
            assert set(after) == {(before[r][0], before[r][1]) for r in root}
        elif name == "decontamination":
            def clean(text):
                w = decontamination.words_of((text or "").encode())
                return not any(tuple(w[i : i + k]) in windows for k in {len(x) for x in windows} for i in range(len(w) - k + 1))

            assert set(after) == {(i, t) for i, t, *_ in before if clean(t)}
        elif name == "mixing":
            took = {r.doc_id: (r.size, r.taken) for r in mixing.mix(spark.createDataFrame(before, "doc_id long, text string, lang string, source string")).collect()}
            assert after == Counter({(i, t): -(-took[i][1] // took[i][0]) if took[i][0] else 1 for i, t, *_ in before} ) - Counter()
        else:
            assert after == Counter((i, t) for i, t, *_ in before)
            counts = [r["count"] for r in docs.groupBy("shard").count().collect()]
            assert max(counts) - min(counts) <= 1 and len(counts) == 40


def test_stages_take_odd_rows(spark, sf, docs, empty):
    """Nulls, empty and repeated rows, and columns whose names clash, through every stage; and no rows at all."""
    for name, stage in stages.STAGES:
        out = stage(spark, docs, sf)
        assert stage(spark, empty, sf).count() == 0
        if name != "sharding":
            assert out.dtypes == docs.dtypes
            assert {r["size"] for r in out.collect()} == {"x"}


CLASHING = ["a", "s", "k", "lo", "hi", "rank", "base", "before", "arc", "salt", "own", "key", "run_arc", "ring_at", "place", "part", "times", "time", "running", "slice", "start", "target", "taken", "size", "_text_hash", "gone_id", "gone_hash", "_own_x", "sid", "root", "x", "load", "digest", "row", "held_out", "predicted", "_on", "_items", "n_hit", "spans", "a.b c`d"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Forty documents with columns of every name that operators use inside."""
    rows = [(i, f"w{i % 7} " * (i + 1), f"s{i % 3}", *["kept"] * len(CLASHING)) for i in range(40)]
    return spark.createDataFrame(rows, ["doc_id", "text", "source", *CLASHING])


def test_names_that_clash(spark, sf, clashing):
    """No operator crashes on them, and stages give every column back as it was."""
    assigned = sharding.assign(clashing, 7)
    assert assigned.columns == [*clashing.columns, "shard", "slot"]
    rows = assigned.collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [5, 5, 6, 6, 6, 6, 6] and all(r[3:-2] == ("kept",) * len(CLASHING) for r in rows)
    assert mixing.mix(clashing).count() == 40
    for out in (mixing.mixed_rows(clashing), near_join.one_of_each(clashing)):
        assert out.columns == clashing.columns and all(r[3:] == ("kept",) * len(CLASHING) for r in out.collect())
    for name, stage in stages.STAGES:
        out = stage(spark, clashing, sf)
        assert out.columns[: len(clashing.columns)] == clashing.columns, name
        assert all(r[3 : 3 + len(CLASHING)] == ("kept",) * len(CLASHING) for r in out.collect()), name
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "w1 " * 10)], "item_id long, text string")
    outs = (quality.score(clashing, labels), toxicity.score(clashing, labels), decontamination.decontaminate(clashing, bench), lm_scoring.score(clashing, labels), exact_dedup.dedup(clashing), substring_dedup.dedup(clashing), near_join.classes(clashing), url_filter.judge(clashing.withColumnRenamed("text", "url")))
    assert [out.count() for out in outs] == [40] * len(outs)


def test_sharding_by_brute_force(spark):
    """Shard and slot of every row, from the ring and the stated order alone."""
    shards, vnodes, rows = 5, 4, [(i if i % 6 else None, f"t{i % 50}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = df.select("doc_id", "text", F.xxhash64("text").alias("t"), F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long").alias("at"))
    keyed = hashed.withColumn("salt", F.pmod(F.xxhash64("at", "t"), F.lit(sharding.SALTS))).collect()
    ring = sharding.Ring(shards, vnodes)
    by_arc = defaultdict(list)
    for r in sorted(keyed, key=lambda r: (r.salt, r.at, r.doc_id is None, r.doc_id or 0, r.t)):
        by_arc[sum(p < r.at for p in ring.places) % len(ring.places)].append((r.doc_id, r.text))
    room, used, want = [80] * shards, [0] * shards, Counter()
    rest = {arc: list(of) for arc, of in by_arc.items()}
    for turn in range(shards):
        for arc in sorted(rest):
            shard = ring.way(arc)[turn]
            while rest[arc] and used[shard] < room[shard]:
                want[(*rest[arc].pop(0), shard, used[shard])] += 1
                used[shard] += 1
    got = Counter((r.doc_id, r.text, r.shard, r.slot) for r in sharding.assign(df.repartition(3), shards, vnodes).collect())
    assert got == want


def test_one_more_shard_moves_few(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before, after = ({r.doc_id: r.shard for r in sharding.assign(rows, n).collect()} for n in (20, 21))
    assert sum(before[i] != after[i] for i in before) < 3 * len(before) / 21


def test_digest_index_keeps_its_buckets(spark, tmp_path):
    """Opened under another number of shuffle partitions, every digest is still found."""
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    path = str(tmp_path / "index")
    had = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        assert exact_dedup.DigestIndex(spark, path).dedup(rows, load="first").where("kept").count() == 50
        spark.conf.set("spark.sql.shuffle.partitions", 3)
        again = exact_dedup.DigestIndex(spark, path)
        assert again.buckets == 8 and again.dedup(rows, load="second").where("kept").count() == 0 and again.entries().count() == 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    with pytest.raises(ValueError, match="8 buckets"):
        exact_dedup.DigestIndex(spark, path, 3)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


@pytest.mark.parametrize("load", [None, "monday"])
def test_a_load_can_be_repeated(spark, tmp_path, load):
    """The same load twice keeps the same rows, also where its first half alone reached the index."""
    rows = [(i, f"text {i % 30}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    once, twice = (sorted(index.dedup(d, load=load, by_content=load is None).collect()) for d in (docs, docs.repartition(5)))
    assert once == twice and sum(r.kept for r in once) == 30
    more = spark.createDataFrame([(100, "text 1"), (101, "new")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.dedup(more, load="more").collect()} == {(100, 1, False), (101, 101, True)}
    half = exact_dedup.DigestIndex(spark, str(tmp_path / "half"), 4)
    digests = docs.where("doc_id < 9").select(F.unhex(F.sha2("text", 256)).alias("digest"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit("tuesday").alias("load"))
    half.append(digests)
    assert sum(r.kept for r in half.dedup(docs, load="tuesday").collect()) == 30


def test_substring_dedup_orders_rows_without_id(spark):
    """The same rows keep a shared passage however they are dealt, and the largest id is no null."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, f"{c} {passage}") for c in "abcdefgh"] + [(2**63 - 1, f"last {passage}")]
    had, found = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for n in (1, 3, 5, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
            found.add(tuple(sorted((str(r.doc_id), r.n_removed, r.kept) for r in out)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    assert len(found) == 1
    (only,) = found
    assert [r for r in only if r[1] == 0] == [(str(2**63 - 1), 0, f"last {passage}")]


def test_ranges_go_by_the_keys():
    """Packing follows the keys, however many ranges there are, and answers come back in their order."""
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    for ranges in (1, 3, 700, 1 << 30):
        sent = blocks.pack(keys, ranges, 4, (keys % np.uint64(251)).astype(np.uint8))
        assert sent.num_rows <= min(ranges, len(keys))
        replies = []
        for row in sent.group_by("rng").aggregate([]).column("rng").to_pylist():
            own = sent.filter(pc.equal(sent.column("rng"), row))
            at, counts, (k, more) = blocks.unpack(own, np.uint8)
            assert (more == (k % np.uint64(251)).astype(np.uint8)).all()
            replies.append(blocks.back(at, counts, row, k % np.uint64(2) == 0, k))
        even, same = blocks.answers(pa.concat_tables(replies), keys, ranges, bool, np.uint64)
        assert (same == keys).all() and (even == (keys % np.uint64(2) == 0)).all()


def test_prefix_sums(spark):
    r = random.Random(4)
    rows = [(r.choice("abcdef") * r.randrange(1, 4), i, r.randrange(9)) for i in range(200)] + [(None, 200, 5)]
    df = spark.createDataFrame(rows, "name string, i long, n long")
    got = {x.i: (x.place, x.before) for x in prefix_sums(df, [F.col("name").asc_nulls_last(), F.col("i")], "sums", before="n").collect()}
    total = 0
    for place, (_, i, n) in enumerate(sorted(rows, key=lambda x: (x[0] is None, x[0] or "", x[1]))):
        assert got[i] == (place, total)
        total += n


def test_mixing_many_sources(spark):
    """Targets of 500 sources by pouring, and rows without an id are spread over the slices."""
    r = random.Random(8)
    rows = [(None if i % 3 else i, " ".join("w" for _ in range(r.randrange(1, 30))) + f" t{i}", f"s{r.randrange(500)}") for i in range(1500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("source", "target", "source_size").distinct().collect()
    total = Counter()
    for _, t, s in rows:
        total[s] += len(t.split())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total))}
    low, high = 0.0, 2.0 * max(total.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * total[s], weight[s] * level) for s in total) < 1.5 * sum(total.values()) else (low, level)
    assert len(out) == len(total) and all(math.isclose(x.target, min(2 * total[x.source], weight[x.source] * low), rel_tol=1e-6) for x in out)


def test_written_tables_are_released(spark):
    since = shared.held()
    kept = shared.written(spark.range(5), "kept")
    for k in range(3):
        last = shared.written(spark.range(k), "passing")
    shared.release(spark, since + 1, keep=1)
    assert shared.held() == since + 2 and kept.count() == 5 and last.count() == 2


def test_a_second_delivery_keeps_nothing(spark, sf, tmp_path):
    """The same rows under another name are copies of the first load; under its own name they are the first load again."""
    docs, path = table(spark, sf, "documents"), str(tmp_path / "index")
    kept = lambda load, rows=docs: {r.doc_id for r in exact_dedup.dedup(rows, path, load).where("kept").collect()}
    first = kept("monday")
    assert len(first) == docs.select(F.sha2(exact_dedup.normalised("text"), 256)).distinct().count()
    assert kept("tuesday") == set() and kept("wednesday", docs.where("doc_id > 0")) == set()
    assert kept("monday", docs.repartition(3)) == first
    with pytest.raises(ValueError, match="needs a name"):
        exact_dedup.dedup(docs, path)
    with pytest.raises(ValueError, match="needs a name"):
        exact_dedup.DigestIndex(spark, path).dedup(docs, load="x", by_content=True)


def test_quality_takes_one_text_of_an_id(spark):
    """Of several texts under one labelled id the least pooled one is learned from, however the rows are dealt."""
    rows = [(i % 40, f"{'good fine text' if i % 2 else 'bad junk spam'} w{i} w{i % 7} " * 6) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality.score(d, labels).collect()) for d in (docs.repartition(2), docs.orderBy(F.col("text").desc()).repartition(5)))
    assert a == b


def test_decontamination_builds_each_automaton_once(spark, monkeypatch):
    """Several automata over several chunks of documents: a worker holds them all, while they fit."""
    built = []
    monkeypatch.setattr(decontamination, "Part", lambda items, window, f=decontamination.Part: built.append(1) or f(items, window))
    monkeypatch.setattr(decontamination, "_parts", {})
    items = [[(f"i{k}", " ".join(f"q{k}x{j}" for j in range(12)).encode())] for k in range(3)]
    for _ in range(4):
        for k, part in enumerate(items):
            assert decontamination.part_of(f"run-{k}", part, 10).names
    assert len(built) == 3
    monkeypatch.setattr(decontamination, "HELD_BYTES", 0)
    for k, part in enumerate(items):
        decontamination.part_of(f"other-{k}", part, 10)
    assert len(decontamination._parts) == 1
