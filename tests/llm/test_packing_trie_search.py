"""Packing, conversation tries and lexical search against brute force, on small tables with the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tidewatch.llm import lexical_search, packing, prefix_trie, queries

DOCS = "doc_id long, text string, lang string, length string, sequence_id string, score string, rank string"
JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))


def make_docs():
    r = random.Random(5)
    words = [f"Wort{i}" for i in range(200)] + ["straße", "été", "don't", "A1", "x_y", "日本", "<|endoftext|>", " ", "a​b"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, prose(r.choice([0, 1, 5, 30, 100, 400]))) for i in range(80)]
    rows += [(80, prose(9000)), (81, None), (82, ""), (83, " \n\t "), (None, "Wort1 Wort2 lonely"), (None, None), (84, "twin Wort3"), (84, "twin Wort3"), (85, "z" * 30_000)]
    rows += [(100 + i, "copied Wort7 Wort8 text") for i in range(60)]
    return [(i, t, "en", "x", "x", "x", "x") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def check_packing(rows, texts, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    want = Counter()
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % size or min(len(ids), size)
        at = [0, *range(head, len(ids) + 1, size)]
        for p, (a, b) in enumerate(zip(at, at[1:])):
            want[(doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= size
    return len(sequences)


@pytest.mark.parametrize("ranks", [RANKS, None])
def test_packing(docs, ranks):
    rows = packing.pack(docs, JSON, ranks, size=256).collect()
    texts = [(i, t) for i, t, *_ in make_docs()]
    n = check_packing(rows, texts, 256)
    assert n <= packing.lower_bound(Counter(r.length for r in rows), 256) + 1
    assert Counter(rows) == Counter(packing.pack(docs, JSON, ranks, size=256).collect())


def test_packing_query(spark, sf):
    rows = queries.op11_packing(spark, sf).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = check_packing(rows, texts, 1024)
    assert n <= packing.lower_bound(Counter(r.length for r in rows), 1024) + 1


def test_packing_empty(empty):
    assert packing.pack(empty, JSON, RANKS).collect() == []


def test_ids_agree_with_the_tokenizer(spark, sf):
    fast, slow = packing.Ids(JSON, RANKS), packing.Ids(JSON)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [t or "" for _, t, *_ in make_docs()]
    signs = "".join(chr(c) for c in range(0x250) if not packing.UNUSUAL.search(chr(c)))
    texts += [signs, " ".join(signs), "a\r\n  b\t\tc \n", "I'll we've 'S it's 12ab3 \n\n x"]
    assert all(fast.of(t) == slow.of(t) for t in texts)


def brute_fewest(lengths, size):
    """The fewest sequences by trying all ways to put the longest piece left."""
    best = [len(lengths)]
    order = sorted(lengths, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(order):
            best[0] = len(rooms)
            return
        for j in {room: k for k, room in enumerate(rooms) if room >= order[i]}.values():
            go(i + 1, [*rooms[:j], rooms[j] - order[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, size - order[i]])

    go(0, [])
    return best[0]


def test_genetic_search_keeps_pieces_and_finds_the_fewest():
    r = random.Random(11)
    for turn in range(12):
        lengths = [r.choice([7, 12, 13, 19, 26, 31, 33, 40, 47, 60]) for _ in range(11)]
        histogram = dict(Counter(lengths))
        people = packing.evolved([], histogram, 64, turn, 0)
        for p in people:
            held = Counter()
            for kind, n in p.items():
                assert packing.filled(kind) <= 64
                for length, k in kind:
                    held[length] += n * k
            assert held == histogram
        fewest = brute_fewest(lengths, 64)
        assert packing.lower_bound(histogram, 64) <= fewest == packing.worth(people[0])[0]


def test_crossover_injects_whole_sequences():
    r = random.Random(3)
    histogram = {40: 30, 24: 30, 33: 20, 31: 18, 5: 7}
    mother, father = packing.best_fit(histogram, {}, 64), packing.mutated(packing.best_fit(histogram, {}, 64), 64, r)
    for _ in range(20):
        child = packing.crossover(mother, father, histogram, 64, r)
        assert sum(n * k for kind, n in child.items() for _, k in kind) == sum(histogram.values())
        assert packing.worth(child)[0] <= packing.worth(mother)[0] + 2


def test_search_beats_best_fit(spark):
    """Lengths where best-fit alone needs more sequences than the islands do."""
    histogram = {6: 2, 7: 4, 10: 2, 11: 3, 12: 2, 14: 1, 16: 2, 20: 3, 27: 2, 30: 3, 33: 3, 46: 2}
    plain, found = packing.best_fit(histogram, {}, 64), packing.search(spark, histogram, 64)
    assert packing.lower_bound(histogram, 64) <= packing.worth(found)[0] <= packing.worth(plain)[0]
    assert found == packing.search(spark, histogram, 64)


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:30], (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, children = defaultdict(set), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in children[p])
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


TURNS = "conv_id long, turn long, role string, text string, depth string, node string, conv string"


def make_turns():
    r = random.Random(9)
    said = [f"so {'word ' * i}\n{i}" for i in range(4)] + [None, "", "same"]
    rows = []
    for c in [*range(0, 140), 200, 205, 219, 5000]:
        if c in (60, 81):
            continue
        for t in range(r.choice([1, 1, 2, 3, 4, 5])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(said)))
    for c in range(300, 330):  # copies, and a long one that others share deep prefixes with
        rows += [(c, t, "user", f"turn {t} of many") for t in range(40 if c % 3 else 25)]
    rows += [(7, 0, "user", "tied"), (7, 0, "assistant", "tied"), (7, None, None, None), (7, None, None, None), (None, 0, "user", "nobody"), (9, 0, "us", "er"), (9, 1, "u", "ser"), (400, 0, "user", "long " * 50_000)]
    r.shuffle(rows)
    return [(*row, "x", "x", "x") for row in rows]


@pytest.mark.parametrize("bound", [0, 30, 4096])
def test_prefix_trie(spark, bound):
    df = spark.createDataFrame(make_turns(), TURNS).repartition(3)
    if bound == 0:
        df = df.where("conv_id is null or conv_id < 300")  # each level is a job of its own here
    got = Counter(tuple(r) for r in prefix_trie.build(df, bound).collect())
    assert got == brute_trie([tuple(r)[:4] for r in df.collect()])


def test_prefix_trie_odd(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.build(none).collect() == []
    assert prefix_trie.build(spark.createDataFrame([(None, 1, "a", "b", "x", "x", "x")], TURNS)).collect() == []
    # conversation 1 has one turn and loses it, and there is no conversation 0: it is turnless
    alone = [(1, 0, "user", "a b"), (2, 0, "user", "c")]
    got = Counter(tuple(r) for r in prefix_trie.build(spark.createDataFrame([(*a, "x", "x", "x") for a in alone], TURNS)).collect())
    assert got == brute_trie(alone) and (1, 0) in {k[:2] for k in got}


def test_prefix_trie_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in queries.op12_prefix_trie(spark, sf).collect()) == brute_trie(rows)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            m = 10 + (90 * sum(c.values()) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


ITEMS = [(0, "copied Wort7"), (1, "Wort1 wort2, WORT3! été"), (2, None), (3, "..."), (4, "nowhere"), (5, "twin lonely straße 日本 x_y"), (5, "Wort9 Wort9"), (None, "Wort5 Wort150"), (6, " ".join(f"Wort{i}" for i in range(60)))]


@pytest.mark.parametrize(("chunk", "batch"), [(16384, 256), (7, 1), (20, 3)])
def test_lexical_search(spark, docs, monkeypatch, chunk, batch):
    monkeypatch.setattr(lexical_search, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(lexical_search, "BATCH", batch)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = Counter(tuple(r) for r in lexical_search.search(docs, items).collect())
    assert got == brute_search([(i, t) for i, t, *_ in make_docs()], ITEMS)


def test_lexical_search_in_batches_of_items(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 20)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = Counter(tuple(r) for r in lexical_search.search(docs, items, k=3).collect())
    assert got == brute_search([(i, t) for i, t, *_ in make_docs()], ITEMS, 3)


def test_lexical_search_empty(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(empty, items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []


def test_lexical_search_query(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert Counter(tuple(r) for r in queries.op13_lexical_search(spark, sf).collect()) == brute_search(docs, items)


def test_treaps_are_treaps_and_prune():
    r = np.random.default_rng(2)
    counts = np.array([500, 1, 37, 900])
    docs = np.concatenate([np.sort(r.choice(1000, n, replace=False)) for n in counts]).astype(np.int32)
    impact = np.concatenate([r.integers(1, 5, 500), [9], r.integers(1, 1000, 37), np.full(900, 3)])
    t = lexical_search.Treaps(np.array([2, 5, 6, 9]), counts, docs, impact, 1000)

    def walk(node, low, high, above):
        if node < 0:
            return 0, 0
        assert low < docs[node] < high and impact[node] <= above
        a, b = walk(t.left[node], low, docs[node], impact[node]), walk(t.right[node], docs[node], high, impact[node])
        return a[0] + b[0] + 1, max(a[1], b[1]) + 1

    for root, n in zip(t.roots, counts, strict=True):
        size, depth = walk(root, -1, 1000, np.iinfo(np.int64).max)
        assert size == n and depth < 60
    scored = []
    t.scores = lambda slots, doc, f=t.scores: scored.append(len(doc)) or f(slots, doc)
    none = np.zeros(0, dtype=np.int64)
    scores, ids = t.best([6], np.arange(1000), (none, none), 3)
    want = sorted(zip(-impact[501:538], docs[501:538]))[:3]
    assert list(zip(-scores, ids)) == want and sum(scored) < 38
