"""Ranked search for words by inverted treaps: the k best documents for each item of a query set.

Terms are the maximal runs of A-Z, a-z, 0-9 and signs from U+0080 on in the whole text; only A-Z are lower-cased. With N documents that
have a term, L terms in them all (with repeats), n terms in one document, df documents that hold a term and tf its occurrences in one:

    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))    m = 100 - 90 + (90 * n * N) div L
    score = sum over an item's different terms of w * ((1000000000 * tf) div (1000 * tf + 8 * m))

A first pass deals documents into blocks of CHUNK_DOCS rows or CHUNK_BYTES of text as they are read, without a shuffle, and writes for
each block the postings of the terms that the items ask for, by term and then by document. N, L and df are sums over blocks.

A second pass makes a treap of each term's postings in a block: a binary tree in order of doc_id whose heap order is the impact (of equal
ones a hash decides, which keeps it flat where documents are copies of each other). All treaps of a block are built at once, from the
nearest greater neighbours of every posting. An item's treaps are traversed simultaneously: a range of documents has a subtree in each
treap, whose root holds the greatest impact there; if the sum of these cannot enter the best k so far, the range is left out. Otherwise
the document of the greatest root is scored, and the range falls into the two on its sides. Ranges with the greatest sums come first,
BATCH of them at a step. The best k of an item are carried from block to block within a task; each task returns k rows for an item at
most, and a second and third selection of k make the result.

Equal scores are ordered by doc_id, null last; documents that agree in both are different rows with ranks of their own. Null and empty texts
and items have no terms; items without terms, and those that no document answers, have no rows. Long texts are read once and whole.
Items come to the driver ITEM_BYTES of text at a time, each such batch going over all documents. Names of other columns cannot clash;
doc_id is read as a long, so a text that is no number raises. Impacts are 64-bit: n * N must stay below 10 ** 17.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import batches_by_bytes, mixed, written

CHUNK_DOCS, CHUNK_BYTES = 16384, 32 << 20
#: Text of items that is held at a time.
ITEM_BYTES = 4 << 20
#: Ranges of documents that are split in one step.
BATCH = 256
#: Everything that ends a term becomes a blank, A-Z become a-z.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NO_ID = np.iinfo(np.int64).max
BLOCK = "n_docs long, n_terms long, terms array<int>, counts array<int>, ids binary, sizes binary, docs binary, tfs binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of documents: their ids and numbers of terms in order of id, and (term, document, occurrences) by term and document."""

    def block(ids: list[int], sizes: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, [len(f) for f in found])
        keys, tf = np.unique(np.concatenate(found) << 32 | doc, return_counts=True)
        term, doc = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
        terms, counts = np.unique(term, return_counts=True)
        n = np.array(sizes, dtype=np.int64)
        row = {"n_docs": int((n > 0).sum()), "n_terms": int(n.sum()), "terms": terms.astype(np.int32), "counts": counts.astype(np.int32)}
        row |= {"ids": np.array(ids, dtype=np.int64)[order].tobytes(), "sizes": n[order].tobytes(), "docs": doc.tobytes(), "tfs": tf.astype(np.int32).tobytes()}
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, found, held = [], [], [], 0
        for part, texts in batches_by_bytes(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                words = terms_of(text)
                known = [t for t in map(vocabulary.get, words) if t is not None]
                ids.append(NO_ID if doc_id is None else doc_id)
                sizes.append(len(words))
                found.append(np.array(known, dtype=np.int64))
                held += len(text)
                if len(ids) >= CHUNK_DOCS or held >= CHUNK_BYTES:
                    yield block(ids, sizes, found)
                    ids, sizes, found, held = [], [], [], 0
        if ids:
            yield block(ids, sizes, found)

    return docs.mapInArrow(chunks, BLOCK)


def nearest_greater(rank: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it, in its own segment, with a greater rank, else -1; edge marks where segments begin."""
    up = np.arange(-1, len(rank) - 1)
    up[edge] = -1
    open_ = np.flatnonzero(up >= 0)
    while open_.size:
        open_ = open_[rank[up[open_]] < rank[open_]]
        up[open_] = up[up[open_]]
        open_ = open_[up[open_] >= 0]
    return up


class Treaps:
    """The treaps of all terms of a block, in arrays over its postings: by document within a term; left and right are -1 where there is none."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_docs: int):
        n = len(docs)
        self.docs, self.impact, self.n_docs = docs, impact, n_docs
        ends = np.cumsum(counts)
        starts = ends - counts
        self.slot = {t: i for i, t in enumerate(terms.tolist())}
        self.keys = np.repeat(np.arange(len(terms), dtype=np.int64) * n_docs, counts) + docs
        rank = np.empty(n, dtype=np.int64)
        rank[np.lexsort((mixed(np.arange(n, dtype=np.uint64)), impact))] = np.arange(n)
        edge = np.zeros(n, dtype=bool)
        edge[starts] = True
        before = nearest_greater(rank, edge)
        edge[:] = False
        edge[ends - 1] = True
        after = nearest_greater(rank[::-1], edge[::-1])[::-1]
        after = np.where(after < 0, -1, n - 1 - after)
        self.left, self.right = np.full((2, n), -1)
        under_after = (after >= 0) & ((before < 0) | (rank[after] < rank[before]))
        under_before = (before >= 0) & ~under_after
        self.left[after[under_after]] = np.flatnonzero(under_after)
        self.right[before[under_before]] = np.flatnonzero(under_before)
        top = np.flatnonzero((after < 0) & (before < 0))
        self.roots = top  # one a term, in the order of terms

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The roots of the subtrees of node (range, term) for documents over low and under high."""
        flat = node.ravel()
        low, high = np.repeat(low, node.shape[1]), np.repeat(high, node.shape[1])
        at = np.flatnonzero(flat >= 0)
        while at.size:
            doc = self.docs[flat[at]]
            over, under = doc >= high[at], doc <= low[at]
            out = over | under
            at, over = at[out], over[out]
            here = flat[at]
            flat[at] = np.where(over, self.left[here], self.right[here])
            at = at[flat[at] >= 0]
        return flat.reshape(node.shape)

    def scores(self, slots: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The whole score of each document for the terms in slots, found by their order."""
        want = (slots[None, :] * self.n_docs + doc[:, None]).ravel()
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.impact[at], 0).reshape(len(doc), len(slots)).sum(axis=1)

    def best(self, terms: list[int], ids: np.ndarray, top: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """top (scores and ids, best first, k at most), with the documents of this block that are better."""
        slots = np.array(sorted(self.slot[t] for t in terms if t in self.slot), dtype=np.int64)
        if not len(slots):
            return top
        impact = np.append(self.impact, 0)  # at -1
        node, low, high = self.roots[slots][None, :], np.array([-1]), np.array([self.n_docs])
        most = impact[node].sum(axis=1)
        while True:
            # what is equal to the last of the best counts only with a smaller id
            least, last = (top[0][-1], top[1][-1]) if len(top[0]) == k else (0, -1)
            may = (most > least) | (most == least) & (ids[np.minimum(low + 1, self.n_docs - 1)] < last)
            node, low, high, most = node[may], low[may], high[may], most[may]
            if not len(most):
                return top
            first = np.argpartition(-most, BATCH)[:BATCH] if len(most) > BATCH else np.arange(len(most))
            rest = np.ones(len(most), dtype=bool)
            rest[first] = False
            here, lo, hi = node[first], low[first], high[first]
            root = here[np.arange(len(first)), impact[here].argmax(axis=1)]
            doc = self.docs[root].astype(np.int64)
            score = self.scores(slots, doc)
            scores, found = np.concatenate([top[0], score]), np.concatenate([top[1], ids[doc]])
            order = np.lexsort((found, -scores))[:k]
            top = scores[order], found[order]
            parts = self.within(np.concatenate([here, here]), np.concatenate([lo, doc]), np.concatenate([doc, hi]))
            node, low, high = np.concatenate([node[rest], parts]), np.concatenate([low[rest], lo, doc]), np.concatenate([high[rest], doc, hi])
            most = np.concatenate([most[rest], impact[parts].sum(axis=1)])


def answers(blocks: DataFrame, items: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The k best documents of each task for each item, as item, score, doc_id."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                terms, counts = (np.array(batch.column(c)[i].as_py(), dtype=np.int64) for c in ("terms", "counts"))
                ids, sizes = (np.frombuffer(batch.column(c)[i].as_py(), dtype=np.int64) for c in ("ids", "sizes"))
                docs, tf = (np.frombuffer(batch.column(c)[i].as_py(), dtype=np.int32) for c in ("docs", "tfs"))
                if not len(docs):
                    continue
                m = 100 - 90 + 90 * sizes * n_docs // n_terms
                tf = tf.astype(np.int64)
                impact = np.repeat(weights[terms], counts) * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
                treaps = Treaps(terms, counts, docs, impact, len(ids))
                tops = [treaps.best(own, ids, top, k) for own, top in zip(items, tops, strict=True)]
        rows = [(q, int(s), int(d)) for q, top in enumerate(tops) for s, d in zip(*top, strict=True) if s > 0]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        ids = np.array(columns[2], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(ids, mask=ids == NO_ID)], names=["item", "score", "doc_id"])

    return blocks.mapInArrow(searched, "item long, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of docs for each row of items (item_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = items.select("item_id").schema
    out = spark.createDataFrame([], f"item_id {schema[0].dataType.simpleString()}, rank int, doc_id long, score long")
    names: list[tuple] = []
    asked: list[set[bytes]] = []
    held = 0

    def over() -> DataFrame:
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
        blocks = written(postings(docs, vocabulary), "postings")
        n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        each = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for term, df in each.collect():  # the items' terms at most
            weights[term] = math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df + 1)))
        found = answers(blocks, [[vocabulary[t] for t in own] for own in asked], weights, n_docs, n_terms, k)
        best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        found = found.withColumn("salt", F.spark_partition_id() % 64).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best))).where(F.col("rank") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
        known = spark.createDataFrame([(i, *name) for i, name in enumerate(names)], f"item long, item_id {schema[0].dataType.simpleString()}")
        return found.join(F.broadcast(known), "item").select("item_id", "rank", "doc_id", "score")

    for row in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        terms = set(terms_of((row.text or "").encode()))
        if terms:
            names.append((row.item_id,))
            asked.append(terms)
            held += len(row.text)
        if held >= ITEM_BYTES:
            out = out.unionByName(over())
            names, asked, held = [], [], 0
    return out.unionByName(over()) if asked else out
