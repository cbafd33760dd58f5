"""Removal of word sequences that occur earlier in the corpus, found by difference-cover anchors.

Words are runs outside [\\x20\\x09-\\x0D]. A window is `window` consecutive words. Every word that is covered by a window whose
sequence also starts earlier (smaller doc_id, or same document and earlier start) is removed; windows are judged on the input.

Anchors: D = {0, 1, 3, 9} is a perfect difference cover modulo 13: for any two places there is a shift below 13 that brings both onto
D. So of two equal windows of 20 words, some pair of equal sub-windows of 8 words starts at the same offset with both starts in D
modulo 13: only those 4 of 13 starts are hashed and exchanged. A window is a candidate if it contains an anchor that occurs twice in
the corpus; candidates are extended to the whole window, whose 96-bit hash decides. Anchors only narrow the search: a collision among
them costs work, not correctness.

Documents are ordered by doc_id, a null one after all others; rows that share a doc_id, or have none, by a 63-bit hash of their text
(not by place or partition, so the result is the same however the rows are dealt). Of rows that agree in both one comes first and the
others lose all their windows. They share a block; rows that differ in id or text do not.

Null and empty texts have no words; texts under `window` words keep everything; long texts are held whole in their block. An empty
table gives no rows. Only doc_id and text are read, so names of other columns cannot clash; doc_id is read as a long, so a text that is
no number raises.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import blocks as X
from tidewatch.llm.shared import WordHash, mixed

#: A perfect difference cover: every residue modulo PERIOD is a difference of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
BASE = 0x9E3779B97F4A7C15
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def order_of(doc_id: int | None, text: bytes) -> tuple[int, int]:
    """The document's place in the order: its id, then a number that is larger for every null id and otherwise the text's hash."""
    return (np.iinfo(np.int64).max if doc_id is None else doc_id), xxhash.xxh3_64_intdigest(text) >> 1 | (doc_id is None) << 63


class Block:
    """The documents of one block in order, their words as hashes, and hashes of windows over them."""

    def __init__(self, table: pa.Table, window: int):
        ids, texts = table.column("doc_id").to_pylist(), [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        ranks = [order_of(i, t) for i, t in zip(ids, texts, strict=True)]
        order = sorted(range(len(ids)), key=ranks.__getitem__)
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.rank = np.array([ranks[i][0] for i in order], dtype=np.int64), np.array([ranks[i][1] for i in order], dtype=np.uint64)
        hashes, cache = [], WordHash()
        for text in self.texts:
            hashes.append(cache.of(text.split()))
        self.sizes = np.array([len(h) for h in hashes], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.words = mixed(np.concatenate(hashes)) if hashes else np.zeros(0, dtype=np.uint64)
        self.window, self.anchor = window, window - PERIOD + 1
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.place = (np.arange(len(self.words)) - (self.ends - self.sizes)[self.doc]).astype(np.int32)
        self.left = self.sizes.astype(np.int32)[self.doc] - self.place

    def sums(self, words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        n = len(words)
        up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, dtype=np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
        before = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * up[:n], dtype=np.uint64)])
        return mixed((before[starts + size] - before[starts]) * down[starts])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts in the cover, and the hashes there."""
        on = np.isin(np.arange(PERIOD), COVER)[self.place % PERIOD]
        starts = np.flatnonzero(on & (self.left >= self.anchor))
        return starts, self.sums(self.words, starts, self.anchor)

    def candidates(self, starts: np.ndarray) -> np.ndarray:
        """Starts of the windows that contain an anchor at one of starts."""
        n = len(self.words)
        step = np.zeros(n + 1, dtype=np.int32)
        np.add.at(step, np.maximum(starts + self.anchor - self.window, starts - self.place[starts]), 1)
        np.add.at(step, starts + 1, -1)
        return np.flatnonzero((np.cumsum(step[:n]) > 0) & (self.left >= self.window))

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows sorted by hash: hash, check, first start; and for each of starts its place among them."""
        keys = self.sums(self.words, starts, self.window)
        check = (self.sums(mixed(self.words ^ np.uint64(BASE)), starts, self.window) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((starts, check, keys))
        k, c = keys[order], check[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        place = np.empty(len(k), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        return k[new], c[new], starts[order][new], place


def dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words joined by one space) for each row of docs.

    The text of docs is shuffled once, and so are the packed anchors and candidate windows.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must exceed {PERIOD} words")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = X.blocks_for(docs, each=BLOCK_BYTES)
    placed = X.blocked(docs, ranges, "doc_id", "text")

    def found(key: tuple, table: pa.Table) -> pa.Table:
        keys, times = np.unique(Block(table, window).anchors()[1], return_counts=True)
        return X.pack(keys, ranges, key[0].as_py(), (times > 1).astype(np.uint8))

    def repeated(key: tuple, sent: pa.Table) -> pa.Table:
        blocks, counts, (keys, more) = X.unpack(sent, np.uint8)
        _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
        return X.back(blocks, counts, key[0].as_py(), (times[place] > 1) | (more > 0))

    def candidates(table: pa.Table, got: pa.Table) -> tuple[Block, np.ndarray]:
        block = Block(table, window)
        starts, hashes = block.anchors()
        keys, place = np.unique(hashes, return_inverse=True)
        (again,) = X.answers(got, keys, ranges, bool)
        return block, block.candidates(starts[again[place]])

    def extended(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        block, starts = candidates(table, got)
        keys, check, first, _ = block.windows(starts)
        return X.pack(keys, ranges, key[0].as_py(), check, *(r[block.doc[first]] for r in block.rank))

    def owned(key: tuple, sent: pa.Table) -> pa.Table:
        blocks, counts, (keys, check, ids, ties) = X.unpack(sent, np.uint32, np.int64, np.uint64)
        order = np.lexsort((ties, ids, check, keys))
        k, c = keys[order], check[order]
        first = np.ones(len(k), dtype=bool)
        first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        own = np.zeros(len(k), dtype=bool)
        own[order[first]] = True
        return X.back(blocks, counts, key[0].as_py(), own)

    def kept(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        phase = got.column("phase").to_numpy()
        block, starts = candidates(table, got.filter(pa.array(phase == 0)))
        keys, _, first, place = block.windows(starts)
        (own,) = X.answers(got.filter(pa.array(phase == 1)), keys, ranges, bool)
        stays = own[place] & (first[place] == starts) if len(starts) else np.zeros(0, dtype=bool)
        step = np.zeros(len(block.words) + 1, dtype=np.int32)
        np.add.at(step, starts[~stays], 1)
        np.add.at(step, starts[~stays] + window, -1)
        gone = np.cumsum(step[:-1]) > 0
        out = []
        for doc_id, text, size, end in zip(block.ids, block.texts, block.sizes.tolist(), block.ends.tolist(), strict=True):
            words, lost = text.split(), gone[end - size : end]
            removed = int(lost.sum())
            if removed:
                words = [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
            body = b" ".join(words)
            out.append((doc_id, size, removed, hashlib.sha256(body).hexdigest(), body.decode()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    by_block = placed.groupBy("block")
    anchors = by_block.applyInArrow(found, X.SENT).groupBy("rng").applyInArrow(repeated, X.BACK)
    windows = by_block.cogroup(anchors.groupBy("block")).applyInArrow(extended, X.SENT).groupBy("rng").applyInArrow(owned, X.BACK)
    both = anchors.withColumn("phase", F.lit(0)).unionByName(windows.withColumn("phase", F.lit(1)))
    return by_block.cogroup(both.groupBy("block")).applyInArrow(kept, RESULT)
