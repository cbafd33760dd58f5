"""Cross-entropy difference: how much better a target model than a background model predicts each document.

Two interpolated bigram models over words (runs outside [\\x20\\x09-\\x0D]) differ only in their counts: the target's come from
documents that labels mark as good (quality 1), the background's from all documents. They share one vocabulary, the words of all
documents, and one smoothing: with c counting words and pairs of a model, N its words and V the vocabulary's size,

    p(w) = (c(w) + 1) / (N + V + 1)        p(w | v) = (c(v w) + K * p(w)) / (c(v) + K)

A document starts from a mark before its first word. Its score is the mean over its words of log p_target - log p_background: above
0 it is more like the target. The two losses are in nats per word. Counts cover all documents, and nothing is cut off.

Counts are exchanged in blocks (see blocks.py): a block of documents sends each distinct word and pair once with its counts in the
block, and gets the sums over the corpus back in the same order. No model is ever in one place, whatever the size of the corpus.

Blocks are dealt by doc_id and one of SALTS salts of the text, so that one id with very many rows fills no block; the target's ids go
to all their salts. Rows without an id are dealt by their text and are never of the target.

Null and empty texts have no words: losses and score are null. Long texts are held whole in their block. Repeated rows count each
time. Without any target document all counts of the target are 0, and its model is uniform. An empty table gives no rows. Only doc_id
and text are read, so names of other columns cannot clash; doc_id is read as a long, so a text that is no number raises.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import blocks as X
from tidewatch.llm.shared import WordHash, mixed

K = 2.0
SALTS = 16
#: Bytes of text in a block; smaller than for other operators, as words and pairs are held at once.
BLOCK_BYTES = 6 << 20
#: Keys have 56 bits; among 10 ** 12 keys one in 100,000 meets another, which shifts its count by the other's.
LOW = np.uint64(8)
WORD, PAIR = ~np.uint64(0x1FF), np.uint64(0x100)
START = np.uint64(0x5851F42D4C957F2D)
RESULT = "doc_id long, n_words long, target_loss double, background_loss double, score double"


def sent_body(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted keys as differences in as few bytes as the largest needs, and the deflated counts."""
    steps = np.diff(keys >> LOW, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + zlib.compress(b"".join(c.astype(np.uint32).tobytes() for c in counts), 1)


def sent_parts(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and the two counts of a body."""
    width = body[0]
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :width] = np.frombuffer(body, dtype=np.uint8, count=n * width, offset=1).reshape(n, width)
    counts = np.frombuffer(zlib.decompress(body[1 + n * width :]), dtype=np.uint32)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) << LOW, counts[:n], counts[n:]


class Block:
    """Distinct words and pairs of a block's documents with their counts; one bit tells words from pairs."""

    def __init__(self, table: pa.Table, labels: pa.Table):
        cache = WordHash()
        self.ids = table.column("doc_id").to_pylist()
        hashes = [mixed(cache.of((t or b"").split())) for t in table.column("text").cast(pa.binary()).to_pylist()]
        self.sizes = np.array([len(h) for h in hashes], dtype=np.int64)
        words = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        self.n = len(words)
        self.firsts = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        before = np.concatenate([[START], words[:-1]]).astype(np.uint64) if self.n else words
        before[self.firsts] = START
        pairs = mixed(before * np.uint64(0x9E3779B97F4A7C15) + words) & WORD | PAIR
        marks = np.full(len(self.firsts), START & WORD, dtype=np.uint64)
        self.keys, self.place = np.unique(np.concatenate([words & WORD, pairs, marks]), return_inverse=True)
        chosen = set(labels.column("target_id").to_pylist())
        good = np.array([i in chosen for i in self.ids], dtype=bool)
        by_word = np.repeat(good, self.sizes)
        self.all = np.bincount(self.place, minlength=len(self.keys)).astype(np.uint32)
        self.good = np.bincount(self.place[np.concatenate([by_word, by_word, good[self.sizes > 0]])], minlength=len(self.keys)).astype(np.uint32)

    def losses(self, counts: np.ndarray, words: int, vocabulary: int) -> np.ndarray:
        """Each document's mean loss under the model with these counts of the block's keys."""
        c = counts.astype(np.float64)[self.place]
        word, pair, context = c[: self.n], c[self.n : 2 * self.n], np.empty(self.n)
        context[1:] = word[:-1]
        context[self.firsts] = c[2 * self.n :]
        p = (word + 1) / (words + vocabulary + 1)
        loss = -np.log((pair + K * p) / (context + K))
        return np.add.reduceat(loss, self.firsts) / self.sizes[self.sizes > 0] if self.n else loss


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score for each row of docs; target has the doc_id of target documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = X.blocks_for(docs, each=BLOCK_BYTES)
    salt = F.pmod(F.xxhash64("text"), F.lit(SALTS))
    placed = X.blocked(docs, ranges, "doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(salt)).groupBy("block")
    chosen = target.select(F.col("doc_id").cast("long").alias("target_id")).where("target_id is not null").distinct()
    salted = chosen.select("target_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    marks = X.blocked(salted, ranges, "target_id", "salt").select("target_id", "block").groupBy("block")

    def counted(key: tuple, table: pa.Table, labels: pa.Table) -> pa.Table:
        block = Block(table, labels)
        number = (table if table.num_rows else labels).column("block")[0].as_py()
        at = zip(*(x.tolist() for x in X.ranges_in(block.keys, ranges)), strict=True)
        return X.sent_table([(r, number, j - i, sent_body(block.keys[i:j], block.all[i:j], block.good[i:j])) for r, i, j in at])

    def summed(key: tuple, sent: pa.Table) -> pa.Table:
        blocks, counts, bodies = (sent.column(c).to_pylist() for c in ("block", "n", "body"))
        keys, every, good = map(np.concatenate, zip(*(sent_parts(b, n) for b, n in zip(bodies, counts, strict=True)), strict=True))
        del bodies
        distinct, place = np.unique(keys, return_inverse=True)
        sums = [np.bincount(place, weights=w, minlength=len(distinct)).astype(np.int64) for w in (every, good)]
        word = ((distinct & PAIR) == 0) & (distinct != (START & WORD))
        back, at = [], 0
        for n in counts:
            part = place[at : at + n]
            at += n
            back.append(zlib.compress(b"".join(s[part].tobytes() for s in sums), 1))
        rest = [0] * (len(counts) - 1)
        columns = {"block": pa.array(blocks, pa.int32()), "rng": pa.array([key[0].as_py()] * len(counts), pa.int32()), "body": pa.array(back, pa.binary())}
        for name, v in (("vocabulary", word.sum()), ("words", sums[0][word].sum()), ("good_words", sums[1][word].sum())):
            columns[name] = pa.array([int(v), *rest], pa.int64())
        return pa.table(columns)

    totals = ("vocabulary", "words", "good_words")
    sent = placed.cogroup(marks).applyInArrow(counted, X.SENT)
    got = sent.groupBy("rng").applyInArrow(summed, X.BACK + "".join(f", {c} long" for c in totals))
    # three numbers, as a scalar subquery: so all is one plan, in which Spark shuffles the texts once and uses that again
    whole = got.agg(F.struct(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals)).alias("t")).scalar()
    got = got.select("block", "rng", "body").withColumn("t", whole).select("block", "rng", "body", *(F.col(f"t.{c}").alias(c) for c in totals))

    def scored(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        block = Block(table, pa.table({"target_id": pa.array([], pa.int64())}))
        every, good = np.zeros(len(block.keys), dtype=np.int64), np.zeros(len(block.keys), dtype=np.int64)
        low, high = X.part_of(block.keys, back.column("rng").to_numpy(), ranges)
        for i, j, body in zip(low.tolist(), high.tolist(), back.column("body").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(body), dtype=np.int64)
            every[i:j], good[i:j] = part[: len(part) // 2], part[len(part) // 2 :]
        vocabulary, words, good_words = (back.column(c)[0].as_py() if len(back) else 0 for c in totals)
        full = block.sizes > 0
        losses = []
        for counts, total in ((good, good_words), (every, words)):
            loss = np.full(len(full), np.nan)
            loss[full] = block.losses(counts, total, vocabulary)
            losses.append(loss)
        none = ~full
        columns = [pa.array(block.ids, pa.int64()), pa.array(block.sizes), *(pa.array(v, mask=none) for v in (*losses, losses[1] - losses[0]))]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    return placed.cogroup(got.groupBy("block")).applyInArrow(scored, RESULT)
