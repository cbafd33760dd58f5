"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with temperature.

1. Tokens are runs of letters and digits, and runs of other signs. Each has a random sparse index vector of DIM places with SIGNS
   signs, drawn by its hash. A token's context vector is the sum of the index vectors of all tokens within REACH places of it, over all
   documents. Sums are kept in TABLES tables of BUCKETS rows, into which tokens fall by different bits of their hash; a token's vector
   is the mean of its rows, so tokens that share a row in one table still have vectors of their own, while what tasks send has a fixed
   size, whatever the vocabulary: each task adds up its documents and sends one row per bucket, which Spark adds up.
2. Rows are centred and scaled to length 1. A document's features are the mean and deviation of its tokens' vectors, the mean product
   of neighbouring tokens' vectors (which tells repetition), and the logarithm of its length. They are written once.
3. A network with one hidden layer of HIDDEN units (numpy, Adam, fixed seed) learns quality = 1 from labelled rows that are not held
   out: a bounded sample of SAMPLE rows in order of crc32(doc_id). A fifth of these only sets the stopping point and the temperature
   by which logits are divided, so that probabilities are calibrated.

Of several rows under one labelled id the one with the least features (as bytes) is learned from, so the dealing of rows does not matter.
Null and empty texts have features 0 and get the network's answer to these; long ones are read to the end. Without labels of both
classes the score is the share of quality 1, or 0.5 where there are no labels at all. Rows are scored one by one, repeated ones alike;
an empty table gives no rows. Only doc_id and text are read, so names of other columns cannot clash; doc_id is read as a long, so a
text that is no number raises.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import WordHash, batches_by_bytes, fold, mixed, wider, written

BUCKETS, TABLES, DIM, SIGNS, REACH, HIDDEN = 8192, 2, 32, 4, 2, 32
#: Labelled rows that the network learns from at most.
SAMPLE = 20_000
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
SIZE = 3 * DIM + 1


def tokens_of(texts: list[bytes], cache: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the different tokens, for each token its place among them, and each text's number of tokens."""
    tokens = [TOKEN.findall(t) for t in texts]
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    flat = list(itertools.chain.from_iterable(tokens))
    place = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    return mixed(cache.of(list(place))), np.fromiter(map(place.__getitem__, flat), dtype=np.int64, count=len(flat)), sizes


def rows_of(hashes: np.ndarray, table: int, buckets: int) -> np.ndarray:
    """The tokens' rows in a table."""
    return (mixed(hashes + np.uint64(table + 1)) % np.uint64(buckets)).astype(np.int64)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Each token's index vector: SIGNS entries of +1 or -1 by bits of its hash."""
    out = np.zeros((len(hashes), DIM), dtype=np.int8)
    flat, at = out.reshape(-1), np.arange(len(hashes)) * DIM
    for k in range(SIGNS):
        place = at + (hashes >> np.uint64(8 * k) & np.uint64(DIM - 1)).astype(np.int64)
        flat[place] += np.where(hashes >> np.uint64(8 * k + 7) & np.uint64(1), 1, -1).astype(np.int8)
    return out


def around(hashes: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each different token the sum of the index vectors of the tokens within REACH places of any of its own, these left out."""
    at = np.arange(len(place)) + np.repeat(np.arange(1, len(sizes) + 1) * REACH, sizes)  # REACH empty rows between documents
    index = np.zeros((len(place) + (len(sizes) + 1) * REACH, DIM), dtype=np.int8)
    index[at] = index_vectors(hashes)[place]
    total = np.zeros_like(index)
    for step in range(1, REACH + 1):
        total[step:] += index[:-step]
        total[:-step] += index[step:]
    order = np.argsort(place.astype(np.uint16) if len(hashes) <= 1 << 16 else place, kind="stable")
    starts = np.flatnonzero(np.diff(place[order], prepend=-1))
    return np.add.reduceat(total[at[order]], starts, axis=0, dtype=np.int32)


def context_vectors(docs: DataFrame, buckets: int) -> np.ndarray:
    """TABLES tables of centred context vectors of length 1; one row per bucket and task is shuffled."""

    def neighbours(batches):
        cache, seen = WordHash(), np.zeros((TABLES, buckets, DIM), dtype=np.int64)
        for _, texts in batches_by_bytes(batches):
            hashes, place, sizes = tokens_of(texts, cache)
            if len(place):
                total = around(hashes, place, sizes)
                for t in range(TABLES):
                    row = rows_of(hashes, t, buckets)
                    order = np.argsort(row)
                    starts = np.flatnonzero(np.diff(row[order], prepend=-1))
                    seen[t, row[order][starts]] += np.add.reduceat(total[order], starts, axis=0)
        flat = seen.reshape(TABLES * buckets, DIM)
        on = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), *(pa.array(flat[on, d]) for d in range(DIM))], names=["bucket", *(f"v{d}" for d in range(DIM))])

    columns = [f"v{d}" for d in range(DIM)]
    rows = docs.select("text").mapInArrow(neighbours, "bucket int, " + ", ".join(f"{c} long" for c in columns))
    got = rows.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()  # TABLES * BUCKETS rows at most
    out = np.zeros((TABLES * buckets, DIM))
    out[got.bucket.to_numpy(dtype=np.int64)] = got[columns].to_numpy(dtype=np.float64)
    return np.stack([centred(t) for t in out.reshape(TABLES, buckets, DIM)]).astype(np.float32)


def centred(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, less their mean, of length 1 again; rows of zeros stay."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    out = np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
    if (size > 0).any():
        out = np.where(size > 0, out - out[size[:, 0] > 0].mean(axis=0), 0)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def pooled(hashes: np.ndarray, place: np.ndarray, sizes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of documents from their tokens."""
    out = np.zeros((len(sizes), SIZE), dtype=np.float32)
    full = np.flatnonzero(sizes > 0)
    if not len(full):
        return out
    v = (sum(vectors[t][rows_of(hashes, t, vectors.shape[1])] for t in range(TABLES)) / np.float32(TABLES))[place]
    starts, n = (np.cumsum(sizes) - sizes)[full], sizes[full][:, None].astype(np.float32)
    mean = np.add.reduceat(v, starts) / n
    square = np.add.reduceat(v * v, starts) / n
    near = np.zeros_like(v)
    near[1:] = v[1:] * v[:-1]
    near[starts] = 0
    out[full] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.add.reduceat(near, starts) / n, np.log1p(n)])
    return out


class Network:
    """Two layers: tanh units, then one logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray, seed: int = 7, epochs: int = 200):
        r = np.random.default_rng(seed)
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.shift) / self.scale
        w = [r.normal(0, 1 / np.sqrt(SIZE), (SIZE, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        fit = np.flatnonzero(~apart)
        best, self.w, t = np.inf, w, 0
        for _ in range(epochs):
            for at in np.array_split(r.permutation(fit), max(1, len(fit) // 256)):
                h = np.tanh(z[at] @ w[0] + w[1])
                g = (1 / (1 + np.exp(-(h @ w[2] + w[3][0]))) - y[at]) / len(at)
                back = np.outer(g, w[2]) * (1 - h * h)
                grads = [z[at].T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ g + 1e-4 * w[2], np.array([g.sum()])]
                t += 1
                for p, m, s, d in zip(w, first, second, grads, strict=True):
                    m += 0.1 * (d - m)
                    s += 0.001 * (d * d - s)
                    p -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
            loss = self.loss(self.logits(x[apart], w), y[apart]) if apart.any() else self.loss(self.logits(x[fit], w), y[fit])
            if loss < best - 1e-4:
                best, since, self.w = loss, 0, [p.copy() for p in w]
            else:
                since += 1
                if since >= 20:
                    break
        held = apart if apart.any() else ~apart
        logits = self.logits(x[held])
        grid = np.geomspace(0.25, 8, 81)
        self.temperature = float(grid[np.argmin([self.loss(logits / k, y[held]) for k in grid])])

    @staticmethod
    def loss(logits: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, logits) - y * logits))

    def logits(self, x: np.ndarray, w: list | None = None) -> np.ndarray:
        w = w or self.w
        return np.tanh((x - self.shift) / self.scale @ w[0] + w[1]) @ w[2] + w[3][0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs; texts are read twice and never shuffled."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = context_vectors(docs, buckets)

    def features(batches):
        cache = WordHash()
        for batch, texts in batches_by_bytes(batches):
            x = pooled(*tokens_of(texts, cache), vectors).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([row.tobytes() for row in x], pa.binary())], names=["doc_id", "x"])

    got = written(docs.mapInArrow(features, "doc_id long, x binary"), "quality-features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    one = got.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("quality").alias("quality"))
    rows = one.select("x", "quality", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").collect()  # sample rows at most
    x = np.array([np.frombuffer(r.x, dtype=np.float16) for r in rows], dtype=np.float64).reshape(-1, SIZE)
    y = np.array([r.quality for r in rows], dtype=np.float64)
    apart = np.array([r.h % 5 == 0 for r in rows], dtype=bool)
    network = Network(x, y, apart) if len(y) and y[~apart].min(initial=1) < y[~apart].max(initial=0) else None
    fallback = float(y.mean()) if len(y) else 0.5

    def scored(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.float16).reshape(-1, SIZE).astype(np.float64)
            p = network.probabilities(x) if network else np.full(len(x), fallback)
            kept = batch.drop_columns(["x"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*kept.schema.names, "score", "predicted"])

    held = got.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "x")
    return held.mapInArrow(scored, wider(held.drop("x").schema, "score double, predicted int"))
