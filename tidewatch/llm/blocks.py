"""Exchange of hash keys between blocks of documents.

Documents are dealt into blocks of about 16 MB of text. A block sends each of its distinct keys once, sorted and packed into one
binary value per range of keys; who works on a range sees a key at most once per block, so that no key is hot, however often it
occurs; and answers go back to the block in the order in which it sent its keys, without the keys. Blocks and ranges grow in number,
not in size, with the input.

A block packs only ranges that it has keys in, and finds these by its own keys: it never goes over all ranges. So it sends at most as
many values as it has keys, and both work and rows grow with the keys, not with blocks times ranges; while keys are many times the
ranges, a value holds many of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import partitions

BLOCK_BYTES = 16 << 20
SENT = "rng int, block int, n int, body binary"
BACK = "block int, rng int, body binary"


def blocks_for(df: DataFrame, text: str = "text", each: int = BLOCK_BYTES) -> int:
    """Blocks of about so many bytes of text, but at least as many as there are partitions."""
    return max(partitions(df.sparkSession), math.ceil((df.agg(F.sum(F.octet_length(text))).first()[0] or 0) / each))


def blocked(df: DataFrame, count: int, *keys: Column | str) -> DataFrame:
    """df with the column block, dealt by it; rows that agree in keys share a block."""
    return df.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")).repartition(count, "block")


def width_of(ranges: int) -> int:
    """The keys of a range; the last one may have fewer."""
    return (1 << 64) // ranges + 1


def ranges_in(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges that sorted keys fall into, and where each begins and ends among the keys."""
    of = (keys // np.uint64(width_of(ranges))).astype(np.int64) if ranges > 1 else np.zeros(len(keys), dtype=np.int64)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    return of[starts], starts, np.append(starts[1:], len(keys))[: len(starts)]


def part_of(keys: np.ndarray, rng: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the ranges rng begins and ends among sorted keys."""
    step = width_of(ranges)
    low = np.searchsorted(keys, np.array([r * step for r in rng.tolist()], dtype=np.uint64))
    high = np.array([len(keys) if (r + 1) * step >= 1 << 64 else np.searchsorted(keys, np.uint64((r + 1) * step)) for r in rng.tolist()], dtype=np.int64)
    return low, high


def pack(keys: np.ndarray, ranges: int, block: int, *more: np.ndarray) -> pa.Table:
    """Rows of SENT: of each range its keys and, behind them, what goes with them."""
    out = [(r, block, b - a, b"".join([keys[a:b].tobytes(), *(m[a:b].tobytes() for m in more)])) for r, a, b in zip(*(x.tolist() for x in ranges_in(keys, ranges)), strict=True)]
    return sent_table(out)


def sent_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=("rng", "block", "n", "body"))


def unpack(sent: pa.Table, *kinds: type) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Blocks in order, their counts, and their keys and what goes with them, put together."""
    sent = sent.sort_by("block")
    blocks, counts, bodies = (sent.column(c).to_pylist() for c in ("block", "n", "body"))
    parts: list[list[np.ndarray]] = [[] for _ in range(len(kinds) + 1)]
    for n, body in zip(counts, bodies, strict=True):
        at = 0
        for i, kind in enumerate((np.uint64, *kinds)):
            parts[i].append(np.frombuffer(body, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
    return blocks, counts, [np.concatenate(p) for p in parts]


def back(blocks: list[int], counts: list[int], rng: int, *answers: np.ndarray) -> pa.Table:
    """Rows of BACK: answers for each block's keys, in their order; booleans as bits."""
    bodies, at = [], 0
    for n in counts:
        bodies.append(b"".join(np.packbits(a[at : at + n]).tobytes() if a.dtype == bool else a[at : at + n].tobytes() for a in answers))
        at += n
    return pa.Table.from_arrays([pa.array(blocks, pa.int32()), pa.array([rng] * len(blocks), pa.int32()), pa.array(bodies, pa.binary())], names=["block", "rng", "body"])


def answers(got: pa.Table, keys: np.ndarray, ranges: int, *kinds: type) -> list[np.ndarray]:
    """What came back for sorted keys, in their order."""
    out = [np.zeros(len(keys), dtype=k) for k in kinds]
    low, high = part_of(keys, got.column("rng").to_numpy(), ranges)
    for a, b, body in zip(low.tolist(), high.tolist(), got.column("body").to_pylist(), strict=True):
        offset = 0
        for o, kind in zip(out, kinds, strict=True):
            if kind is bool:
                size = (b - a + 7) // 8
                o[a:b] = np.unpackbits(np.frombuffer(body, dtype=np.uint8, count=size, offset=offset), count=b - a).astype(bool)
            else:
                size = (b - a) * np.dtype(kind).itemsize
                o[a:b] = np.frombuffer(body, dtype=kind, count=b - a, offset=offset)
            offset += size
    return out
