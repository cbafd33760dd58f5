"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised bytewise: A-Z become lower case and every ASCII byte outside [0-9a-z] a space; bytes of other characters stay.
This keeps each byte's offset, so hits map back to the original text without a table. Words are what stands between spaces.

A window is `window` consecutive words of an item; an item with fewer words, but not none, is one window. Windows of an item overlap,
so the automaton does not hold them all: it holds an anchor of window - stride + 1 words at every stride-th word of an item (stride is
3 for ten words), and short items whole. Any window contains an anchor, and where the automaton meets one in a document, once over its
words with a space at both ends, the match is extended word by word to both sides; if it has reached a window's length, all its words
are hit, and the item occurs. So each word of a benchmark is held three times instead of ten.

The automaton of a benchmark of up to PART_BYTES is one. Of larger ones each part has its own, and a worker runs all of them over
CHUNK bytes of documents before it goes on: documents are read once, never written, and items are sent to workers up to SENT_BYTES at
a time; only beyond that are documents scanned again. None of these numbers changes the result.

Null and empty texts have no words and no hits, very long ones are scanned to their end; an item with no words never occurs; repeated
item texts all count; a null item_id is an item like any other, whose windows hit: all rows with it count as one item in n_items and add
nothing to items_sha256, the digest of the sorted ids that are not null; rows of documents are judged one by one, so repeated rows and
empty tables need no care. On a clash of names the columns made here win; a column called _own, _on or _items is kept.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.shared import batches_by_bytes, packed, wider, written

#: Bytes of benchmark text in one automaton (some 200 MB of memory), and in one scan of the documents.
PART_BYTES, SENT_BYTES = 2 << 20, 128 << 20
#: Bytes of documents over which a worker runs one automaton before the next.
CHUNK = 32 << 20
#: Bytes outside [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] become spaces.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MADE = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"
NAMES = tuple("n_words n_hit n_items items_sha256 contaminated spans".split())
Items = list[tuple[str | None, bytes]]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def in_order(items: set[str | None]) -> list[str | None]:
    """Null comes last."""
    return sorted(items, key=lambda item: (item is None, item or ""))


def windows_of(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


class Part:
    """The automaton of some items: its values are the anchor's words and its places as (item, first word)."""

    def __init__(self, items: Items, window: int):
        self.window = window
        stride = max(1, (window + 2) // 4)
        size = window - stride + 1
        self.names, self.words = [name for name, _ in items], [words_of(text) for _, text in items]
        places: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        for i, words in enumerate(self.words):
            if 0 < len(words) < window:
                places.setdefault(tuple(words), []).append((i, 0))
            else:
                for at in range(0, len(words) - size + 1, stride):
                    places.setdefault(tuple(words[at : at + size]), []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for anchor, of in places.items():
            self.automaton.add_word((b" " + b" ".join(anchor) + b" ").decode("latin-1"), (len(anchor), of))
        self.automaton.make_automaton()

    def hits(self, words: list[bytes], on: np.ndarray, items: set[str | None]) -> None:
        """Marks the words that are hit, and adds the items that occur."""
        if not words or not len(self.automaton):
            return
        found = list(self.automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")))
        if not found:
            return
        ends = np.cumsum([len(w) + 1 for w in words])
        last = np.searchsorted(ends, [end for end, _ in found])
        done: dict[tuple[int, int], int] = {}  # by item and shift, the word up to which the match has been extended
        for end, (_, (size, places)) in zip((last + 1).tolist(), found, strict=True):
            for item, at in places:
                own = self.words[item]
                if done.get((item, end - size - at), 0) >= end:
                    continue
                start, stop, i, j = end - size, end, at, at + size
                while start and i and words[start - 1] == own[i - 1]:
                    start, i = start - 1, i - 1
                while stop < len(words) and j < len(own) and words[stop] == own[j]:
                    stop, j = stop + 1, j + 1
                done[item, end - size - at] = stop
                if stop - start >= min(self.window, len(own)):
                    on[start:stop] = True
                    items.add(self.names[item])


#: Bytes of benchmark text whose automata a worker holds at once (some 100 bytes of memory for each).
HELD_BYTES = 6 << 20
_parts: dict[str, Part] = {}


def part_of(name: str, items: Items, window: int) -> Part:
    """Built once in each worker while all that it has to hold fit; beyond that those of other scans go, then the longest unused."""
    if name in _parts:
        _parts[name] = _parts.pop(name)  # the last used one comes last
        return _parts[name]
    size = lambda part: sum(len(w) + 1 for words in part.words for w in words)
    made = Part(items, window)
    scan = name.rpartition("-")[0]
    for other in sorted(_parts, key=lambda n: n.rpartition("-")[0] == scan):
        if size(made) + sum(map(size, _parts.values())) > HELD_BYTES or other.rpartition("-")[0] != scan:
            del _parts[other]
    _parts[name] = made
    return made


def spans(text: bytes, on: np.ndarray) -> list[dict]:
    """Byte ranges of the original text that hold runs of hit words."""
    if not on.any():
        return []
    at = np.frombuffer(b" " + text.translate(NORMAL) + b" ", dtype=np.uint8) != 32
    edges = np.flatnonzero(at[1:] != at[:-1])
    starts, ends = edges[::2], edges[1::2]
    change = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(change[::2], change[1::2], strict=True)]


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple[pa.RecordBatch, list[bytes]]]]:
    """Parts of batches with their texts, put together up to so many bytes; each by itself for 0."""
    held, size = [], 0
    for batch, texts in batches_by_bytes(batches):
        held.append((batch, texts))
        size += sum(map(len, texts))
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def scanned(docs: DataFrame, parts: list[Items], window: int, again: bool, last: bool) -> DataFrame:
    """docs (own, text) with _on (bits of words that are hit) and _items; what an earlier scan has found is added to. The last scan gives MADE instead, in the same pass, so that a task has one worker and the texts lie in its buffers once."""
    name = uuid.uuid4().hex

    def run(batches):
        for chunk in chunks(batches, CHUNK if len(parts) > 1 else 0):
            marks, found = [], []
            for batch, texts in chunk:
                old = batch.column("_on").to_pylist() if again else [None] * len(texts)
                had = batch.column("_items").to_pylist() if again else [()] * len(texts)
                for text, bits, items in zip(texts, old, had, strict=True):
                    n = len(words_of(text))
                    marks.append(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=n).astype(bool) if bits else np.zeros(n, dtype=bool))
                    found.append(set(items))
            for k, items in enumerate(parts):
                part, at = part_of(f"{name}-{k}", items, window), 0
                for _, texts in chunk:
                    for text in texts:
                        part.hits(words_of(text), marks[at], found[at])
                        at += 1
            at = 0
            for batch, texts in chunk:
                on = [np.packbits(m).tobytes() if m.any() else None for m in marks[at : at + len(texts)]]
                of = [in_order(f) for f in found[at : at + len(texts)]]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("text"), pa.array(on, pa.binary()), pa.array(of, pa.list_(pa.string()))], names=["own", "text", "_on", "_items"])

    if last:
        return docs.mapInArrow(lambda batches: result(run(batches)), wider(T.StructType([docs.schema["own"], docs.schema["text"]]), MADE))
    return docs.mapInArrow(run, docs.schema if again else wider(docs.schema, "_on binary, _items array<string>"))


def result(batches):
    for batch, texts in batches_by_bytes(batches):
        n, hit, count, digest, where = [], [], [], [], []
        for text, bits, of in zip(texts, batch.column("_on").to_pylist(), batch.column("_items").to_pylist(), strict=True):
            words = len(words_of(text))
            on = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=words).astype(bool) if bits else np.zeros(words, dtype=bool)
            n.append(words)
            hit.append(int(on.sum()))
            count.append(len(of))
            digest.append(hashlib.sha256(",".join(item for item in of if item is not None).encode()).hexdigest())
            where.append(spans(text, on))
        arrays = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest), pa.array([h > 0 for h in hit]), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("text"), *arrays], names=["own", "text", *NAMES])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and spans (byte ranges of hit words). No shuffle."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scans = max(1, math.ceil(size / SENT_BYTES))
    each = max(1, math.ceil(size / scans / PART_BYTES))
    items = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(scans * each)))
    out = docs.select(packed(docs, "text", *NAMES).alias("own"), F.col("text").cast("string").alias("text"))
    for k in range(scans):
        parts: list[Items] = [[] for _ in range(each)]
        for r in items.where(F.col("part") % scans == k).collect():  # SENT_BYTES on average
            parts[r.part // scans].append((r.item, r.text.encode()))
        out = scanned(out, parts, window, k > 0, k == scans - 1)
        if k < scans - 1:
            out = written(out, "decontamination")
    return out.select(*(F.col("text") if c.lower() == "text" else F.col("own").getField(c).alias(c) for c in docs.columns if c.lower() not in NAMES), *NAMES)
