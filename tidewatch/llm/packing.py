"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document's ids (its text's, then the end id) fill one piece; a document of more than `size` ids is cut into pieces of `size`, of which
the first may be shorter. Pieces of one length are interchangeable, so a packing is held as kinds of sequences (how many pieces of which
lengths) with the number of sequences of each kind: the search depends on the histogram of lengths, which has at most `size` entries
whatever the size of the corpus, and no document takes part in it.

Grouping genetic algorithm: a crossover injects whole well-filled sequences of one parent into the other, takes out those of its sequences
whose pieces have become duplicates (what the histogram does not hold any more), and puts the displaced pieces, longest first, where they
fit best. Mutations dissolve sequences, the badly filled ones first. Islands are Spark tasks, each with a population of its own; after
each round the elite of an island migrates to the next one. A round is written before the next one begins, so a lost executor repeats
its island only; all seeds are fixed, so reruns agree. The search ends early when a packing meets the lower bound or a round of all islands
finds none better.

Pieces then get ranks among those of their length, from row numbers in SALTS salts and sums over the salts before, and a rank has its
place in the best packing: nothing is sorted by sequence, and a length with a third of all pieces is dealt to SALTS groups.

Ids are those of `tokenizer` (a file of the library tokenizers) without special tokens added. Given `ranks` (the same vocabulary as a
file of the library tiktoken), texts of plain Latin letters and punctuation, on which both libraries agree, go by it, four times as
fast; all others, and those that hold a special token's string, go by the tokenizer.

Null and empty texts have the end id only. Very long texts are cut like others; at no time is more than one batch of texts in ids.
Repeated rows, rows without an id and equal texts are documents of their own. An empty table gives no rows. Only doc_id and text are
read, so names of other columns cannot clash; doc_id is read as a long, so a text that is no number raises.
"""

from __future__ import annotations

import base64
import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import batches_by_bytes, written

SALTS = 1024
PIECES = "doc_id long, row long, piece int, start long, length int, ids_crc32 long"
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Islands, packings on each, children of a round, rounds, and packings that migrate.
ISLANDS, POPULATION, CHILDREN, ROUNDS, ELITE = 6, 6, 24, 3, 2
#: Signs whose classes (letter, number, white space) are old and the same in all libraries: others go by the tokenizer itself.
UNUSUAL = re.compile("[^\t\n\r -~¡-¬®-ɏ]")

#: Lengths and how many pieces of each, the longest first.
Kind = tuple[tuple[int, int], ...]
#: How many sequences there are of each kind.
Packing = dict[Kind, int]


class Ids:
    """The ids of texts by the tokenizer in a file, and by the same vocabulary in another where both agree."""

    def __init__(self, tokenizer: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(tokenizer), None
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def of(self, text: str) -> list[int]:
        if self.fast and not UNUSUAL.search(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def cuts(n: int, size: int) -> list[int]:
    """Where the pieces of a document of n ids begin, and n."""
    first = n % size or min(n, size)
    return [0, *range(first, n + 1, size)]


def pieces_of(docs: DataFrame, tokenizer: str, ranks: str | None, end_id: int, size: int) -> DataFrame:
    """Every piece of every document as a row of PIECES; row is a number of its own for each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, row = Ids(tokenizer, ranks), TaskContext.get().partitionId() << 36
        for part, texts in batches_by_bytes(pa_batch for pa_batch in batches if pa_batch.num_rows):
            out: list[tuple] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                own = np.array([*ids.of(text.decode("utf-8", "replace")), end_id], dtype="<u4")
                at = cuts(len(own), size)
                out += [(doc_id, row, p, a, b - a, zlib.crc32(own[a:b].tobytes())) for p, (a, b) in enumerate(zip(at, at[1:]))]
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, PIECES)


def best_fit(rest: dict[int, int], open_: Packing, size: int) -> Packing:
    """open_ with the pieces of rest, the longest first, each in the fullest sequence that it fits into, else in a new one."""
    done: Packing = {}
    free: list[list[tuple[Kind, int]]] = [[] for _ in range(size + 1)]
    mask = 0

    def put(kind: Kind, n: int, room: int) -> None:
        nonlocal mask
        if room:
            free[room].append((kind, n))
            mask |= 1 << room
        else:
            done[kind] = done.get(kind, 0) + n

    for kind, n in open_.items():
        put(kind, n, size - filled(kind))
    for length in sorted((x for x, n in rest.items() if n), reverse=True):
        left = rest[length]
        while left:
            fits = mask >> length
            if not fits:
                each = size // length
                whole, more = divmod(left, each)
                if whole:
                    put(((length, each),), whole, size - each * length)
                if more:
                    put(((length, more),), 1, size - more * length)
                break
            room = length + (fits & -fits).bit_length() - 1
            kind, n = free[room].pop()
            each = min(room // length, left)
            take = min(n, left // each)
            if take < n:
                free[room].append((kind, n - take))
            elif not free[room]:
                mask ^= 1 << room
            put((*kind, (length, each)), take, room - each * length)
            left -= take * each
    for kinds in free:
        for kind, n in kinds:
            done[kind] = done.get(kind, 0) + n
    return tidy(done)


def filled(kind: Kind) -> int:
    return sum(length * k for length, k in kind)


def tidy(packing: Packing) -> Packing:
    """Kinds in one form: each length once, the longest first."""
    out: Packing = {}
    for kind, n in packing.items():
        by: dict[int, int] = {}
        for length, k in kind:
            by[length] = by.get(length, 0) + k
        form = tuple(sorted(by.items(), reverse=True))
        out[form] = out.get(form, 0) + n
    return out


def worth(packing: Packing) -> tuple[int, int]:
    """The number of sequences, then minus the sum of their squared fills: of two packings the smaller is better."""
    return sum(packing.values()), -sum(filled(kind) ** 2 * n for kind, n in packing.items())


def lower_bound(histogram: dict[int, int], size: int) -> int:
    """No packing has fewer sequences: by the sum of lengths, and, for each t, with the pieces over size - t alone and those under t left out."""
    best = -(-sum(length * n for length, n in histogram.items()) // size)
    for t in range(1, size // 2 + 1):
        alone = sum(n for length, n in histogram.items() if length > size - t)
        halves = sum(n for length, n in histogram.items() if size / 2 < length <= size - t)
        room = halves * size - sum(length * n for length, n in histogram.items() if size / 2 < length <= size - t)
        small = sum(length * n for length, n in histogram.items() if t <= length <= size / 2)
        best = max(best, alone + halves + max(0, -(-(small - room) // size)))
    return best


def crossover(mother: Packing, father: Packing, histogram: dict[int, int], size: int, r: random.Random) -> Packing:
    """Well-filled sequences of father go whole into mother; of mother those stay whose pieces are still there; all else is best-fitted."""
    rest, child = dict(histogram), {}

    def inherit(kind: Kind, most: int) -> None:
        n = min(most, *(rest[length] // k for length, k in kind))
        if n > 0:
            child[kind] = child.get(kind, 0) + n
            for length, k in kind:
                rest[length] -= n * k

    fills = sorted(father, key=filled, reverse=True)
    least = filled(fills[len(fills) // 2])
    for kind in fills:
        if filled(kind) >= least and r.random() < 0.5:
            inherit(kind, father[kind] if r.random() < 0.8 else r.randint(1, father[kind]))
    for kind in sorted(mother, key=lambda k: (-filled(k), r.random())):
        inherit(kind, mother[kind])
    return best_fit(rest, child, size)


def mutated(packing: Packing, size: int, r: random.Random) -> Packing:
    """The badly filled kinds and a few others are dissolved and their pieces best-fitted again."""
    rest: dict[int, int] = {}
    kept: Packing = {}
    share = r.choice((0.05, 0.1, 0.3))
    for kind, n in packing.items():
        out = n if filled(kind) < size and r.random() < 0.7 else r.randint(1, n) if r.random() < share else 0
        if n > out:
            kept[kind] = n - out
        for length, k in kind if out else ():
            rest[length] = rest.get(length, 0) + out * k
    if r.random() < 0.5:  # some lengths first, so that other sequences come about than by length alone
        some = {length: n for length, n in rest.items() if r.random() < 0.5}
        kept = best_fit(some, kept, size)
        rest = {length: n for length, n in rest.items() if length not in some}
    return best_fit(rest, kept, size)


def evolved(people: list[Packing], histogram: dict[int, int], size: int, seed: int, bound: int) -> list[Packing]:
    """A round on one island: children by tournament, the best POPULATION packings stay."""
    r = random.Random(seed)
    ranked = sorted(((worth(p), p) for p in people or [best_fit(histogram, {}, size)]), key=lambda x: x[0])

    def add(packing: Packing) -> None:
        own = worth(packing), packing
        if all(own[0] != other[0] or packing != other[1] for other in ranked):
            ranked.append(own)
            ranked.sort(key=lambda x: x[0])

    for _ in range(POPULATION - len(ranked)):
        if ranked[0][0][0] > bound:
            add(mutated(ranked[0][1], size, r))
    for _ in range(CHILDREN):
        if ranked[0][0][0] <= bound:
            break
        mother, father = (min(r.choices(range(len(ranked)), k=2)) for _ in range(2))
        child = crossover(ranked[mother][1], ranked[father][1], histogram, size, r)
        add(mutated(child, size, r) if mother == father or r.random() < 0.3 else child)
        del ranked[POPULATION:]
    return [p for _, p in ranked]


def search(spark: SparkSession, histogram: dict[int, int], size: int) -> Packing:
    """The best packing of all islands."""
    bound = lower_bound(histogram, size)
    people, last, best = None, None, None
    for turn in range(ROUNDS):

        def one(island: int, genomes: list[str], turn: int = turn) -> Iterator[tuple[int, str, int, int]]:
            known = [{tuple(map(tuple, kind)): n for kind, n in json.loads(g)} for g in genomes]
            for place, p in enumerate(evolved(known, histogram, size, ISLANDS * turn + island, bound)):
                genome = json.dumps(list(p.items()))
                for to in {island, (island + 1) % ISLANDS} if place < ELITE else {island}:
                    yield to, genome, *worth(p)

        def grown(key: tuple, table: pa.Table) -> pa.Table:
            columns = list(zip(*one(key[0].as_py(), sorted({g for g in table.column("genome").to_pylist() if g})), strict=True))
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("island", "genome", "sequences", "fill"), columns, (pa.int64(), pa.string(), pa.int64(), pa.decimal128(38)), strict=True)})

        before = people or spark.range(ISLANDS).select(F.col("id").alias("island"), F.lit(None).cast("string").alias("genome"))
        people = written(before.repartitionByRange(ISLANDS, "island").groupBy("island").applyInArrow(grown, "island long, genome string, sequences long, fill decimal(38,0)"), "islands")
        last, best = best, people.orderBy("sequences", "fill", "genome").first()
        if best.sequences <= bound or last and last.genome == best.genome:
            break
    return {tuple(map(tuple, kind)): n for kind, n in json.loads(best.genome)}


def places(packing: Packing) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, ranges of ranks as (first rank, pieces in a sequence, first sequence, offset); a range ends where the next begins."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for kind, n in sorted(packing.items(), reverse=True):
        offset = 0
        for length, k in kind:
            out.setdefault(length, []).append((used.get(length, 0), k, sequence, offset))
            used[length] = used.get(length, 0) + n * k
            offset += length * k
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, end_id: int = 2, size: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece of each row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(pieces_of(docs, tokenizer, ranks, end_id, size), "pieces").withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(SALTS)).cast("int"))
    bins = written(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")  # size * SALTS rows at most
    histogram = {r["length"]: r.n for r in bins.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    at = places(search(spark, histogram, size)) if histogram else {}

    salts = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = bins.select("length", "salt", F.coalesce(F.sum("n").over(salts), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("row", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = {length: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for length, rows in at.items()}
        for batch in batches:
            lengths, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            sequence, offset = np.zeros((2, len(lengths)), dtype=np.int64)
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                first, each, base, begin = ranges[length]
                r = np.searchsorted(first, rank[mine], side="right") - 1
                copy, slot = np.divmod(rank[mine] - first[r], each[r])
                sequence[mine], offset[mine] = base[r] + copy, begin[r] + slot * length
            own = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lengths), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(placed, RESULT)
