"""N-gram Jaccard join by chosen paths.

Texts become sets of word shingles (five words; words as below NORMAL, A-Z lower-cased; a text of fewer words is one shingle; a text
without such words uses its runs of other characters). Two texts are linked if the Jaccard similarity of their sets is at least
`similarity`. Texts with equal sets are copies: they form one node with a number of rows, and everything below works on nodes.

1. Each set is sketched by T minima of hashes.
2. Chosen paths: in each of R runs, the node set is split recursively, first by one coordinate: run r takes coordinate r mod T, so no
   run is idle and no coordinate is taken twice before all are. Each further bucket picks each sketch coordinate with probability
   1 / (similarity * T), decided by a hash of its path, and sends a set to a child for each coordinate picked and its value there.
   Two sets over the threshold are expected to meet in at least one child each time, dissimilar ones seldom; so buckets shrink by the
   dissimilarity of their members, also where very many texts share a passage. Buckets of one set end; buckets up to LEAF sets are
   compared by brute force on their sketches. A larger bucket that a split has left with KEPT of its sets or more holds sets alike, which
   no split takes apart, and one that is still larger after DEPTH splits holds sets that share all coordinates of its path: all sets
   of either become candidates of one another, none is dropped.
3. Runs are repeated until the target recall: R is the least number for which a pair at the threshold that stays in large buckets
   through all DEPTH splits meets so often, counted over all ways in which its T coordinates may agree (runs share coordinates, so
   they are not independent).
4. Candidates are handed on as stars, never as pairs, and joined to candidate components (label propagation, checkpointed). Texts each
   somewhat below the threshold chain to components of any size. So where a component has over SMALL sets, the stars of its small
   buckets are verified exactly first, each with its centre and all its mates, and the component is put together anew from links and
   from large buckets alone; stars that large buckets hold together anyway are spared. So a chain without links is never compared as
   a whole. Every component is then verified exactly, all its sets against each other, so a pair that no run brought together is found as well if it
   is connected through others. Components over SMALL sets are dealt into blocks (at least eight from 8 * SMALL sets on, and none over
   GROUP sets or WIDE shingles) and verified by pairs of blocks, so that no task holds more than two blocks; intersections are counted
   by matrix products, and pairs are counted, not emitted. A text goes to as many tasks as its component has blocks.
5. Verified links give each node its number of links and, by another label propagation, its class.

Texts are joined to what is asked of them by the hash of a text. What is asked is marked in pages of bits first, which are broadcast, so
that only texts that may be among it are shuffled; the join behind it is exact.

Who only wants classes (one_of_each) need not count links: in a component of several blocks every set is compared with one
representative first, in one pass over the texts, and only those sets that it does not link are compared with all others. So ten
million near copies of one text cost ten million comparisons, and a class that hangs together through others only is found as well.

Rows: a null or empty text has no shingles, no links and a class of its own row's set (all such rows share one node but no link:
class_id is their own doc_id). Repeated rows are copies. A null doc_id may be in a class and is its class_id only if all are null.
Long texts are held whole. An empty table gives no rows. Only doc_id and text are read, so names of other columns cannot clash; doc_id
is read as a long, so a text that is no number raises.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import Scratch, WordHash, batches_by_bytes, groups, mixed, packed, partitions, shared_dir, unpacked, written

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.995
#: Sketch coordinates; largest bucket that is compared by brute force; number of splits.
T, LEAF, DEPTH = 64, 128, 5
#: The share of a bucket's sets in one child from which splitting ends.
KEPT = 0.7
#: A bucket is hot if it has at least one row in so many; so there are at most so many hot buckets.
HEAVY = 1000
#: Components up to so many sets are one block; no block has more sets than GROUP or, on average, more shingles than WIDE.
SMALL, GROUP, WIDE = 256, 2048, 1 << 21
#: Edges a task of a round of `components`.
EDGES = 50_000
#: Pages of PAGE bits each, in which hashes of texts are marked (2 MB as a whole).
PAGES, PAGE = 512, 32768
#: Sketches of pairs over the threshold agree at least so much, but for one pair in 100,000 (four deviations).
SLACK = 4.2
#: Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z became lower case.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shingles(text: bytes, cache: WordHash, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = text.translate(NORMAL).split() or text.split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = mixed(cache.of(words))
    k = min(size, len(h))
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x2545F4914F6CDD1D) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def sketch(shingle: np.ndarray) -> np.ndarray:
    """T minima of multiply-shift hashes, 32 bits of each."""
    odd = mixed(np.arange(1, T + 1, dtype=np.uint64)) | np.uint64(1)
    add = mixed(np.arange(1001, T + 1001, dtype=np.uint64))
    least = np.full(T, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingle), 256):
        part = shingle[a : a + 256, None] * odd[None, :] + add[None, :]
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def meeting_chance(agree: int, splits: int, similarity: float) -> float:
    """That two sets that agree in so many coordinates share a bucket after so many splits by hashed picks."""
    p = 1.0
    for _ in range(splits):
        p = 1 - (1 - p / (similarity * T)) ** agree
    return p


def recall_of(runs: int, similarity: float, splits: int) -> float:
    """That a pair at the threshold shares a bucket of some run after all splits and agrees enough for leaf_stars."""
    times, more = divmod(runs, T)  # the first `more` coordinates begin one run more than the others
    found = 0.0
    for i in range(more + 1):
        for j in range(T - more + 1):
            chance = comb(more, i) * comb(T - more, j) * similarity ** (i + j) * (1 - similarity) ** (T - i - j)
            if i + j >= least_agreement(similarity) * T:
                found += chance * (1 - (1 - meeting_chance(i + j, splits - 1, similarity)) ** (times * (i + j) + i))
    return found


def least_agreement(similarity: float) -> float:
    """The share of coordinates in which candidates agree."""
    return similarity - SLACK * (similarity * (1 - similarity) / T) ** 0.5


def runs_needed(recall: float, similarity: float = SIMILARITY, splits: int = DEPTH) -> int:
    return next(runs for runs in range(1, 64 * T) if recall_of(runs, similarity, splits) >= recall)


def first_children(sketches: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of the first split: run r takes coordinate r mod T."""
    run = np.arange(runs)
    path = mixed(mixed(run.astype(np.uint64) + np.uint64(1))[None, :] * np.uint64(0x9E3779B97F4A7C15) + sketches[:, run % T].astype(np.uint64))
    return np.repeat(np.arange(len(sketches)), runs), path.ravel()


def children(paths: np.ndarray, sketches: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of every child of each row: coordinates are picked by a hash of the path."""
    coordinate = mixed(np.arange(77, T + 77, dtype=np.uint64))
    dice = mixed(paths[:, None] ^ coordinate[None, :])
    row, at = np.nonzero(dice < np.uint64(int((1 << 64) / (similarity * T))))
    return row, mixed(dice[row, at] * np.uint64(0x9E3779B97F4A7C15) + sketches[row, at].astype(np.uint64))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, by repeated minima along the edges and pointer jumping."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = np.minimum(new, root)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    return root


def leaf_stars(bucket: pa.Table, least: float) -> pa.Table | None:
    """(member, root) for a small bucket, from comparing all its sketches."""
    s = np.frombuffer(b"".join(bucket.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, T)
    alike = np.array([(s == row).sum(axis=1) for row in s]) >= least * T
    a, b = np.nonzero(np.triu(alike, 1))
    if not len(a):
        return None
    root = roots(len(s), a, b)
    other = np.flatnonzero(root != np.arange(len(s)))
    sids = bucket.column("sid")
    return pa.table({"a": sids.take(pa.array(other)), "b": sids.take(pa.array(root[other]))})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): the least node of each component, by alternating stars.

    The large-star step links every node's larger neighbours to the least one, the small-star step its smaller ones; both keep
    components and shorten paths geometrically. Minima are combined before the shuffle, and both sides of each join are checkpointed,
    so that Spark can split the partition of a node with very many neighbours. A round has a task for each EDGES edges, and no more
    than partitions, so few edges do not leave files of empty partitions. Rounds end when the edges are stars.
    """
    shared_dir(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while True:
        parts = edges.count() // EDGES + 1
        edges = edges.coalesce(parts)
        twice = edges.groupBy("a").count().where("count > 1").select("a")
        # centres that have a centre themselves: distinct ones meet, so the star with very many members counts once
        inner = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select(F.col("b").alias("a"))
        if twice.unionByName(inner).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).withColumn("m", F.least("n", "m")).coalesce(parts).checkpoint()
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(parts).checkpoint()
        small = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).coalesce(parts).checkpoint()
        joined = large.join(small, F.col("a") == F.col("n")).select("a", "b", "m")
        stars = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        edges = stars.where("a <> b").distinct().coalesce(parts).checkpoint()


def exact_links(x: list[np.ndarray], y: list[np.ndarray] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) over the threshold: i < j within x, or i of x and j of y."""
    sets = x + (y or [])
    sizes = np.array([len(s) for s in sets], dtype=np.float32)
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    shared = times > 1  # others are in no intersection
    local = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], local[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    n = len(x)
    both = np.zeros((n, len(sets) if y is None else len(y)), dtype=np.float32)
    wide = 2048
    for start in range(0, int(shared.sum()), wide):
        a, b = np.searchsorted(place, [start, start + wide])
        m = np.zeros((len(sets), wide), dtype=np.float32)
        m[owner[a:b], place[a:b] - start] = 1
        both += m[:n] @ (m.T if y is None else m[n:].T)
    union = sizes[:n, None] + (sizes[None, :] if y is None else sizes[None, n:]) - both
    linked = both >= np.float32(similarity) * union - 1e-3
    # float32 holds these counts exactly below 2 ** 24; the ratio is decided in whole numbers
    i, j = np.nonzero(np.triu(linked, 1) if y is None else linked)
    exact = both[i, j].astype(np.float64) >= similarity * union[i, j].astype(np.float64) - 1e-9
    return i[exact], j[exact]


def verify(group: pa.Table, similarity: float, cache: WordHash) -> pa.Table:
    """Of a component's block or pair of blocks: each member's links (rows counted) and its local root."""
    group = group.take(pa.array(np.unique(np.array(group.column("sid").to_pylist(), dtype=object), return_index=True)[1]))  # rows that repeat all
    sids, rows = group.column("sid").to_pylist(), np.array(group.column("copies").to_pylist(), dtype=np.int64)
    block = np.array(group.column("own").to_pylist())
    sets = [shingles(t or b"", cache) for t in group.column("text").cast(pa.binary()).to_pylist()]
    first = np.flatnonzero(block == block.min())
    second = np.flatnonzero(block != block.min())
    pair = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
    if pair and not len(second):
        i = j = np.zeros(0, dtype=np.int64)
    elif pair:
        i, j = exact_links([sets[k] for k in first], [sets[k] for k in second], similarity)
        i, j = first[i], second[j]
    else:
        i, j = exact_links(sets, None, similarity)
    links = np.zeros(len(sids), dtype=np.int64)
    np.add.at(links, i, rows[j])
    np.add.at(links, j, rows[i])
    root = roots(len(sids), i, j)
    on = np.flatnonzero(links > 0)
    return pa.table({"sid": pa.array([sids[k] for k in on], pa.binary()), "links": pa.array(links[on]), "root": pa.array([sids[k] for k in root[on]], pa.binary())})


def linked_by(group: pa.Table, similarity: float, cache: WordHash) -> pa.Table | None:
    """Edges (sid, root) from rows marked `x` to all other rows of the group that they link; links are not counted."""
    sids, x = group.column("sid").to_pylist(), np.array(group.column("x").to_pylist(), dtype=bool)
    sets = [shingles(t or b"", cache) for t in group.column("text").cast(pa.binary()).to_pylist()]
    first, second = np.flatnonzero(x), np.flatnonzero(~x)
    if not len(first) or not len(second):
        return None
    i, j = exact_links([sets[k] for k in first], [sets[k] for k in second], similarity)
    pairs = [(sids[a], sids[b]) for a, b in zip(first[i].tolist(), second[j].tolist(), strict=True) if sids[a] != sids[b]]
    if not pairs:
        return None
    # a star for each row: its least partner; rows of x that share partners hang together through these
    names = sorted({s for p in pairs for s in p})
    place = {s: k for k, s in enumerate(names)}
    root = roots(len(names), np.array([place[a] for a, _ in pairs]), np.array([place[b] for _, b in pairs]))
    return pa.table({"sid": pa.array(names, pa.binary()), "links": pa.array([0] * len(names), pa.int64()), "root": pa.array([names[r] for r in root.tolist()], pa.binary())})


def by_group(df: DataFrame, keys: list[str], schema: str, make) -> DataFrame:
    """make() gives the work on the rows of each value of keys; one group is in memory at a time."""

    def run(batches):
        work = make()
        for group in groups(batches, keys):
            out = work(group)
            if out is not None and out.num_rows:
                yield from out.to_batches()

    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def text_hash(column: str = "text") -> "F.Column":
    """With doc_id, names a text: rows that agree in both have the same text but for a collision of 64 bits under one doc_id."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def marked(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """rows with `maybe`: false only where text_hash is not among hashes (one column, h), so that a join can leave such rows where they are.

    Pages of bits are broadcast. Their size is fixed: of many million hashes they tell less, so more rows are shuffled, but none is lost.
    """
    bit = lambda h: (F.pmod(F.shiftrightunsigned(h, PAGE.bit_length() - 1), F.lit(PAGES)).alias("page"), F.pmod(h, F.lit(PAGE)).alias("at"))
    pages = hashes.select(*bit(F.col("h"))).distinct().repartition("page").groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))
    page, at = bit(F.col("text_hash"))
    found = rows.select("*", page, at).join(F.broadcast(pages), "page", "left")
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    one = F.expr("shiftright(byte, CAST(at % 8 AS INT)) % 2 = 1")
    return found.withColumn("byte", byte).select(*rows.columns, F.coalesce(one, F.lit(False)).alias("maybe"))


def sketched(batches):
    cache = WordHash()
    for batch, texts in batches_by_bytes(batches):
        sids, sketches, sizes = [], [], []
        for text in texts:
            s = shingles(text, cache)
            sids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sketches.append(sketch(s).tobytes() if len(s) else None)
            sizes.append(len(s))
        arrays = [batch.column("doc_id"), batch.column("text_hash"), pa.array(sids, pa.binary()), pa.array(sketches, pa.binary()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "sid", "sketch", "size"])


def candidates(nodes: DataFrame, scratch: Scratch, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) of stars over the sids of nodes (sid, sketch), of small buckets and of large ones: steps 2 and 3."""
    runs = runs_needed(recall, similarity, DEPTH)
    least = least_agreement(similarity)

    def begin(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, child = first_children(np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, T), runs)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), part.column("sid").take(pa.array(row))], names=["path", "sid"])

    def split(batches):
        """Children of each set's paths, with the bucket's size; the sketch comes once for all of them."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, T)
                owner = np.repeat(np.arange(len(s)), np.array(part.column("paths").value_lengths().to_pylist(), dtype=np.int64))
                paths, sizes = part.column("paths").flatten(), part.column("sizes").flatten()
                paths = paths.to_numpy(zero_copy_only=False).view(np.uint64)
                for i in range(0, len(owner), 2048):
                    row, child = children(paths[i : i + 2048], s[owner[i : i + 2048]], similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), part.column("sid").take(pa.array(owner[i : i + 2048][row])), sizes.take(pa.array(i + row))], names=["path", "sid", "of"])

    def with_sizes(placed: DataFrame, depth: int) -> DataFrame:
        """Rows of buckets of two sets or more with the bucket's size, its parent's and, if it is large, its least set.

        Sizes are counted before the shuffle. Buckets with at least a thousandth of the rows, a thousand at most, are broadcast and
        their rows dealt by hash; so no task gets a whole hot bucket.
        """
        n, of = F.count("*"), F.max("of") if depth > 1 else F.lit(None).cast("long")
        sizes = placed.groupBy("path").agg(n.alias("size"), of.alias("of"), F.when(n > LEAF, F.min("sid")).alias("least")).where("size > 1")
        sizes = scratch.write(sizes, f"sizes-{depth}")
        total = placed.count()
        hot = sizes.where(F.col("size") * HEAVY >= total).select(F.col("path").alias("hot"), F.struct("size", "of", "least").alias("h"))
        found = placed.select("path", "sid").join(F.broadcast(hot), F.col("path") == F.col("hot"), "left").drop("hot")
        probe = F.when(F.col("h").isNull(), F.struct("path", F.lit(b"").alias("sid"))).otherwise(F.struct("path", "sid"))
        rest = sizes.select(F.struct("path", F.lit(b"").alias("sid")).alias("key"), F.struct("size", "of", "least").alias("s"))
        found = found.withColumn("probe", probe).join(rest, F.col("probe") == F.col("key"), "left").withColumn("s", F.coalesce("h", "s"))
        return found.where("s is not null").select("path", "sid", "s.*")

    none = scratch.write(nodes.limit(0).select(F.col("sid").alias("a"), F.col("sid").alias("b")), "alike-0")
    stars, large_stars = none, none
    state = nodes.select("sid", "sketch")
    for depth in range(1, DEPTH + 1):
        placed = scratch.write(state.mapInArrow(split if depth > 1 else begin, "path long, sid binary" + (", of long" if depth > 1 else "")), f"paths-{depth}")
        sized = scratch.write(with_sizes(placed, depth), f"sized-{depth}")
        scratch.drop(f"paths-{depth}", f"sizes-{depth}")
        leaves = sized.where(F.col("size") <= LEAF).select("path", "sid").join(nodes.select("sid", "sketch"), "sid")
        near = by_group(leaves, ["path"], "a binary, b binary", lambda: lambda bucket: leaf_stars(bucket, least)).distinct()
        stars = stars.unionByName(scratch.write(near, f"stars-{depth}"))
        large = sized.where(F.col("size") > LEAF)
        ended = F.coalesce(F.col("size") >= KEPT * F.col("of"), F.lit(False)) if depth < DEPTH else F.lit(True)
        if depth > 1:
            alike = large.where(ended).where("sid <> least").select(F.col("sid").alias("a"), F.col("least").alias("b")).distinct()
            large_stars = large_stars.unionByName(scratch.write(alike, f"alike-{depth}"))
            scratch.drop(f"sized-{depth - 1}")
        large = large.where(~ended)
        if large.isEmpty():
            break
        lists = large.groupBy("sid").agg(F.collect_list(F.struct("path", "size")).alias("p")).select("sid", F.col("p.path").alias("paths"), F.col("p.size").alias("sizes"))
        state = lists.join(nodes.select("sid", "sketch"), "sid").select("sid", "sketch", "paths", "sizes")
    return stars, large_stars


def with_roots(found: DataFrame) -> DataFrame:
    """(node, root) of components with the roots as nodes too."""
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def in_blocks(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """member (node, root) with the number of blocks of its group and its own block."""
    n = F.count("*")
    by_count = F.when(n <= SMALL, 1).otherwise(F.greatest(F.least(F.ceil(n / SMALL), F.lit(8)), F.ceil(n / GROUP)))
    sized = member.join(nodes.select(F.col("sid").alias("node"), "size"), "node")
    blocks = sized.groupBy("root").agg(F.greatest(by_count, F.ceil(F.sum("size") / WIDE)).cast("int").alias("blocks"))
    return member.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def confirmed(member: DataFrame, stars: DataFrame, large_stars: DataFrame, nodes: DataFrame, texts_of, scratch: Scratch, similarity: float) -> DataFrame:
    """member (node, root) where components over SMALL sets are put together anew, from verified links of small buckets and from large buckets.

    A star of small buckets holds all that met its centre there, so all pairs that met are among its pairs; it is verified unless
    large buckets hold all of it together.
    """
    over = member.groupBy("root").count().where(F.col("count") > SMALL).select("root")
    inside = scratch.write(member.join(over, "root", "left_semi"), "over")
    if inside.isEmpty():
        return member
    held = components(large_stars)
    near = stars.distinct().join(inside.select(F.col("node").alias("b")), "b", "left_semi")
    near = near.unionByName(near.select(F.col("b").alias("a"), "b").distinct())
    near = near.join(with_roots(held).select(F.col("node").alias("a"), F.col("root").alias("held")), "a", "left").withColumn("held", F.coalesce("held", "a"))
    near = scratch.write(near, "near")
    apart = near.groupBy("b").agg(F.min("held").alias("least"), F.max("held").alias("most")).where("least <> most")
    asked = scratch.write(in_blocks(near.join(apart, "b", "left_semi").select(F.col("a").alias("node"), F.col("b").alias("root")), nodes), "asked")
    links = links_of(asked, texts_of, scratch, similarity, True, "star-links")
    firm = components(large_stars.unionByName(links.select(F.col("sid").alias("a"), F.col("root").alias("b"))))
    anew = with_roots(firm).join(inside.select("node"), "node", "left_semi").select("node", "root")
    return member.join(over, "root", "left_anti").select("node", "root").unionByName(anew)


def dealt(texts: DataFrame) -> DataFrame:
    """Rows (root, lo, hi, own, sid, copies, text) for all pairs of blocks of each component, pairs of a block with itself included."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    each = texts.select("root", "own", "sid", "copies", "text", other)
    return each.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "sid", "copies", "text")


def links_of(member: DataFrame, texts_of, scratch: Scratch, similarity: float, count: bool, name: str = "links") -> DataFrame:
    """(sid, links, root), written under name: edges that connect each class, and with `count` each set's links.

    member has node, root, blocks and own for each set of a component; texts_of(member) adds sid, copies and text. Without `count`, a
    node has one root; with it, groups may overlap.
    """
    out = "sid binary, links long, root binary"

    def work(function):
        def make():
            cache = WordHash()
            return lambda group: function(group, similarity, cache)

        return make

    if count:
        return scratch.write(by_group(dealt(texts_of(member)), ["root", "lo", "hi"], out, work(verify)), name)
    # each text is fetched once and goes to its block, a representative to all blocks
    is_lead = (F.col("sid") == F.col("root")) & (F.col("blocks") > 1)
    to = F.explode(F.when(is_lead, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))).alias("lo")
    first = texts_of(member).select("root", to, "sid", "copies", "text", is_lead.alias("x"), "own")

    def near_lead(group: pa.Table, similarity: float, cache: WordHash) -> pa.Table | None:
        if any(group.column("x").to_pylist()):
            return linked_by(group, similarity, cache)
        return verify(group.append_column("hi", group.column("lo")), similarity, cache)

    first = scratch.write(by_group(first, ["root", "lo"], out, work(near_lead)), "near-lead")
    rest = member.where("blocks > 1 and node <> root").join(first.select(F.col("sid").alias("node")).distinct(), "node", "left_anti")
    rest = scratch.write(rest.select("node", "root"), "rest")
    if rest.isEmpty():
        return first
    per_root = rest.groupBy("root").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("rest_blocks"))
    again = member.join(per_root, "root").join(rest.select("node", F.lit(True).alias("is_rest")), "node", "left")
    own_rest = F.pmod(F.xxhash64("node"), F.col("rest_blocks")).cast("int")
    place = lambda lo, hi, x: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(x).alias("x"))
    every = F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda j: place(j, F.col("own"), False))
    asked = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: place(own_rest, i, True))
    at = F.when(F.col("is_rest"), F.concat(every, asked)).otherwise(every)
    again = texts_of(again.withColumn("at", at)).select("root", F.inline("at"), "sid", "text")
    return first.unionByName(scratch.write(by_group(again, ["root", "lo", "hi"], out, work(linked_by)), name))


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, count: bool = True) -> DataFrame:
    """For each row doc_id, text_hash, sid (digest of the shingle set), class_id (least doc_id of the class), class_sid, n_copies, n_links.

    n_links counts the other rows of docs that are linked to this one, copies included; without `count` it says no more than whether
    there are any.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("text_hash"))
    scratch = Scratch(docs.sparkSession, "near-join")
    rows = scratch.write(docs.mapInArrow(sketched, "doc_id long, text_hash long, sid binary, sketch binary, size long"), "sketches")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("head")
    nodes = rows.where("sid is not null").groupBy("sid").agg(head, F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.max("size").alias("size"))
    nodes = scratch.write(nodes, "nodes")
    def texts_of(member: DataFrame) -> DataFrame:
        """The text of each candidate once, from the first of its rows."""
        wanted = member.join(nodes.select("sid", "copies", F.col("head.doc_id").alias("w"), F.col("head.text_hash").alias("h")), F.col("node") == F.col("sid"))
        asked = marked(docs, wanted.select("h")).where("maybe").drop("maybe")
        return asked.join(wanted, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("w")))

    stars, large_stars = candidates(nodes, scratch, similarity, recall)
    member = scratch.write(with_roots(components(stars.unionByName(large_stars))), "members")
    member = confirmed(member, stars, large_stars, nodes, texts_of, scratch, similarity)
    member = scratch.write(in_blocks(member, nodes), "candidates")
    scratch.drop("over", "near", "asked", "star-links", *(f"{name}-{depth}" for name in ("sized", "stars", "alike") for depth in range(DEPTH + 1)))

    links = links_of(member, texts_of, scratch, similarity, count)
    linked = components(links.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    degree = links.groupBy(F.col("sid").alias("n")).agg(F.sum("links").alias("links"))
    named = nodes.select("sid", "copies", "head").join(linked, F.col("sid") == F.col("node"), "left").join(degree, F.col("sid") == F.col("n"), "left")
    named = scratch.write(named.select("sid", "copies", "head", F.coalesce("root", "sid").alias("class_sid"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    least = named.groupBy(F.col("class_sid").alias("c")).agg(F.min("head").alias("first"))
    named = scratch.write(named.join(least, F.col("class_sid") == F.col("c")).select(F.col("sid").alias("s"), "class_sid", "copies", "links", "first"), "named")
    scratch.drop("nodes", "members", "candidates", "near-lead", "rest", "links", "classes")
    alone = F.col("sid").isNull()
    return rows.select("doc_id", "text_hash", "sid").join(named, F.col("sid") == F.col("s"), "left").select(
        "doc_id", "text_hash", "sid", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), "class_sid",
        F.when(alone, 1).otherwise(F.col("copies")).cast("long").alias("n_copies"),
        F.when(alone, 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        (alone | ((F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("text_hash") == F.col("first.text_hash")))).alias("is_first"),
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of docs without all but the first of each class; rows that repeat both doc_id and text become one.

    All columns stay, whatever they are called. Of rows that repeat, the one with the least JSON stays.
    """
    found = written(classes(docs, similarity, recall, count=False).select("doc_id", "text_hash", "is_first"), "near-join-rows")
    own = docs.select(packed(docs).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"))

    def keys(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))

    on = (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d"))
    gone = keys(found.where("not is_first").distinct())
    repeated = keys(found.where("is_first").groupBy("doc_id", "text_hash").count().where("count > 1"))
    own = marked(own, gone.select("h").unionByName(repeated.select("h")))
    some = own.where("maybe").join(gone, on, "left_anti")
    if not repeated.isEmpty():
        one = some.join(repeated, on, "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("own", F.to_json("own")).alias("own"))
        some = some.join(repeated, on, "left_anti").select("own").unionByName(one.select("own"))
    stay = own.where("not maybe").select("own").unionByName(some.select("own"))
    return stay.select(*unpacked(stay, "own", docs))
