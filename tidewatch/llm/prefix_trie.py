"""The trie of conversations by their turns, built level by level, and what sharing its prefixes would save.

Every conversation is rebuilt first: the first h turns of the conversation whose id is the next lower multiple of 20 (all, if it has
fewer; none, if there is none), then its own turns after its first h, with h = crc32(id as decimal text) % 4. Turns are ordered by turn,
null first; rows that share a turn by a digest of role and text, a null role or text counting as empty.

Conversations with the same turns are brought together first, so the trie is built over different sequences with weights. Level-synchronous
construction: at each depth the sequences that are still live are grouped by (parent node, next turn), and a group is a node; its id is the
least conv_id among its members. A node whose sequences have at most `bound` turns left is closed: the same construction, level by level,
goes on over it and many other such nodes at once inside one task. Only larger ones go on as Spark jobs, each level written before the next
begins. Then joins of each level with the one below, from the deepest up, add up leaves and savings.

n_convs counts members, n_children child nodes, n_leaves nodes without children in the subtree (a node itself if it has none),
saved_tokens sums over the subtree (n_convs - 1) times the words of a node's last turn (runs outside [\\x20\\x09-\\x0D]; the root has none).
ends_sha256 is over the ids of conversations that end at the node: they are sorted, packed by task, and hashed in one stream, so a
conversation with very many copies needs no memory for them.

Turns are compared by 120 bits of SHA-256 over role and text with the role's length before them. Rows without conv_id belong to no
conversation and are left out; repeated rows are turns of their own; long texts are read once. An empty table (or one without any
conv_id) gives no rows, not even a root. One conversation is held by one task with 32 bytes a turn. Only conv_id, turn, role and text are
read, so names of other columns cannot clash; conv_id and turn are read as longs, so a text that is no number raises.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import partitions, written

#: A node whose sequences have more turns left is grouped by Spark, level by level.
BOUND = 4096
#: Turns that one task closes at once.
TASK_TURNS = 1 << 19
NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, words long, end_of long, n_children long, n_leaves long, saved_tokens long"


def turns_of(conversations: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (conv, depth from 1, k1 and k2, words), and every conv."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    thin = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        *(F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "k1"), (16, "k2"))), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    place = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "k1", "k2")
    own = written(thin.withColumn("at", F.row_number().over(place)).drop("turn"), "turns")
    base = F.col("conv") - F.pmod(F.col("conv"), F.lit(every))
    taken = F.crc32(F.col("conv").cast("string")) % 4
    convs = written(own.groupBy("conv").agg(F.max("at").alias("n")).select("conv", "n", base.alias("base"), taken.alias("h")), "conversations")
    heads = own.where((F.col("at") <= 3) & (F.pmod(F.col("conv"), F.lit(every)) == 0))
    lent = convs.select(F.col("conv").alias("of"), "base", "h").where("h > 0").join(heads, F.col("base") == F.col("conv")).where("at <= h")
    lent = lent.select(F.col("of").alias("conv"), F.col("at").cast("long").alias("depth"), "k1", "k2", "words")
    have = convs.select(F.col("conv").alias("other"), F.col("n").alias("most"))
    begin = convs.join(have, F.col("base") == F.col("other"), "left").select("conv", "h", F.least("h", F.coalesce("most", F.lit(0))).alias("lent"))
    rest = own.join(begin, "conv").where("at > h").select("conv", (F.col("at") - F.col("h") + F.col("lent")).cast("long").alias("depth"), "k1", "k2", "words")
    return written(lent.unionByName(rest), "rebuilt"), convs.select("conv")


def different(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, rep and n: the conversation, the least one that has the same turns, and the number of turns."""
    mark = [F.bit_xor(F.xxhash64(F.lit(seed), "depth", "k1", "k2")) for seed in (17, 29)]
    marks = turns.groupBy("conv").agg(F.count("*").alias("n"), mark[0].alias("m1"), mark[1].alias("m2"))
    whole = convs.join(marks, "conv", "left").select("conv", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n", "m1", "m2")))
    whole = written(whole, "sequences")
    reps = whole.groupBy("n", "m1", "m2").agg(F.min("conv").alias("rep"))
    return whole.join(reps, ["n", "m1", "m2"]).select("conv", "rep", "n")


def closed(key: tuple, rows: pa.Table) -> pa.Table:
    """All nodes below those that the rows' sequences stand at: rows with (conv, n, weight, node, depth_at, depth, k1, k2, words)."""
    rows = rows.sort_by([("conv", "ascending"), ("depth", "ascending")])
    conv, n, weight, node, top, depth, k1, k2, words = (rows.column(c).to_numpy() for c in ("conv", "n", "weight", "node", "depth_at", "depth", "k1", "k2", "words"))
    first = np.flatnonzero(np.diff(conv, prepend=conv[:1] - 1))  # each sequence's next turn; its turns follow in order
    left, size = n[first] - top[first], len(first)
    ids, weights = conv[first], weight[first]
    tops = np.stack([top[first], node[first]], axis=1)
    roots, group = np.unique(tops, axis=0, return_inverse=True)
    group = group.ravel()
    none = np.zeros(0, dtype=np.int64)
    levels: list[dict[str, np.ndarray]] = [{"depth": roots[:, 0], "conv_id": roots[:, 1], "up": np.full(len(roots), -1), "n_convs": np.zeros(len(roots), dtype=np.int64), "words": np.zeros(len(roots), dtype=np.int64), "end_of": np.full(len(roots), -1)}]
    live, step = np.arange(size), 0
    while (live := live[left[live] > step]).size:
        at = first[live] + step
        order = np.lexsort((ids[live], k2[at], k1[at], group[live]))
        live, at = live[order], at[order]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (group[live[1:]] != group[live[:-1]]) | (k1[at[1:]] != k1[at[:-1]]) | (k2[at[1:]] != k2[at[:-1]])
        starts, mine = np.flatnonzero(new), np.cumsum(new) - 1
        ends = np.flatnonzero(left[live] == step + 1)
        end_of = np.full(len(starts), -1)
        end_of[mine[ends]] = live[ends]
        levels.append({"depth": depth[at[starts]], "conv_id": ids[live[starts]], "up": group[live[starts]], "n_convs": np.add.reduceat(weights[live], starts), "words": words[at[starts]], "end_of": end_of})
        group = group.copy()
        group[live] = mine
        step += 1
    out, below = [], (none, none, none)
    for number in range(len(levels) - 1, -1, -1):
        level, (up, leaves, saved) = levels[number], below
        count = len(level["depth"])
        children = np.bincount(up, minlength=count)
        leaf_sum, saved_sum = np.zeros((2, count), dtype=np.int64)
        np.add.at(leaf_sum, up, leaves)
        np.add.at(saved_sum, up, saved)
        if number:
            leaf_sum = np.maximum(leaf_sum, 1)
            saved_sum = saved_sum + (level["n_convs"] - 1) * level["words"]
        below = level["up"], leaf_sum, saved_sum
        parent = levels[number - 1]["conv_id"][level["up"]] if number else level["conv_id"]
        ends = level["end_of"]
        table = {"depth": level["depth"], "conv_id": level["conv_id"], "parent_conv_id": parent, "n_convs": level["n_convs"], "words": level["words"]}
        out.append(pa.table({k: pa.array(v, pa.int64()) for k, v in table.items()} | {"end_of": pa.array(ids[np.maximum(ends, 0)], pa.int64(), mask=ends < 0), "n_children": pa.array(children, pa.int64()), "n_leaves": pa.array(leaf_sum), "saved_tokens": pa.array(saved_sum)}))
    out[-1] = out[-1].set_column(3, "n_convs", pa.nulls(len(roots), pa.int64()))  # the nodes themselves are known; these rows say what is below
    return pa.concat_tables(out)


def digests(ends: DataFrame) -> DataFrame:
    """rep and ends_sha256: the hash of all conv with that rep, ascending, comma-joined."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, conv = batch.column("rep").to_numpy(), batch.column("conv").to_numpy()
            starts = np.flatnonzero(np.diff(rep, prepend=rep[:1] - 1))
            bodies = [",".join(map(str, conv[a:b].tolist())).encode() for a, b in zip(starts, [*starts[1:], len(rep)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rep[starts]), pa.array(conv[starts]), pa.array(bodies, pa.binary())], names=["rep", "first", "body"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for rep, body in zip(batch.column("rep").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if rep == last:
                    state.update(b"," + body)
                    continue
                if state:
                    done.append((last, state.hexdigest()))
                last, state = rep, hashlib.sha256(body)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["end_of", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([state.hexdigest()])], names=["end_of", "ends_sha256"])

    parts = partitions(ends.sparkSession)
    chunks = ends.select("rep", "conv").repartitionByRange(parts, "rep", "conv").sortWithinPartitions("rep", "conv").mapInArrow(packed, "rep long, first long, body binary")
    return chunks.repartition(parts, "rep").sortWithinPartitions("rep", "first").mapInArrow(hashed, "end_of long, ends_sha256 string")


def build(conversations: DataFrame, bound: int = BOUND) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 for each node of the trie."""
    spark = conversations.sparkSession
    turns, convs = turns_of(conversations)
    same = written(different(turns, convs), "same")
    reps = same.groupBy("rep").agg(F.count("*").alias("weight"), F.max("n").alias("n")).withColumnRenamed("rep", "conv")
    total = reps.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.min("conv").alias("least")).first()
    if total.least is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    steps = written(turns.join(reps, "conv").sortWithinPartitions("depth", "conv"), "steps")  # by depth, so that a level reads few row groups
    empty = reps.where("n = 0").select("conv").first()
    root = (0, total.least, None, total.weight, 0, empty and empty.conv)
    levels = [spark.createDataFrame([root], "depth long, conv_id long, parent_conv_id long, n_convs long, words long, end_of long")]
    live = reps.where("n > 0").select("conv", F.lit(total.least).alias("node"))
    done = None
    while True:
        depth = len(levels)
        here = live.join(steps.where(F.col("depth") == depth), "conv")
        ended = F.max(F.when(F.col("n") == depth, F.col("conv")))
        of = here.groupBy(F.col("node").alias("parent"), F.col("k1").alias("g1"), F.col("k2").alias("g2")).agg(
            F.min("conv").alias("id"), F.sum("weight").alias("n_convs"), F.max("words").alias("words"), ended.alias("end_of"), F.sum(F.col("n") - depth).alias("left"))
        of = written(of, "level")
        levels.append(of.select(F.lit(depth).cast("long").alias("depth"), F.col("id").alias("conv_id"), F.col("parent").alias("parent_conv_id"), "n_convs", "words", "end_of"))
        same_node = (F.col("node") == F.col("parent")) & (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))
        moved = written(here.where(F.col("n") > depth).join(of, same_node).select("conv", F.col("id").alias("node"), "left"), "live")
        small = moved.where(F.col("left") <= bound).select("conv", "node", F.lit(depth).cast("long").alias("depth_at"))
        done = small if done is None else done.unionByName(small)
        live = moved.where(F.col("left") > bound).drop("left")
        if live.isEmpty():
            break
    tasks = max(partitions(spark), math.ceil(total.n / TASK_TURNS))
    rest = steps.join(done, "conv").where(F.col("depth") > F.col("depth_at"))
    dealt = rest.withColumn("task", F.pmod(F.xxhash64("node", "depth_at"), F.lit(tasks)).cast("int"))
    below = written(dealt.groupBy("task").applyInArrow(closed, NODE), "closed")

    sums = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    tops = below.where("n_convs is null")
    up, rolled = None, [below.where("n_convs is not null")]
    for depth in range(len(levels) - 1, -1, -1):
        own = tops.where(F.col("depth") == depth).select("conv_id", "n_children", "n_leaves", "saved_tokens")
        if up is not None:
            own = own.unionByName(up.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        own = own.groupBy("conv_id").agg(*sums)
        saved = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved_tokens", F.lit(0))
        counts = F.coalesce("n_children", F.lit(0)).alias("n_children"), F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens")
        up = written(levels[depth].join(own, "conv_id", "left").select(*levels[depth].columns, *counts), "rolled")
        rolled.append(up)
    nodes = rolled[0]
    for more in rolled[1:]:
        nodes = nodes.unionByName(more)
    none = F.lit(hashlib.sha256(b"").hexdigest()).alias("ends_sha256")
    # apart, as rows without a key would all meet in one task
    ended = nodes.join(digests(same), "end_of").select(*nodes.columns, "ends_sha256")
    out = ended.unionByName(nodes.where("end_of is null").select(*nodes.columns, none))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
