"""The network of reports that share indicators, its components, neighbourhoods and paths."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import rules
from tidewatch.session import checkpoint_dir, shared_path
from tidewatch.sources.stores import remove, written


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through spark.checkpoint.dir."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def usable(links: DataFrame, cap: int = 25) -> tuple[DataFrame, DataFrame]:
    """Indicators (ioc_id, fan_out) of 2 to cap reports, and one row with the number above the cap."""
    fan = links.groupBy("ioc_id").agg(F.count("*").alias("fan_out")).where("fan_out >= 2")
    return fan.where(F.col("fan_out") <= cap), fan.agg(F.count_if(F.col("fan_out") > cap).alias("dropped"))


def pairs(links: DataFrame, cap: int = 25, hidden: DataFrame | None = None) -> DataFrame:
    """a, b, weight: reports that share indicators, each pair once with the number shared.

    Hidden reports go before fan-out is counted. The cap bounds what one indicator adds to cap * cap / 2 rows, so the self-join grows
    with the links, not with the square of a popular indicator; both sides are reduced to usable indicators first.
    """
    if hidden is not None:
        links = links.join(hidden.select("item_id").distinct(), "item_id", "left_anti")
    keep, _ = usable(links, cap)
    few = links.join(keep.select("ioc_id"), "ioc_id", "left_semi").select("ioc_id", "item_id")
    left, right = few.withColumnRenamed("item_id", "a"), few.withColumnRenamed("item_id", "b")
    return left.join(right, "ioc_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


#: Removes a query's shuffle files when it ends; without it they stay until the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries in here leave no shuffle files behind."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b); component is the least node.

    Labels spread by minima over neighbours and are shortened by pointer jumping, so a path of n nodes takes about log n rounds. Every
    round is written to the folder of spark.checkpoint.dir and removed when the next one is there, as its shuffle files are; so rounds
    together take the disk of one. Rounds end when no label changes. Edges may repeat.
    """
    spark = edges.sparkSession
    at = shared_path(spark, "components")
    with freed(spark):
        edges = written(edges.select("a", "b"), f"{at}/edges")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels, turn = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{at}/labels0"), 0
        while True:
            near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("m"))
            spread = written(labels.join(near, F.col("node") == F.col("n"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("m")), f"{at}/spread{turn}")
            remove(spark, f"{at}/labels{turn}")
            jump = spread.select(F.col("node").alias("j"), F.col("m").alias("up"))
            labels = written(spread.join(jump, F.col("m") == F.col("j"), "left").select("node", "old", F.least("m", F.coalesce("up", "m")).alias("component")), f"{at}/labels{turn + 1}")
            remove(spark, f"{at}/spread{turn}")
            if labels.where("component <> old").isEmpty():
                remove(spark, f"{at}/edges")
                return labels.select("node", "component")
            labels, turn = labels.select("node", "component"), turn + 1


def linked(links: DataFrame, cap: int = 25) -> DataFrame:
    """(node, component) for the network that pairs(links, cap) draws, without its pairs.

    The reports of an indicator are tied to its least one: n - 1 edges in place of n * (n - 1) / 2 join the same nodes. Links and least
    reports are written first, so that the shuffle of one step is gone before the next one's begins.
    """
    spark = links.sparkSession
    at = shared_path(spark, "linked")
    with freed(spark):
        links = written(links.select("ioc_id", "item_id"), f"{at}/links")
        least = written(links.groupBy("ioc_id").agg(F.count("*").alias("fan_out"), F.min("item_id").alias("a")).where(F.col("fan_out").between(2, cap)), f"{at}/least")
        found = components(links.join(least, "ioc_id").where("item_id > a").select("a", F.col("item_id").alias("b")))
    remove(spark, at)
    return found


def network_slice(edges: DataFrame, kinds: DataFrame, ties: DataFrame, threshold: int) -> DataFrame:
    """component, size, reports and actors at a weight threshold, largest first, then by name.

    edges (a, b, weight) between reports; ties (actor, item) hold only where the report has an edge left and join components.
    Components whose reports are all advisories (kind exploit) go. kinds: id, kind.
    """
    kept = edges.where(F.col("weight") >= threshold).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    drawn = kept.select(F.col("a").alias("item")).unionByName(kept.select(F.col("b").alias("item"))).distinct()
    tied = ties.select("actor", F.col("item").cast("string").alias("item")).join(drawn, "item", "left_semi")
    all_edges = kept.unionByName(tied.select(F.col("item").alias("a"), F.concat(F.lit("adv:"), "actor").alias("b")))
    found = components(all_edges).join(kinds.select(F.col("id").cast("string").alias("node"), "kind"), "node", "left")
    actor = F.col("node").startswith("adv:")
    g = found.groupBy("component").agg(F.count("*").alias("size"), F.count_if(~actor).alias("reports"), F.count_if(actor).alias("actors"), F.bool_or(~actor & F.coalesce(F.col("kind") != "exploit", F.lit(True))).alias("real"))
    return g.where("real").drop("real").orderBy(F.col("size").desc(), "component")


def shared(links: DataFrame, iocs: DataFrame, a, b, most: int = 200) -> DataFrame:
    """Indicators (ioc_type, value) of both reports, by rank of type, then value."""
    of = lambda x: links.where(F.col("item_id") == x).select("ioc_id")
    rank = F.array_position(F.array(*map(F.lit, ("ip", "domain", "file_hash", "cve", "mitre"))), F.col("ioc_type"))
    return iocs.join(of(a).intersect(of(b)), "ioc_id", "left_semi").orderBy(rank, "value").limit(most).select("ioc_type", "value")


def ties(reports: DataFrame, drawn: DataFrame, least: int = 2) -> DataFrame:
    """actor, item for actors that cover at least so many drawn reports; bare families and UNID labels are none."""
    name = F.coalesce(F.col("crowdstrike_adversary"), F.col("adversary_label"))
    rows = reports.join(drawn, "id", "left_semi").select(F.col("id").alias("item"), F.trim(name).alias("actor")).where(rules.specific(F.col("actor")) & ~F.upper("actor").startswith("UNID"))
    return rows.join(rows.groupBy("actor").agg(F.count("*").alias("n")).where(F.col("n") >= least), "actor", "left_semi").select("actor", "item")


def degrees(reports: DataFrame, links: DataFrame, iocs: DataFrame) -> DataFrame:
    """node, degree: distinct neighbours of every report, indicator and actor; a CVE reached by both ways counts once."""
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    by_link = links.join(iocs, "ioc_id").select(node("item", "item_id").alias("a"), F.when(F.col("ioc_type") == "cve", F.concat(F.lit("cve:"), F.upper("value"))).otherwise(F.concat(F.lit("ioc:"), "value")).alias("b"))
    by_cve = reports.where("cve_id is not null").select(node("item", "id").alias("a"), F.concat(F.lit("cve:"), F.upper(F.trim("cve_id"))).alias("b"))
    name = F.coalesce(F.col("crowdstrike_adversary"), F.col("adversary_label"))
    by_actor = reports.where(rules.specific(name)).select(node("item", "id").alias("a"), F.concat(F.lit("adv:"), name).alias("b"))
    edges = by_link.unionByName(by_cve).unionByName(by_actor).distinct()
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, seeds: DataFrame, per_node: int = 40, total: int | None = None) -> DataFrame:
    """a, b for the neighbours of seeds (node) over undirected edges (a, b), at most per_node each, by order of b."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    hit = both.join(seeds.select(F.col("node").alias("a")).distinct(), "a", "left_semi")
    out = hit.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("_n") <= per_node).drop("_n")
    return out.orderBy("a", "b").limit(total) if total else out


TYPES = ("item", "ioc", "cve", "ttp", "adversary")


def expand(node: str, reports: DataFrame, links: DataFrame, iocs: DataFrame, hidden: DataFrame, types=TYPES, subtypes=None, most: int = 40) -> DataFrame:
    """a, b: the edges from one node (type:key) to its neighbours of the chosen types, `most` at most; no types means all.

    A report leads to its indicators (of the subtypes, where any are given), CVEs, techniques and its actor, if specific; everything
    else leads to the reports that name it, hidden ones left out. A CVE is reached by link and by the report's own field.
    """
    types = set(types) or set(TYPES)
    kind, _, key = node.partition(":")
    to = lambda c: c.select(F.lit(node).alias("a"), "b").distinct()
    if kind == "item":
        own = reports.where(F.col("id").cast("string") == key)
        linked = links.where(F.col("item_id").cast("string") == key).join(iocs, "ioc_id").orderBy("ioc_id").limit(most)
        group = F.when(F.col("ioc_type") == "cve", "cve").when(F.col("ioc_type") == "mitre", "ttp").otherwise("ioc")
        wanted = group.isin(*types) & ((group != "ioc") | (F.lit(True) if not subtypes else F.col("ioc_type").isin(*subtypes)))
        found = linked.where(wanted).select(node_id(F.col("ioc_type"), F.col("value")).alias("b"))
        if "cve" in types:
            found = found.unionByName(own.where("cve_id <> ''").select(node_id(F.lit("cve"), F.col("cve_id")).alias("b")))
        if "adversary" in types:
            name = F.coalesce("crowdstrike_adversary", "adversary_label")
            found = found.unionByName(own.where(rules.specific(name) & ~F.upper(name).startswith("UNID ")).select(node_id(F.lit("adversary"), name).alias("b")))
        return to(found)
    if "item" not in types:
        return to(reports.limit(0).select(F.lit("").alias("b")))
    if kind == "adv":
        ids = reports.where((F.col("crowdstrike_adversary") == key) | (F.col("adversary_label") == key)).select("id")
    else:
        ids = iocs.where(F.col("value") == key).join(links, "ioc_id").select(F.col("item_id").alias("id"))
        if kind == "cve":
            ids = ids.unionByName(reports.where(F.col("cve_id") == key).select("id"))
    shown = reports.join(ids.distinct(), "id", "left_semi").join(hidden.select("raw_hash"), "raw_hash", "left_anti")
    return to(shown.orderBy(F.col("published_at").desc_nulls_last(), "id").limit(most).select(node_id(F.lit("item"), F.col("id").cast("string")).alias("b")))


def two_hops(edges: DataFrame, seed: DataFrame, per_node: int = 40, second: int = 60) -> DataFrame:
    """node, depth around a seed: all first neighbours up to per_node each, then at most `second` new ones."""
    first = neighbours(edges, seed, per_node).select(F.col("b").alias("node")).distinct().join(seed.select("node"), "node", "left_anti")
    known = seed.select("node").unionByName(first)
    new = neighbours(edges, first, per_node).select(F.col("b").alias("node")).distinct().join(known, "node", "left_anti").orderBy("node").limit(second)
    depth = lambda df, d: df.select("node", F.lit(d).alias("depth"))
    return depth(seed.select("node"), 0).unionByName(depth(first, 1)).unionByName(depth(new, 2))


def reach(edges: DataFrame, seed: DataFrame, depth: int, most: int = 6000) -> DataFrame:
    """node, depth by breadth-first search, one join per level; it ends early when `most` nodes are passed."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = checkpointed(seed.select("node", F.lit(0).alias("depth")))
    for d in range(1, depth + 1):
        edge = seen.where(F.col("depth") == d - 1).select(F.col("node").alias("a"))
        new = both.join(edge, "a", "left_semi").select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        new = checkpointed(new)
        if new.isEmpty():
            break
        seen = checkpointed(seen.unionByName(new))
        if seen.count() >= most:
            break
    return seen


def typed_edges(reports: DataFrame, links: DataFrame, iocs: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """a, b, type and subtype of b, and rank (the order in which a tells of its neighbours), both ways between reports and entities.

    A report tells of its indicators by id, then of its own CVE, then of its actor; an entity of its reports, newest first. Hidden reports
    are not told of.
    """
    item, name = F.concat(F.lit("item:"), F.col("id").cast("string")), F.coalesce("crowdstrike_adversary", "adversary_label")
    kind = F.when(F.col("ioc_type") == "cve", "cve").when(F.col("ioc_type") == "mitre", "ttp").otherwise("ioc")
    row = lambda type_, subtype, *order: [type_.alias("type"), subtype.cast("string").alias("subtype"), F.struct(*(c.cast("long").alias(f"o{i}") for i, c in enumerate(order))).alias("rank")]
    none = F.lit(None)
    linked = links.join(iocs, "ioc_id").withColumn("id", F.col("item_id")).select("id", item.alias("a"), node_id(F.col("ioc_type"), F.col("value")).alias("b"), *row(kind, F.col("ioc_type"), F.lit(0), F.col("ioc_id")))
    cves = reports.where("cve_id <> ''").select("id", item.alias("a"), node_id(F.lit("cve"), F.col("cve_id")).alias("b"), *row(F.lit("cve"), none, F.lit(1), F.lit(0)))
    actors = reports.where(rules.specific(name) & ~F.upper(name).startswith("UNID ")).select("id", item.alias("a"), node_id(F.lit("adversary"), name).alias("b"), *row(F.lit("adversary"), none, F.lit(2), F.lit(0)))
    out = linked.unionByName(cves).unionByName(actors)
    out = out.groupBy("id", "a", "b").agg(F.min(F.struct("rank", "type", "subtype")).alias("r")).select("id", "a", "b", "r.type", "r.subtype", "r.rank")
    seen = reports.select("id", "raw_hash", "published_at")
    seen = seen if hidden is None else seen.join(hidden.select("raw_hash").distinct(), "raw_hash", "left_anti")
    newest = F.coalesce(-F.unix_date("published_at"), F.lit(1 << 40))
    back = out.select("id", "a", "b").join(seen, "id").select(F.col("b").alias("a"), F.col("a").alias("b"), *row(F.lit("item"), none, newest, F.col("id")))
    return out.drop("id").unionByName(back)


#: Nodes that one walk may ask for their neighbours, and may add; neighbours that one node tells of.
MOST_REQUESTS, MOST_NEW, MOST_TOLD = 300, 800, 40


def walk(edges: DataFrame, root: str, depth: int, types=TYPES, subtypes=None, requests: int = MOST_REQUESTS, new_nodes: int = MOST_NEW, told: int = MOST_TOLD) -> DataFrame:
    """node, depth, place and capped: the nodes that a walk from root over typed edges meets, in the order in which it meets them.

    edges are those of typed_edges(). Nodes of the types (and of the subtypes, where any are given, if they are indicators) are followed,
    and reports always, as all ways lead through them. Level by level, nodes are asked for their neighbours in the order in which they were met,
    each telling of `told` at most. The walk stops before a request when `requests` have been made or `new_nodes` have been added, and is
    then capped: the last request may go beyond `new_nodes`. What a request adds is a running sum over the level's first meetings, so a
    level is one join and one window over at most requests * told rows.
    """
    wanted = {*(types or TYPES), "item"}
    ok = F.col("type").isin(*wanted) & (F.lit(True) if not subtypes else (F.col("type") != "ioc") | F.col("subtype").isin(*subtypes))
    spark = edges.sparkSession
    edges = edges.where(ok)
    seen = spark.createDataFrame([(root, 0, 0)], "node string, depth int, place long")
    asked, size, capped = 0, 1, False
    for level in range(1, depth + 1):
        queue = seen.where(F.col("depth") == level - 1)
        number = queue.count()
        if not number:
            break
        queue = queue.orderBy("place").limit(requests - asked).select(F.col("node").alias("a"), "place") if number > requests - asked else queue.select(F.col("node").alias("a"), "place")
        by_rank = Window.partitionBy("a").orderBy("rank", "b")
        near = edges.join(F.broadcast(queue), "a").withColumn("n", F.row_number().over(by_rank)).where(F.col("n") <= told)
        first = near.join(seen.select(F.col("node").alias("b")), "b", "left_anti").groupBy("b").agg(F.min(F.struct("place", "n")).alias("at"))
        added = first.groupBy(F.col("at.place").alias("place")).agg(F.count("*").alias("added"))
        # as many rows as there were requests at most, so one task is enough
        before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        turns = checkpointed(queue.join(added, "place", "left").select("place", F.coalesce(F.sum("added").over(before), F.lit(0)).alias("before"), F.coalesce("added", F.lit(0)).alias("added")))
        made = turns.where(F.col("before") < new_nodes - (size - 1))
        done, more = made.agg(F.count("*"), F.coalesce(F.sum("added"), F.lit(0))).first()
        new = first.join(made, F.col("at.place") == F.col("place"), "left_semi")
        new = new.select(F.col("b").alias("node"), F.lit(level).alias("depth"), (F.row_number().over(Window.orderBy("at", "b")) + size - 1).cast("long").alias("place"))
        seen = checkpointed(seen.unionByName(new))
        capped = done < number
        asked, size = asked + done, size + more
        if capped:
            break
    return seen.withColumn("capped", F.lit(capped))


def merged(*fragments: DataFrame, key: str = "id") -> DataFrame:
    """Fragments with equal columns put together; of rows with equal keys the first fragment's stays."""
    out = fragments[0].withColumn("_f", F.lit(0))
    for i, f in enumerate(fragments[1:], 1):
        out = out.unionByName(f.withColumn("_f", F.lit(i)))
    best = out.groupBy(key).agg(F.min_by(F.struct(*[c for c in fragments[0].columns if c != key]), "_f").alias("_r"))
    return best.select(key, "_r.*")


def width(weight, greatest) -> "F.Column":
    """Line width: 1 to 8, in proportion to the root of how far a weight exceeds 1."""
    share = F.sqrt(F.greatest(F.lit(1), weight) - 1) / F.sqrt(F.greatest(greatest, F.lit(2)) - 1)
    return F.when(greatest <= 1, F.lit(1.0)).otherwise(1 + share * 7)


def node_id(kind, key) -> "F.Column":
    """type:key; techniques are of type ttp, CVE keys in upper case, actors under adv."""
    short = F.when(kind == "mitre", "ttp").when(kind.isin("cve", "item"), kind).when(kind == "adversary", "adv").otherwise("ioc")
    return F.concat(short, F.lit(":"), F.when(kind == "cve", F.upper(key)).otherwise(key))


def edge_id(a, b) -> "F.Column":
    return F.concat(F.least(a, b), F.lit("--"), F.greatest(a, b))


def has_more(drawn: DataFrame, true_degree: DataFrame) -> DataFrame:
    """Nodes whose degree exceeds that of the drawn edges (a, b)."""
    ends = drawn.select(F.col("a").alias("node")).unionByName(drawn.select(F.col("b").alias("node")))
    seen = ends.groupBy("node").agg(F.count("*").alias("drawn"))
    return true_degree.join(seen, "node").where("degree > drawn").select("node", "degree", "drawn")
