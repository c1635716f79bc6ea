"""Queries over a property graph held as two tables.

nodes: id, kind, name (and what else they carry); edges: source, target, type. Walks are loops over frontiers: one join,
one anti join with what was reached and one cut of the lineage a hop, so that a hop costs its frontier and its edges,
and a node is reached once. A frontier of up to FEW nodes goes to the edges and nodes, which are then read but not moved.
Walks take edges as a set, so these may repeat. Neighbour ties go by name, then id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findlake.plans.checkpoint import cut

# fixed values: which way influence runs along each type of edge
FLOW = {
    "defines": "down", "contains": "down", "touches": "down", "modifies": "down", "mentions": "down", "delivers": "up", "records": "up", "logged_in": "down", "arose_in": "up", "affects": "up",
    "guards": "up", "prevented_by": "down", "fixed_by": "down", "covers": "up", "verifies": "up", "flags": "up", "cites": "up", "recorded_as": "down", "introduced_by": "up", "violates": "up", "classified_as": "up",
}
CODE_FLOW = dict.fromkeys(("calls", "imports", "inherits", "implements", "uses", "references", "maps_to"), "up")
SINGLE_HOP = ("follows", "recurs")
STRUCTURAL = ("defines", "contains")
HUBS = ("cwe", "rule")
HUB_EDGES = ("violates", "classified_as")
#: Rows that are sent to every executor, some 80 MB.
FEW = 1_000_000
#: Rows of which one task holds the distinct ones.
PART_ROWS = 250_000


def _meet(few: DataFrame, many: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many joined with few, which has been cut before; the many stay where they are unless there are too many of the few."""
    return many.join(F.broadcast(few) if few.count() <= FEW else few, key, how)


def unique_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, type, provenance): the first by seq."""
    w = Window.partitionBy("source", "target", "type", "provenance").orderBy("seq")
    return edges.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree of every node, isolated ones too; nodes have an id each. One pass over the edges, one aggregation with the nodes among the ends, no join."""
    ends = edges.selectExpr("stack(2, source, 1L, 0L, target, 0L, 1L) as (id, o, i)").where("id is not null")
    every = ends.select("id", "i", "o", F.lit(False).alias("node")).union(nodes.select("id", F.lit(0), F.lit(0), F.lit(True)))
    sums = every.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.bool_or("node").alias("node"))
    return sums.where("node").drop("node")


def distinct_in_parts(rows: DataFrame) -> DataFrame:
    """Distinct rows in as many parts as keep one to PART_ROWS, whatever number of partitions the session sets."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    return rows.repartition(n, *rows.columns).distinct()


def find_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Matches of the best rank that has any: the id itself, a qualified end of it, a part of a real node's name, an external's."""
    real = F.col("kind") != "external"
    rank = F.when(F.col("id") == text, 0).when(F.col("id").endswith("." + text) | F.col("id").endswith(":" + text), 1).when(real & F.contains(F.lower("name"), F.lit(text.lower())), 2).when(F.contains(F.lower("name"), F.lit(text.lower())), 3)
    found = nodes.withColumn("rank", rank).where("rank is not null")
    best = found.agg(F.min("rank").alias("best"))
    return found.join(F.broadcast(best), F.col("rank") == F.col("best")).drop("rank", "best")  # one row


def reach(edges: DataFrame, seeds: DataFrame, depth: int, undirected: bool = False, names: DataFrame | None = None, until: str | None = None) -> DataFrame:
    """node, hops, parent of everything within some hops of the seeds (column node), or of the hops up to the one that reaches the node until."""
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    if undirected:
        out = out.union(out.select(F.col("b"), F.col("a")))
    start = cut(seeds.select("node").distinct().select("node", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent")))
    layers, seen, frontier = [start], start.select("node"), start
    for hop in range(1, depth + 1):
        if until is not None and not frontier.where(F.col("node") == until).isEmpty():
            break
        near = frontier.select(F.col("node").alias("a"))
        if names is not None:
            near = cut(_meet(near, names.select(F.col("id").alias("a"), F.col("name").alias("tie")), "a"))
        else:
            near = near.withColumn("tie", F.col("a"))
        step = _meet(near, out, "a").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("tie", "a")).alias("first"))
        frontier = cut(step.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hops"), F.col("first.a").alias("parent")))
        if frontier.isEmpty():
            break
        layers.append(frontier)
        seen = seen.union(frontier.select("node"))
    return reduce(DataFrame.unionByName, layers)


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 20) -> DataFrame:
    """step, node along a shortest undirected path (empty without one); ties go by the parent's id."""
    spark = edges.sparkSession
    found = cut(reach(edges, spark.createDataFrame([(start,)], "node string"), most, undirected=True, until=end))
    path, node = [], end
    while node is not None and (row := found.where(F.col("node") == node).first()):  # one row a step of the answer
        path.append((row["hops"], node))
        node = row["parent"]
    return spark.createDataFrame(path, "step int, node string")


def lineage(nodes: DataFrame, edges: DataFrame, origin: str, direction: str, depth: int = 6, include_code: bool = False) -> DataFrame:
    """node, depth, parent, via: what led to a node (up) or came from it (down).

    Structural edges are followed down only while the walk has used no other kind; sequence edges are one hop from the
    origin and are not walked on; external nodes are left out.
    """
    flow = FLOW | (CODE_FLOW if include_code else {})
    up = [k for k, v in flow.items() if v == "up"]
    way = edges.where(F.col("type").isin(*flow, *SINGLE_HOP))
    turned = F.col("type").isin(*up, *SINGLE_HOP)
    way = way.select(F.when(turned, F.col("target")).otherwise(F.col("source")).alias("above"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("below"), "type")
    a, b = ("above", "below") if direction == "down" else ("below", "above")
    real = nodes.where("kind <> 'external'").select(F.col("id").alias("node"))
    steps = way.select(F.col(a).alias("a"), F.col(b).alias("node"), "type")
    start = cut(edges.sparkSession.createDataFrame([(origin, 0, None, None, True)], "node string, depth int, parent string, via string, inside boolean"))
    layers, frontier = [start], start
    for level in range(1, depth + 1):
        next_ = _meet(frontier.select(F.col("node").alias("a"), "inside"), steps, "a")
        structural, single = F.col("type").isin(*STRUCTURAL), F.col("type").isin(*SINGLE_HOP)
        next_ = next_.where(F.lit(level == 1) | ~single)
        if direction == "down":
            next_ = next_.where(F.col("inside") | ~structural)
        best = next_.groupBy("node").agg(F.min(F.struct("a", "type", "inside")).alias("f"))
        fresh = cut(best.join(reduce(DataFrame.unionByName, layers).select("node"), "node", "left_anti"))
        fresh = fresh.join(_meet(fresh.select("node"), real, "node", "left_semi").distinct(), "node", "left_semi")
        frontier = cut(fresh.select("node", F.lit(level).alias("depth"), F.col("f.a").alias("parent"), F.col("f.type").alias("via"), (F.col("f.inside") & F.col("f.type").isin(*STRUCTURAL)).alias("inside")))
        if frontier.isEmpty():
            break
        layers.append(frontier)
        frontier = frontier.where(~F.col("via").isin(*SINGLE_HOP))
    return reduce(DataFrame.unionByName, layers[1:], start.where("false")).select("node", "depth", "parent", "via")


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """node, hops, via: what a change reaches over edges that are no code edges; hubs are walked on from only as seeds."""
    kinds = nodes.select(F.col("id").alias("node"), "kind")
    some = edges.where(~F.col("type").isin(*CODE_FLOW, "follows"))
    both = some.select(F.col("source").alias("a"), F.col("target").alias("node"), "type").union(some.select(F.col("target"), F.col("source"), "type"))
    start = cut(_meet(cut(seeds.select("node").distinct()), kinds, "node").select("node", "kind", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via")))
    layers, frontier = [start], start
    for hop in range(1, depth + 1):
        step = _meet(frontier.select(F.col("node").alias("a"), F.col("kind").alias("from_kind")), both, "a")
        step = step.where(~F.col("type").isin(*HUB_EDGES) | F.col("from_kind").isin(*HUBS))
        best = step.groupBy("node").agg(F.min("type").alias("via"))
        fresh = cut(best.join(reduce(DataFrame.unionByName, layers).select("node"), "node", "left_anti"))
        frontier = cut(_meet(fresh, kinds, "node").select("node", "kind", F.lit(hop).alias("hops"), "via"))
        if frontier.isEmpty():
            break
        layers.append(frontier)
        frontier = frontier if hop < depth else frontier.limit(0)
    return reduce(DataFrame.unionByName, layers).select("node", "hops", "via")


def timeline(nodes: DataFrame, edges: DataFrame, origin: str, depth: int) -> DataFrame:
    """Dated nodes within some hops, for ordering by date, kind and name. nodes carry date (null for undated)."""
    seeds = nodes.where(F.col("id") == origin).select(F.col("id").alias("node"))
    near = reach(edges, seeds, depth, undirected=True)
    return near.join(nodes.where("date is not null"), F.col("node") == F.col("id")).select("node", "hops", "date", "kind", "name")


def follows(commits: DataFrame, by: str, order: list[str]) -> DataFrame:
    """source (a commit), target (the one before it)."""
    w = Window.partitionBy(by).orderBy(*order)
    return commits.withColumn("target", F.lag("id").over(w)).where("target is not null").select(F.col("id").alias("source"), "target")
