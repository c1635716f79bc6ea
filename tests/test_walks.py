from __future__ import annotations

import re

import pytest

from findlake.operators import graph

NODES = [(i, "external" if i % 7 == 6 else "x", f"n{i}") for i in range(40)]
#: Two steps down from every node, edges of several types, some of them twice.
EDGES = [(i, 2 * i + k, t) for i in range(20) for k, t in ((1, "contains"), (2, "touches"), (2, "touches"), (1, "follows"))]


@pytest.fixture
def tables(spark):
    name = lambda i: f"v{i:02}"
    nodes = spark.createDataFrame([(name(i), kind, text) for i, kind, text in NODES], "id string, kind string, name string")
    edges = spark.createDataFrame([(name(a), name(b), t) for a, b, t in EDGES if b < 40], "source string, target string, type string")
    return nodes, edges


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of what the walks cut, with no joins that Spark would broadcast by itself."""
    seen, old, cut = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), graph.cut

    def watched(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph, "cut", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield seen
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_path_needs_the_hops_to_its_end_only(spark, plans):
    chain = spark.createDataFrame([(f"v{i:02}", f"v{i + 1:02}", "calls") for i in range(30)], "source string, target string, type string")
    assert rows(graph.shortest_path(chain, "v00", "v02")) == [(0, "v00"), (1, "v01"), (2, "v02")]
    assert len(plans) <= 4  # the start, two hops, what was found
    assert rows(graph.shortest_path(chain, "v05", "v05")) == [(0, "v05")]
    assert rows(graph.shortest_path(chain, "v00", "v29", 3)) == []


@pytest.mark.parametrize("direction, origin", [("down", "v00"), ("up", "v31")])
def test_edges_and_nodes_of_a_lineage_do_not_move_to_a_small_frontier(tables, plans, direction, origin):
    graph.lineage(*tables, origin, direction, 2)
    steps = [p for p in plans if re.search(r"Join \[a#", p)]
    assert steps and not any(re.search(r"SortMergeJoin \[a#", p) for p in steps)
    nodes_met = [p for p in plans if "kind#" in p]
    assert nodes_met and not any(re.search(r"SortMergeJoin \[id#", p) for p in nodes_met)


def test_walks_give_the_same_rows_from_large_frontiers_and_repeated_edges(spark, tables, monkeypatch):
    nodes, edges = tables
    seeds = spark.createDataFrame([("v03",), ("v04",)], "node string")
    walks = [
        lambda e: graph.lineage(nodes, e, "v00", "down", 4), lambda e: graph.lineage(nodes, e, "v31", "up", 6), lambda e: graph.impact(nodes, e, seeds, 2),
        lambda e: graph.reach(e, seeds, 3, undirected=True, names=nodes), lambda e: graph.reach(e, seeds, 3), lambda e: graph.shortest_path(e, "v31", "v32", 9),
    ]
    small = [rows(w(edges.distinct())) for w in walks]
    assert all(small)
    monkeypatch.setattr(graph, "FEW", 0)
    assert [rows(w(edges)) for w in walks] == small


def test_degrees_join_nothing_and_distinct_edges_go_to_enough_parts(spark, tables, monkeypatch):
    nodes, edges = tables
    found = graph.degrees(nodes, edges)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    ids = {n[0] for n in rows(nodes)}
    ends = [(r.source, r.target) for r in edges.collect()]
    assert {i for i, _, _ in rows(found)} == ids and len(rows(found)) == len(ids)
    assert rows(found) == sorted((i, sum(b == i for _, b in ends), sum(a == i for a, _ in ends)) for i in ids)
    monkeypatch.setattr(graph, "PART_ROWS", 5)
    parts = graph.distinct_in_parts(edges)
    assert rows(parts) == rows(edges.distinct()) and parts.rdd.getNumPartitions() == -(-edges.count() // 5)
