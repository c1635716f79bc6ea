"""Graph, incremental and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.operators import graph, incremental
from findlake.plans.registry import query
from findlake.queries.base import FILES_SQL, FINDINGS_SQL, files, findings, table
from findlake.streaming import events as streams

GRAPH_SQL = """
edges AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'contains' AS type FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'touches' FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'delivers' FROM orders UNION ALL SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey, 'affects' FROM lineitem UNION ALL SELECT DISTINCT 'o' || o_orderkey, 'cwe' || o_orderkey % 5, 'classified_as' FROM orders),
nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS kind, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'external' ELSE 'supplier' END, s_name FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'order', o_orderstatus FROM orders UNION ALL SELECT 'p' || p_partkey, 'part', p_name FROM part UNION ALL SELECT 'cwe' || x, 'cwe', 'CWE-' || x FROM range(5) t(x))"""


def _graph(spark: SparkSession, sf_dir: str, repeats: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes, edges; with repeats an edge may stand more than once, which walks do not mind and which saves moving them."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, b, kind: df.selectExpr(f"concat({a}) as source", f"concat({b}) as target", f"'{kind}' as type")
    node = lambda df, a, kind, name: df.selectExpr(f"concat({a}) as id", f"{kind} as kind", f"{name} as name")
    edges = [edge(t("nation"), "'r', n_regionkey", "'n', n_nationkey", "contains"), edge(t("customer"), "'n', c_nationkey", "'c', c_custkey", "contains"), edge(t("supplier"), "'n', s_nationkey", "'s', s_suppkey", "touches"), edge(t("orders"), "'o', o_orderkey", "'c', o_custkey", "delivers"), edge(t("lineitem") if repeats else graph.distinct_in_parts(t("lineitem").select("l_partkey", "l_orderkey")), "'p', l_partkey", "'o', l_orderkey", "affects"), edge(t("orders"), "'o', o_orderkey", "'cwe', o_orderkey % 5", "classified_as")]
    nodes = [node(t("region"), "'r', r_regionkey", "'region'", "r_name"), node(t("nation"), "'n', n_nationkey", "'nation'", "n_name"), node(t("customer"), "'c', c_custkey", "'customer'", "c_name"), node(t("supplier"), "'s', s_suppkey", "case when s_suppkey % 4 = 0 then 'external' else 'supplier' end", "s_name"), node(t("orders"), "'o', o_orderkey", "'order'", "o_orderstatus"), node(t("part"), "'p', p_partkey", "'part'", "p_name"), node(spark.range(5), "'cwe', id", "'cwe'", "concat('CWE-', id)")]
    for parts in (edges, nodes):
        while len(parts) > 1:
            parts[0] = parts[0].union(parts.pop())
    return nodes[0], edges[0]


@query(f"WITH {GRAPH_SQL}, e AS (SELECT source AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) SELECT nodes.id, coalesce(sum(i), 0)::BIGINT AS in_degree, coalesce(sum(o), 0)::BIGINT AS out_degree FROM nodes LEFT JOIN e USING (id) GROUP BY nodes.id")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {GRAPH_SQL}, b(node, hops) AS (SELECT 'r1', 0 UNION SELECT target, hops + 1 FROM b JOIN edges ON source = node WHERE hops < 3) SELECT node, min(hops) AS hops FROM b GROUP BY node")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(_graph(spark, sf_dir, repeats=True)[1], spark.createDataFrame([("r1",)], "node string"), 3).select("node", "hops")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, u AS (SELECT source AS a, target AS b FROM edges WHERE type <> 'classified_as' UNION SELECT target, source FROM edges WHERE type <> 'classified_as'), b(node, hops) AS (SELECT 'c1', 0 UNION SELECT u.b, hops + 1 FROM b JOIN u ON u.a = node WHERE hops < 4) SELECT min(hops)::INT AS step FROM b WHERE node = 'r' || (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 1) UNION ALL SELECT unnest(range(0, 2))::INT""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "customer").where("c_custkey = 1").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    edges = _graph(spark, sf_dir, repeats=True)[1].where("type <> 'classified_as'")
    return graph.shortest_path(edges, "c1", f"r{region}", 4).select("step")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, real AS (SELECT id FROM nodes WHERE kind <> 'external'), w AS (SELECT source AS a, target AS b, type IN ('contains', 'defines') AS s FROM edges WHERE type IN ('contains', 'touches') UNION ALL SELECT target, source, false FROM edges WHERE type IN ('delivers', 'affects', 'classified_as')),
l(node, depth, inside) AS (SELECT 'n3', 0, true UNION SELECT b, depth + 1, inside AND s FROM l JOIN w ON a = node JOIN real ON id = b WHERE depth < 4 AND (inside OR NOT s)) SELECT node, min(depth) AS depth FROM l WHERE node <> 'n3' GROUP BY node""")
def lineage_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir, repeats=True)
    return graph.lineage(nodes, edges, "n3", "down", 4).select("node", "depth")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, real AS (SELECT id FROM nodes WHERE kind <> 'external'), w AS (SELECT target AS a, source AS b FROM edges WHERE type IN ('contains', 'touches') UNION ALL SELECT source, target FROM edges WHERE type IN ('delivers', 'affects', 'classified_as')),
l(node, depth) AS (SELECT 'p5', 0 UNION SELECT b, depth + 1 FROM l JOIN w ON a = node JOIN real ON id = b WHERE depth < 6) SELECT node, min(depth) AS depth FROM l WHERE node <> 'p5' GROUP BY node""")
def lineage_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir, repeats=True)
    return graph.lineage(nodes, edges, "p5", "up", 6).select("node", "depth")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, u AS (SELECT source AS a, target AS b, type FROM edges UNION ALL SELECT target, source, type FROM edges), seeds AS (SELECT id FROM nodes WHERE id IN ('c7', 'cwe2', 'o12')),
i(node, hops) AS (SELECT id, 0 FROM seeds UNION SELECT b, hops + 1 FROM i JOIN u ON a = node WHERE hops < 2 AND (type <> 'classified_as' OR starts_with(node, 'cwe'))) SELECT node, min(hops) AS hops FROM i GROUP BY node""")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir, repeats=True)
    return graph.impact(nodes, edges, spark.createDataFrame([("c7",), ("cwe2",), ("o12",)], "node string"), 2).select("node", "hops")


@query(f"WITH {GRAPH_SQL} SELECT name, id FROM nodes WHERE contains(lower(name), 'customer#00000001')")
def find_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.find_nodes(_graph(spark, sf_dir)[0], "Customer#00000001").select("name", "id")


@query(f"WITH {GRAPH_SQL} SELECT target AS cwe, count(*) AS n, count(DISTINCT name) AS statuses FROM edges JOIN nodes ON source = id WHERE type = 'classified_as' GROUP BY target")
def cwe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return edges.where("type = 'classified_as'").join(nodes, F.col("source") == F.col("id")).groupBy(F.col("target").alias("cwe")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("statuses"))


@query("WITH c AS (SELECT o_custkey, o_orderkey AS id, o_orderdate FROM orders) SELECT 'o' || id AS source, 'o' || lag(id) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, id) AS target FROM c QUALIFY target IS NOT NULL")
def commit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").selectExpr("o_custkey", "concat('o', o_orderkey) as id", "o_orderdate", "o_orderkey")
    return graph.follows(c, "o_custkey", ["o_orderdate", "o_orderkey"])


@query("SELECT 'o' || o_orderkey AS node, o_orderdate AS date FROM orders WHERE o_custkey = 1")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    dates = table(spark, sf_dir, "orders").selectExpr("concat('o', o_orderkey) as id", "o_orderdate as date")
    return graph.timeline(nodes.join(dates, "id", "left"), edges.where("type = 'delivers'"), "c1", 1).select("node", "date")


@query("SELECT date_trunc('month', o_orderdate) AS month, count(*) AS runs, coalesce(count(*) - lag(count(*)) OVER (ORDER BY date_trunc('month', o_orderdate)), 0)::BIGINT AS change FROM orders GROUP BY 1")
def history_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("runs"))
    return m.withColumn("change", F.coalesce(F.col("runs") - F.lag("runs").over(Window.orderBy("month")), F.lit(0)))  # one row a month


@query(f"WITH {FILES_SQL}, k AS (SELECT path, sha256(length(content) || ':' || content || '2:r1' || length(path) || ':' || path) AS key, doc_id FROM files) SELECT path, key FROM k WHERE doc_id % 4 = 0")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = files(spark, sf_dir).select("doc_id", "path", incremental.cache_key(F.col("content"), F.lit("r1"), F.col("path")).alias("key"))
    return incremental.misses(keyed, keyed.where("doc_id % 4 <> 0").select("key")).select("path", "key")


@query(f"WITH {FINDINGS_SQL}, r AS (SELECT id, 1 AS report, 'open' AS status, start_line AS line, [rule_id] AS tags FROM findings UNION ALL SELECT id, 2, 'fixed', start_line + 1, ['again', rule_id] FROM findings WHERE start_line % 2 = 0), o AS (SELECT DISTINCT id, report, status, line, tags FROM r QUALIFY row_number() OVER (PARTITION BY id, report ORDER BY line, tags) = 1) SELECT id, arg_max(status, report) AS status, arg_max(line, report) AS line, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM o GROUP BY id")
def merge_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    r = f.selectExpr("id", "1 as report", "'open' as status", "start_line as line", "array(rule_id) as tags").union(f.where("start_line % 2 = 0").selectExpr("id", "2", "'fixed'", "start_line + 1", "array('again', rule_id)"))
    first = Window.partitionBy("id", "report").orderBy("line", F.array_join("tags", ","))
    r = r.withColumn("n", F.row_number().over(first)).where("n = 1")
    return incremental.merge_reports(r).select("id", "status", "line", F.array_join("tags", ",").alias("tags"))


@query("WITH n AS (SELECT c_custkey AS path, c_acctbal AS stamp FROM customer WHERE c_custkey % 5 <> 0), t AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS stamp FROM customer WHERE c_custkey % 6 <> 0) SELECT coalesce(n.path, t.path) AS path, CASE WHEN t.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS why FROM n FULL JOIN t ON n.path = t.path WHERE t.path IS NULL OR n.path IS NULL OR n.stamp <> t.stamp")
def stale_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as path", "c_acctbal as stamp")
    then = c.where("path % 6 <> 0").withColumn("stamp", F.when(F.col("path") % 7 == 0, 0.0).otherwise(F.col("stamp")))
    return incremental.stale(c.where("path % 5 <> 0"), then)


@query("SELECT event_id AS id, 'v' || event_type AS verdict FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'w' || user_id FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 0")
def append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    known = e.where("event_id % 3 = 0").selectExpr("event_id as id", "concat('v', event_type) as verdict")
    return incremental.upsert_once(known, e.where("event_id % 2 = 0").selectExpr("event_id as id", "concat('w', user_id) as verdict", "event_id as seq"))


@query("SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events")
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.stream(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return streams.run(rows)


@query("WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, value FROM events), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM e, m WHERE start + INTERVAL 1 HOUR <= mark GROUP BY start, event_type")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.run(streams.window_counts(streams.stream(spark, sf_dir, "events")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.stream(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    return streams.run(streams.once(rows, ["user_id", "event_type"], "3650 days")).select("user_id", "event_type")


@query()
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.stream(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return streams.run(streams.limit_rate(rows, "user_id", 2, 864_000))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def top_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderpriority").limit(3)


@query("SELECT page_id, 'x' AS kind FROM pages WHERE page_id < 0 UNION ALL SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) FROM pages")
def url_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("kind"))


