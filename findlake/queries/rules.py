"""Rule packs, governance, ground truth at several grains, and further reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.functions.stats import Z95
from findlake.operators import graph as graphs
from findlake.operators import measure, rules
from findlake.operators.matching import longest_prefix
from findlake.plans.registry import query
from findlake.queries.base import FILES_SQL, FINDINGS_SQL, RUN_SQL, files, findings, relation, table, values, with_status
from findlake.queries.graph import GRAPH_SQL, _graph
from findlake.queries.identity import OUTCOMES
from findlake.queries.measure import VOTES_SQL, votes

FAILURES = [("F1", "open", ["en/0.txt", "x"], ["t/1"]), ("F2", "open", ["de/5.txt"], ["en/10.txt"]), ("F3", "fixed", ["a"], ["t/none", "en/1.txt"]), ("F4", "open", ["nowhere"], []), ("F5", "fixed", ["b"], ["en/7.txt"])]
HOUSE = [{"id": "H1", "type": "file_exists", "path": "README.md"}, {"id": "H2", "type": "file_absent", "path": "de/1*.txt"}, {"id": "H3", "type": "content_match", "path": "**/*.txt", "pattern": "Licen[sc]e"}, {"id": "H4", "type": "metric_threshold", "path": "fr/*", "max": 12}, {"id": "H5", "type": "file_exists", "path": "en/*"}]
FLOW = [("in", "a", False), ("a", "b", False), ("b", "c", True), ("b", "d", False), ("d", "e", False), ("e", "a", False), ("p", "q", False), ("q", "c", False)]
SEEDS = [("in", "taint"), ("p", "derived"), ("q", "unknown"), ("z", "clean")]
LOCK = [("go.mod", "github.com/a/b"), ("go.mod", "golang.org/x")]
GO = [("m.go", "github.com/a/b/sub"), ("m.go", "github.com/c/d"), ("m.go", "golang.org/x/net"), ("n.go", "golang.org/xtra")]
CASES = [("T001", "sqli", True, 89), ("T002", "xss", False, 79), ("T003", "sqli", True, 564), ("T004", "xss", True, 79)]
HITS = [("src/T001.java", ["CWE-89"]), ("src/T002.java", ["CWE-79"]), ("lib/T003.java", ["CWE-89"]), ("src/T004x.java", ["CWE-79"])]
ALIASES = [(564, 89)]


@query(f"""WITH {FINDINGS_SQL}, c AS (SELECT repo_id, path, rule_id AS kind, start_line AS a, start_line + length(evidence) % 3 AS b FROM findings), h AS (SELECT repo_id, path, a, max(b) AS b FROM c WHERE kind = 'privacy/ipv4' AND path NOT LIKE 'es/%' GROUP BY ALL)
SELECT 'x/ip' AS rule_id, repo_id, path, a AS start, b AS "end" FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.repo_id = h.repo_id AND c.path = h.path AND kind = 'privacy/digits' AND c.a <= h.a AND c.b >= h.b) AND NOT EXISTS (SELECT 1 FROM c WHERE c.repo_id = h.repo_id AND c.path = h.path AND kind = 'license/marker')""")
def rule_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    captures = f.select("repo_id", "path", F.substring("path", 1, 2).alias("language"), F.col("rule_id").alias("kind"), F.col("start_line").alias("start"), (F.col("start_line") + F.length("evidence") % 3).alias("end"))
    scopes = captures.limit(0).select("repo_id", "path", "start", "end")
    return rules.run_rule(captures, scopes, rules.PackRule("x/ip", "privacy/ipv4", unless_inside=("privacy/digits",), unless_in_file=("license/marker",), languages=("en", "fr", "de")))


_SCOPES = [("r", "f", 1, 10), ("r", "f", 3, 6), ("r", "f", 20, 30)]
_CAPTURES = [("r", "f", "go", "call", 4, 4), ("r", "f", "go", "call", 8, 8), ("r", "f", "go", "call", 25, 25), ("r", "f", "go", "call", 40, 40), ("r", "f", "go", "check", 5, 5), ("r", "f", "go", "check", 29, 29), ("r", "f", "go", "lock", 2, 2)]


@query("SELECT * FROM (VALUES ('s1', 4), ('s1', 25), ('s1', 40), ('s1', 8), ('s2', 25), ('s2', 4)) t(rule_id, start)")
def rule_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that needs a check in the innermost scope, and one that must have no lock there."""
    captures = relation(spark, _CAPTURES, "repo_id string, path string, language string, kind string, start long, end long")
    scopes = relation(spark, _SCOPES, "repo_id string, path string, start long, end long")
    one = rules.run_rule(captures, scopes, rules.PackRule("s1", "call", requires_in_scope=("check",)))
    two = rules.run_rule(captures, scopes, rules.PackRule("s2", "call", unless_in_scope=("lock",)))
    return one.union(two).select("rule_id", "start")


@query(f"WITH {FILES_SQL} SELECT 'H1' AS id, 'README.md' AS path UNION ALL SELECT 'H2', path FROM files WHERE regexp_matches(path, '^de/1[^/]*\\.txt$') UNION ALL SELECT 'H3', path FROM files WHERE regexp_matches(content, 'Licen[sc]e') UNION ALL SELECT 'H4', path FROM files WHERE path LIKE 'fr/%' AND len(string_split(content, chr(10))) > 12")
def house_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.house_rules(files(spark, sf_dir), HOUSE)


@query("SELECT * FROM (VALUES ('missing one'), ('Other')) t(ref)")
def reference_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = relation(spark, [("first-part",), ("FIRST PART",), ("missing one",), ("Other",)], "ref string")
    return rules.reference_integrity(refs, relation(spark, [("First Part",), ("second",)], "anchor string"))


@query(f"WITH {FILES_SQL}, changed AS (SELECT path FROM files WHERE doc_id % 5 = 0), {values('f', FAILURES[:3] + FAILURES[4:], 'id, status, paths, tests')}, p AS (SELECT DISTINCT id FROM (SELECT id, unnest(paths) AS path FROM f WHERE status = 'open') JOIN changed USING (path)), t AS (SELECT DISTINCT id FROM (SELECT id, unnest(tests) AS path FROM f) JOIN changed USING (path)) SELECT id FROM p WHERE id NOT IN (FROM t) UNION ALL SELECT id || ' ' || path FROM (SELECT id, unnest(tests) AS path FROM f WHERE status = 'fixed') WHERE path NOT IN (SELECT path FROM files)")
def governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = relation(spark, FAILURES, "id string, status string, paths array<string>, tests array<string>")
    there = files(spark, sf_dir)
    late = rules.missing_tests(f, there).select(F.concat_ws(" ", "id", "path").alias("id"))
    return rules.untested_failures(f, there.where("doc_id % 5 = 0")).union(late)


@query("SELECT * FROM (VALUES ('in', 'taint'), ('a', 'taint'), ('b', 'taint'), ('d', 'taint'), ('e', 'taint'), ('p', 'derived'), ('q', 'unknown'), ('c', 'unknown'), ('z', 'clean')) t(node, state)")
def taint_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.taint(relation(spark, FLOW, "source string, target string, cleans boolean"), relation(spark, SEEDS, "node string, state string"), 6)


@query(f"WITH {values('o', OUTCOMES, 'name, status, applicable, dimensions, checks')} SELECT name, applicable AS in_denominator, applicable AND status = 'skipped' AS prevented FROM o")
def applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.applicability(relation(spark, OUTCOMES, "name string, status string, applicable boolean, dimensions array<string>, checks int"))


_RUNS = [("a", True, 5, 0.0, 0, 0.9), ("b", False, 0, 0.0, 0, 0.9), ("c", False, 9, 0.5, 0, 0.9), ("d", False, 9, 0.1, 2, 0.9), ("e", False, 9, 0.1, 0, 0.3), ("f", False, 9, 0.1, 0, 0.8)]


@query("SELECT * FROM (VALUES ('a', 'partial'), ('b', 'nothing_read'), ('c', 'files_not_read'), ('d', 'unassessed_languages'), ('e', 'coverage'), ('f', NULL)) t(run, reason)")
def withheld_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relation(spark, _RUNS, "run string, partial boolean, files_read int, skipped_share double, unassessed int, coverage double")
    return r.select("run", rules.withheld({c: F.col(c) for c in r.columns}).alias("reason"))


@query(f"WITH {values('imp', GO, 'path, module')}, {values('dec', LOCK, 'file, prefix')} SELECT path, module FROM imp WHERE NOT EXISTS (SELECT 1 FROM dec WHERE module = prefix OR starts_with(module, prefix || '/'))")
def undeclared_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports without a declared module above them: every ancestor of the import is one row of an anti join."""
    imports = relation(spark, GO, "path string, module string").withColumn("n", F.monotonically_increasing_id())
    parts = F.split("module", "/")
    up = imports.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("prefix"))
    known = up.join(relation(spark, LOCK, "file string, prefix string"), "prefix", "left_semi").select("n").distinct()
    return imports.join(known, "n", "left_anti").select("path", "module")


@query("SELECT * FROM (VALUES ('T001', true, true), ('T002', false, true), ('T003', true, true), ('T004', true, false)) t(name, real, flagged)")
def benchmark_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case is flagged by a finding in its file with its weakness or an alias of it."""
    cases = relation(spark, CASES, "name string, category string, real boolean, cwe int")
    also = relation(spark, ALIASES, "cwe int, other int")
    wanted = cases.select("name", "cwe").union(cases.join(also, "cwe").select("name", F.col("other")))
    hits = relation(spark, HITS, "path string, cwes array<string>").select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("name"), F.explode("cwes").alias("c")).select("name", F.regexp_extract("c", r"(\d+)", 1).cast("int").alias("cwe"))
    flagged = wanted.join(hits, ["name", "cwe"], "left_semi").select("name").distinct().withColumn("flagged", F.lit(True))
    return cases.join(flagged, "name", "left").select("name", "real", F.coalesce("flagged", F.lit(False)).alias("flagged"))


@query(f"""WITH {FINDINGS_SQL}, hunks AS (SELECT repo_id, path, doc_id % 7 + 1 AS a, doc_id % 7 + 2 AS b FROM files WHERE doc_id % 2 = 0), m AS (SELECT h.path, split_part(h.path, '/', 1) AS language, bool_or(f.start_line BETWEEN a - 3 AND b + 3) AS hunk, bool_or(f.start_line BETWEEN a - 8 AND b + 8) AS fn, count(f.id) > 0 AS file FROM hunks h LEFT JOIN findings f ON f.repo_id = h.repo_id AND f.path = h.path GROUP BY h.path)
SELECT coalesce(language, 'all') AS language, count(*) AS pairs, count(*) FILTER (coalesce(hunk, false)) AS hunk, count(*) FILTER (coalesce(fn, false)) AS function, count(*) FILTER (file) AS file FROM m GROUP BY ROLLUP (language)""")
def region_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a finding meets a changed region at the grain of its hunk, its surroundings and its file, per language and over all."""
    h = files(spark, sf_dir).where("doc_id % 2 = 0").selectExpr("repo_id as r", "path as p", "doc_id % 7 + 1 as a", "doc_id % 7 + 2 as b")
    f = findings(spark, sf_dir).select("repo_id", "path", "start_line")
    near = lambda t: F.coalesce(F.bool_or((F.col("start_line") >= F.col("a") - t) & (F.col("start_line") <= F.col("b") + t)), F.lit(False))
    m = h.join(f, (F.col("repo_id") == F.col("r")) & (F.col("path") == F.col("p")), "left").groupBy("p").agg(near(3).alias("hunk"), near(8).alias("fn"), (F.count("path") > 0).alias("file"))
    out = m.withColumn("language", F.split_part("p", F.lit("/"), F.lit(1))).rollup("language").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("hunk").alias("hunk"), F.count_if("fn").alias("function"), F.count_if("file").alias("file"))
    return out.withColumn("language", F.coalesce("language", F.lit("all")))


@query(f"WITH {VOTES_SQL} SELECT doc_id, CASE WHEN r1 = r2 AND coalesce(r3, r1) = r1 THEN CASE r1 WHEN 1 THEN 'tp' ELSE 'fp' END ELSE 'split' END AS verdict FROM votes")
def panel_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = F.array_distinct(F.array_compact(F.array("r1", "r2", "r3")))
    return votes(spark, sf_dir).select("doc_id", F.when(F.size(decided) == 1, F.when(F.element_at(decided, 1) == 1, "tp").otherwise("fp")).otherwise("split").alias("verdict"))


@query(f"WITH {VOTES_SQL} SELECT rule_id, count(*) AS labelled, count(r3) AS decided, count(*) - count(r3) AS abstained, round(sum(r3) / nullif(count(r3), 0), 4) AS precision FROM votes GROUP BY rule_id")
def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("r3")
    return votes(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("labelled"), n.alias("decided"), (F.count(F.lit(1)) - n).alias("abstained"), F.round(F.sum("r3") / F.when(n > 0, n), 4).alias("precision"))


@query(f"WITH {FINDINGS_SQL}, before AS (SELECT rule_id, path, start_line FROM findings WHERE start_line % 3 <> 1), after AS (SELECT rule_id, path FROM findings WHERE start_line % 3 = 1) SELECT rule_id, path, count(*) AS gone FROM before b WHERE path IN (SELECT path FROM files WHERE doc_id % 4 <> 0) AND NOT EXISTS (SELECT 1 FROM after a WHERE a.rule_id = b.rule_id AND a.path = b.path) GROUP BY ALL")
def fix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).select("rule_id", "path", "start_line")
    after = f.where("start_line % 3 = 1").select("rule_id", "path").distinct()
    there = files(spark, sf_dir).where("doc_id % 4 <> 0").select("path")
    return f.where("start_line % 3 <> 1").join(after, ["rule_id", "path"], "left_anti").join(there, "path", "left_semi").groupBy("rule_id", "path").agg(F.count(F.lit(1)).alias("gone"))


@query(f"WITH {FINDINGS_SQL}, a AS (SELECT 1 AS part, id, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id FROM findings WHERE severity = 'high')), b AS (SELECT 2 AS part, id, row_number() OVER (ORDER BY id DESC) AS n FROM (SELECT DISTINCT id FROM findings WHERE severity = 'low')) SELECT part, id FROM a WHERE n <= 5 UNION ALL SELECT part, id FROM b WHERE n <= 5")
def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    top = lambda part, severity, order: f.where(F.col("severity") == severity).select("id").distinct().orderBy(order).limit(5).select(F.lit(part).alias("part"), "id")
    return top(1, "high", F.col("id")).union(top(2, "low", F.desc("id")))


@query(f"WITH {RUN_SQL}, t AS (SELECT *, CASE WHEN provenance = 'inferred' THEN 'inferred' WHEN verdict = 'confirmed' THEN 'verified' ELSE 'advisory' END AS tier FROM run) SELECT tier, count(*) FILTER (NOT suppressed) AS shown, count(*) FILTER (suppressed) AS hidden FROM t GROUP BY tier")
def tier_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("provenance") == "inferred", "inferred").when(F.col("verdict") == "confirmed", "verified").otherwise("advisory")
    return with_status(findings(spark, sf_dir)).groupBy(tier.alias("tier")).agg(F.count_if(~F.col("suppressed")).alias("shown"), F.count_if("suppressed").alias("hidden"))


@query(f"WITH RECURSIVE {GRAPH_SQL}, u AS (SELECT source AS a, target AS b FROM edges WHERE type = 'delivers' UNION SELECT target, source FROM edges WHERE type = 'delivers'), b(node, hops) AS (SELECT 'o3', 0 UNION SELECT u.b, hops + 1 FROM b JOIN u ON u.a = node WHERE hops < 2) SELECT DISTINCT source, target FROM edges WHERE type = 'delivers' AND source IN (SELECT node FROM b) AND target IN (SELECT node FROM b)")
def ego_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph(spark, sf_dir)[1].where("type = 'delivers'").select("source", "target", "type")
    near = graphs.reach(e, spark.createDataFrame([("o3",)], "node string"), 2, undirected=True).select("node")
    return e.select("source", "target").distinct().join(near.withColumnRenamed("node", "source"), "source", "left_semi").join(near.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target")


@query("SELECT n_regionkey AS a, c_mktsegment AS b, count(*) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL ORDER BY weight DESC, a, b LIMIT 8")
def heaviest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))  # one row a nation
    g = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("a"), F.col("c_mktsegment").alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    return g.orderBy(F.desc("weight"), "a", "b").limit(8)


@query(f"WITH {FINDINGS_SQL} SELECT split_part(path, '/', 1) AS folder, dimension, count(*) AS n, count(DISTINCT path) AS files FROM findings GROUP BY ROLLUP (folder, dimension) HAVING folder IS NOT NULL")
def findings_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).rollup(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder"), "dimension").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files")).where("folder is not null")


_PORTS = [("s1", '{"ports": [80, 443, {"containerPort": 8080, "name": "x"}], "other": 5}'), ("s2", '{"spec": {"port": 443}, "list": []}')]


@query("SELECT * FROM (VALUES ('s1', 80), ('s1', 443), ('s1', 8080), ('s2', 443)) t(service, port)")
def collected_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers under names of ports, at any depth: every key and value pair of the text of a parsed document."""
    d = relation(spark, _PORTS, "service string, doc string")
    single = F.regexp_extract_all("doc", F.lit(r'"[A-Za-z]*[pP]orts?": *(\d+)'), 1)
    listed = F.regexp_replace(F.array_join(F.regexp_extract_all("doc", F.lit(r'"[A-Za-z]*[pP]orts?": *\[([^\]]*)\]'), 1), ","), r"\{[^}]*\}", "")
    named = d.select("service", F.explode(F.concat(single, F.regexp_extract_all(listed, F.lit(r"(\d+)"), 1))).alias("port"))
    return named.select("service", F.col("port").cast("int").alias("port"))


@query(f"WITH {FINDINGS_SQL}, s AS (SELECT rule_id, repo_id, id, start_line, row_number() OVER (PARTITION BY rule_id, repo_id ORDER BY sha256(id || '|' || start_line), id) AS turn, count(*) OVER (PARTITION BY rule_id, repo_id) AS n FROM findings) SELECT rule_id, repo_id, id, start_line, round(n / least(n, 3), 6) AS weight FROM s WHERE turn <= 3")
def capped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three of each cell in hash order, each standing for its share of the cell."""
    cell = Window.partitionBy("rule_id", "repo_id")
    draw = F.sha2(F.concat_ws("|", "id", F.col("start_line").cast("string")), 256)
    s = findings(spark, sf_dir).withColumn("turn", F.row_number().over(cell.orderBy(draw, "id"))).withColumn("n", F.count(F.lit(1)).over(cell))
    return s.where("turn <= 3").select("rule_id", "repo_id", "id", "start_line", F.round(F.col("n") / F.least(F.col("n"), F.lit(3)), 6).alias("weight"))


@query(f"WITH {VOTES_SQL}, g AS (SELECT rule_id, sum(y) AS tp, sum(1 - y) AS fp FROM votes GROUP BY rule_id), p AS (SELECT lang AS rule_id, count(*) AS population FROM documents GROUP BY lang) SELECT doc_id, rule_id, population FROM votes JOIN p USING (rule_id)")
def label_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the size of what they were drawn from; nothing else of a label may change."""
    before = votes(spark, sf_dir)
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("rule_id")).agg(F.count(F.lit(1)).alias("population"))
    after = before.join(sizes, "rule_id")
    return after.select("doc_id", "rule_id", "population")


@query(f"WITH {FINDINGS_SQL}, e AS (SELECT rule_id, id, row_number() OVER (PARTITION BY rule_id ORDER BY id) AS n FROM (SELECT DISTINCT rule_id, id FROM findings)) SELECT rule_id, string_agg(id, ',' ORDER BY id) AS evidence FROM e WHERE n <= 20 GROUP BY rule_id")
def capped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("rule_id").orderBy("id")
    e = findings(spark, sf_dir).select("rule_id", "id").distinct().withColumn("n", F.row_number().over(w)).where("n <= 20")
    return e.groupBy("rule_id").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("evidence"))


#: Square of the normal quantile of the 95 per cent interval.
Z2 = Z95**2


@query(f"WITH {VOTES_SQL}, g AS (SELECT rule_id, sum(y)::INT AS tp, sum(1 - y)::INT AS fp FROM votes GROUP BY rule_id) SELECT rule_id, tp, fp, tp + fp < 30 AS thin, coalesce((SELECT min(k) FROM range(0, 2001) t(k) WHERE ((tp + k)::DOUBLE / (tp + fp + k) + {Z2} / (2 * (tp + fp + k)) - sqrt({Z2} * ((tp + k)::DOUBLE / (tp + fp + k) * (1 - (tp + k)::DOUBLE / (tp + fp + k)) / (tp + fp + k) + {Z2} / (4.0 * (tp + fp + k) * (tp + fp + k))))) / (1 + {Z2} / (tp + fp + k)) >= 0.97), -1)::INT AS needed FROM g")
def label_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = votes(spark, sf_dir).groupBy("rule_id").agg(F.sum("y").cast("int").alias("tp"), F.sum(1 - F.col("y")).cast("int").alias("fp"))
    return g.withColumn("needed", measure.labels_needed(F.col("tp"), F.col("fp"), 0.97)).orderBy(F.col("needed").asc_nulls_last(), "rule_id").select("rule_id", "tp", "fp", (F.col("tp") + F.col("fp") < 30).alias("thin"), F.coalesce("needed", F.lit(-1)).cast("int").alias("needed"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_type, 'PROMO') THEN 0.1 ELSE 1.0 END::DOUBLE AS budget FROM part")
def part_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_prefix(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", relation(spark, [("PROMO", 0.1)], "prefix string, budget double"), "budget", 1.0).select("p_partkey", "budget")
