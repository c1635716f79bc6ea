"""Matching joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findlake.functions.text import jaccard, route, snake_case, words
from findlake.operators import matching
from findlake.operators.policy import first_by
from findlake.plans.registry import query
from findlake.queries.base import FILES_SQL, FINDINGS_SQL, RUN_SQL, files, findings, relation, table, values, with_status

BUDGETS = [("privacy/", 0.5), ("privacy/e", 0.1), ("secret/assigned-token", 0.01), ("s", 9.0)]
FAMILIES = [("*", "privacy/*", "privacy"), ("secrets", "secret/*", "hardcoded-secret"), ("*", "*word*", "weak-secret")]
SPANS = "SELECT repo_id, path, start_line, start_line + 2 AS end_line, rule_id, id AS name FROM findings WHERE rule_id LIKE 'privacy/%'"
RESOURCES = [
    ("r1", "aws_s3_bucket.logs", "src/main.tf", False, "acl=private"), ("r1", "aws_s3_bucket.logs", "tfplan.json", True, "acl=public"), ("r1", "aws_s3_bucket.data[0]", "tfplan.json", True, "x=1"),
    ("r1", "aws_s3_bucket.data", "src/data.tf", False, "x=?"), ("r1", "aws_iam_role.app", "src/iam.tf", False, "y=2"), ("r2", "aws_s3_bucket.logs", "other/main.tf", False, "acl=none"), ("r1", "module.net.aws_vpc.main[\"a\"]", "tfplan.json", True, "z=3"),
]
SIBLINGS = [("bucket.a", "aws_s3_bucket", {"acl": "public"}, None), ("bucket.b", "aws_s3_bucket", {"acl": "private"}, None), ("block.a", "aws_s3_public_access_block", {"block": "true", "acl": "log"}, "bucket.a"), ("enc.a", "aws_s3_encryption", {"sse": "aes"}, "bucket.a"), ("orphan", "aws_s3_encryption", {"sse": "kms"}, "bucket.z")]
SIBLINGS_SQL = ", ".join(f"('{a}', '{n}', map {{{', '.join(f"'{k}': '{v}'" for k, v in p.items())}}}, {'NULL' if r is None else repr(r)})" for a, n, p, r in SIBLINGS)
ASSERTS = [
    ("a1", '{"encrypted": true, "acl": "private", "port": 22}', []), ("a2", '{"encrypted": "false", "acl": "public-read"}', []), ("a3", '{"acl": "public-read"}', ["encrypted"]),
    ("a4", '{"Encrypted": "on", "note": "open to 0.0.0.0/0"}', []), ("a5", '{}', []), ("a6", '{"encrypted": "yes", "acl": null}', ["acl"]),
]
SYMBOLS = [("f", "m1", "c1", "m1.c1.f"), ("f", "m1", None, "m1.f"), ("g", "m1", None, "m1.g"), ("g", "m2", None, "m2.g"), ("h", "m3", None, "m3.h"), ("u", "m2", None, "m2.u"), ("u", "m3", None, "m3.u")]
REFERENCES = [("r1", "f", "m1", "c1", "m2"), ("r2", "f", "m1", None, "m2"), ("r3", "g", "m3", None, "m2"), ("r4", "h", "m1", None, None), ("r5", "u", "m1", None, None), ("r6", "zzz", "m1", None, "m2"), ("r7", "g", "m1", "c1", "m2")]
SPEC = [("get", "/users/{id}"), ("get", "/users"), ("post", "/orders/{orderId}/items/"), ("delete", "/Users/:id"), ("get", "/health")]
ROUTES = [("get", "/users/:userId"), ("get", "/users/"), ("post", "/orders/<int:id>/items"), ("get", "/metrics")]
CLAIMS = [("iso", "en/5.txt"), ("iso", "en/3.txt"), ("soc", "docs/none.md")]


@query(f"WITH {FINDINGS_SQL} SELECT id, path FROM findings WHERE path IN (SELECT path FROM files WHERE doc_id % 2 = 0)")
def in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.in_scope(findings(spark, sf_dir), files(spark, sf_dir).where("doc_id % 2 = 0")).select("id", "path")


@query(f"WITH {FINDINGS_SQL}, {values('budgets', BUDGETS, 'prefix, budget')}, r AS (SELECT DISTINCT rule_id FROM findings), b AS (SELECT rule_id, arg_max(budget, length(prefix)) AS budget FROM r JOIN budgets ON starts_with(rule_id, prefix) GROUP BY rule_id) SELECT id, rule_id, coalesce(budget, 1.5)::DOUBLE AS budget FROM findings LEFT JOIN b USING (rule_id)")
def budget_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.longest_prefix(findings(spark, sf_dir), "rule_id", relation(spark, BUDGETS, "prefix string, budget double"), "budget", 1.5).select("id", "rule_id", "budget")


@query(f"WITH {FINDINGS_SQL} SELECT id, rule_id, CASE WHEN rule_id LIKE 'privacy/%' THEN 'privacy' WHEN probe = 'secrets' AND rule_id LIKE 'secret/%' THEN 'hardcoded-secret' WHEN rule_id LIKE '%word%' THEN 'weak-secret' END AS family FROM findings")
def cwe_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.lit(None).cast("string")
    for detector, pattern, family in reversed(FAMILIES):
        on = F.col("rule_id").like(pattern.replace("*", "%"))
        out = F.when(on if detector == "*" else on & (F.col("probe") == detector), F.lit(family)).otherwise(out)
    return findings(spark, sf_dir).select("id", "rule_id", out.alias("family"))




@query(f"""WITH RECURSIVE {FINDINGS_SQL}, d AS (SELECT repo_id, path, dimension AS family, probe AS detector, start_line AS line FROM findings),
a AS (SELECT repo_id, path, family, min(line) AS anchor FROM d GROUP BY ALL UNION ALL
  SELECT d.repo_id, d.path, d.family, min(line) FROM a JOIN d USING (repo_id, path, family) WHERE line > anchor + 3 GROUP BY d.repo_id, d.path, d.family, anchor),
p AS (SELECT d.*, (SELECT max(anchor) FROM a WHERE a.repo_id = d.repo_id AND a.path = d.path AND a.family = d.family AND anchor <= line) AS anchor FROM d)
SELECT repo_id, path, family, anchor, array_to_string(list_sort(list_distinct(list(detector))), ',') AS detectors, count(*) AS members FROM p GROUP BY repo_id, path, family, anchor""")
def site_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = findings(spark, sf_dir).select("repo_id", "path", F.col("dimension").alias("family"), F.col("probe").alias("detector"), F.col("start_line").alias("line"))
    return matching.cluster_sites(d, ["repo_id", "path", "family"]).withColumn("detectors", F.array_join("detectors", ","))


@query(f"WITH {FINDINGS_SQL}, spans AS ({SPANS}) SELECT f.id, s.name FROM findings f JOIN spans s ON f.repo_id = s.repo_id AND f.path = s.path AND f.start_line BETWEEN s.start_line AND s.end_line AND f.id <> s.name")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    points = rows.select("id", "repo_id", "path", F.col("start_line").alias("line"))
    spans = rows.where("rule_id like 'privacy/%'").select("repo_id", "path", "start_line", (F.col("start_line") + 2).alias("end_line"), F.col("id").alias("name"))
    return matching.inside(points, spans, ["repo_id", "path"]).where("id <> name").select("id", "name")


@query(f"WITH {FINDINGS_SQL}, p AS (SELECT DISTINCT repo_id, path, start_line AS line FROM findings), s AS (SELECT repo_id, path, start_line, start_line + length(id) % 5 + (ascii(substr(id, 3)) % 7) AS end_line, id AS name FROM findings WHERE dimension = 'compliance'), b AS (SELECT p.repo_id, p.path, line, arg_min(name, (end_line - start_line, start_line, name)) AS name FROM p JOIN s ON p.repo_id = s.repo_id AND p.path = s.path AND line BETWEEN start_line AND end_line GROUP BY ALL) SELECT p.repo_id, p.path, p.line, name FROM p LEFT JOIN b ON p.repo_id = b.repo_id AND p.path = b.path AND p.line = b.line")
def innermost_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    spans = rows.where("dimension = 'compliance'").selectExpr("repo_id", "path", "start_line", "start_line + length(id) % 5 + (ascii(substr(id, 3)) % 7) as end_line", "id as name")
    return matching.innermost(rows.select("repo_id", "path", F.col("start_line").alias("line")).distinct(), spans, ["repo_id", "path"])


@query(f"""WITH {FINDINGS_SQL}, defects AS (SELECT 'd' || doc_id AS defect, repo_id, path, doc_id % 9 + 1 AS start_line, doc_id % 9 + 3 AS end_line, CASE WHEN doc_id % 2 = 0 THEN ['compliance'] ELSE ['security', 'quality'] END AS kinds FROM files)
SELECT defect, count(f.id) AS hits, count(f.id) > 0 AS found FROM defects d LEFT JOIN findings f ON f.repo_id = d.repo_id AND f.path = d.path AND f.start_line BETWEEN d.start_line - 2 AND d.end_line + 2 AND list_contains(d.kinds, f.dimension) GROUP BY defect""")
def defect_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    defects = files(spark, sf_dir).selectExpr("concat('d', doc_id) as defect", "repo_id", "path", "doc_id % 9 + 1 as start_line", "doc_id % 9 + 3 as end_line", "case when doc_id % 2 = 0 then array('compliance') else array('security', 'quality') end as kinds")
    points = findings(spark, sf_dir).select("id", "repo_id", "path", F.col("start_line").alias("line"), "dimension")
    hit = F.count_if(F.coalesce(F.array_contains("kinds", F.col("dimension")), F.lit(False)))
    return matching.inside(points, defects, ["repo_id", "path"], 2, "right").groupBy("defect").agg(hit.alias("hits"), (hit > 0).alias("found"))


@query(f"WITH {values('r', RESOURCES, 'repo_id, address, source, planned, props')}, b AS (SELECT *, regexp_replace(address, '\\[[^\\]]*\\]', '', 'g') AS base FROM r), o AS (SELECT repo_id, base, min(source) AS origin FROM b WHERE NOT planned GROUP BY ALL) SELECT p.repo_id, address, coalesce(origin, source) AS source, planned, props FROM b p LEFT JOIN o USING (repo_id, base) WHERE planned UNION ALL SELECT repo_id, address, source, planned, props FROM b s WHERE NOT planned AND NOT EXISTS (SELECT 1 FROM b p WHERE p.planned AND p.repo_id = s.repo_id AND p.base = s.base)")
def plan_over_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.merge_plan_over_source(relation(spark, RESOURCES, "repo_id string, address string, source string, planned boolean, props string"))


@query(f"WITH r(address, native, properties, refers) AS (VALUES {SIBLINGS_SQL}), e AS (SELECT p.address, 1 AS prio, '' AS child, unnest(map_entries(p.properties)) AS kv FROM r p UNION ALL SELECT p.address, 2, c.address, unnest(map_entries(c.properties)) FROM r p JOIN r c ON c.refers = p.address), b AS (SELECT address, kv.key AS k, arg_max(kv.value, (prio, child)) AS v FROM e GROUP BY ALL) SELECT address, string_agg(k || '=' || v, ',' ORDER BY k) AS properties FROM b GROUP BY address")
def sibling_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.fold_siblings(relation(spark, SIBLINGS, "address string, native string, properties map<string,string>, refers string"))
    entries = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("address", F.array_join(entries, ",").alias("properties"))


@query(f"""WITH a(address, props, unknown) AS (VALUES {', '.join(f"('{a}', '{p}', {u or '[]::VARCHAR[]'})" for a, p, u in ASSERTS)}), v AS (SELECT *, lower(coalesce(json_extract_string(props, '$.encrypted'), json_extract_string(props, '$.Encrypted'))) AS enc, json_extract_string(props, '$.acl') AS acl FROM a)
SELECT address, CASE WHEN list_contains(unknown, 'encrypted') THEN 'unknown' WHEN enc IN ('true', 'yes', '1', 'enabled', 'on') THEN 'satisfied' ELSE 'violated' END AS encrypted, CASE WHEN list_contains(unknown, 'acl') THEN 'unknown' WHEN acl IN ('public-read', 'public-read-write') THEN 'violated' ELSE 'satisfied' END AS acl_private, CASE WHEN contains(props, '0.0.0.0/0') THEN 'violated' ELSE 'satisfied' END AS no_open_ingress FROM v""")
def resource_asserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, ASSERTS, "address string, props string, unknown array<string>").withColumn("v", F.parse_json("props"))
    get = lambda path: F.try_variant_get("v", path, "string")
    undecided = lambda name: F.array_contains("unknown", name)
    truthy = F.lower(F.coalesce(get("$.encrypted"), get("$.Encrypted"))).isin("true", "yes", "1", "enabled", "on")
    state = lambda name, ok: F.when(undecided(name), "unknown").when(ok, "satisfied").otherwise("violated")
    private = ~F.coalesce(get("$.acl").isin("public-read", "public-read-write"), F.lit(False))
    return rows.select("address", state("encrypted", truthy).alias("encrypted"), state("acl", private).alias("acl_private"), F.when(F.contains("props", F.lit("0.0.0.0/0")), "violated").otherwise("satisfied").alias("no_open_ingress"))


@query("SELECT p_brand AS name, count(DISTINCT p_size) AS values, count(DISTINCT p_type) AS owners FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) > 1 AND count(DISTINCT p_type) > 1")
def conflicting_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.conflicting(table(spark, sf_dir, "part").withColumn("name", F.col("p_brand")), ["name"], "p_type", "p_size")


@query("SELECT DISTINCT c_nationkey AS nation, 'read not provided' AS what FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) UNION ALL SELECT DISTINCT s_nationkey, 'provided not read' FROM supplier WHERE s_suppkey % 3 = 0 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 40 = 0)")
def unmatched_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey"))
    given = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("nation")).distinct()
    one = read.select("nation").distinct().join(given, "nation", "left_anti").withColumn("what", F.lit("read not provided"))
    return one.union(given.join(read.where("c_custkey % 40 = 0"), "nation", "left_anti").withColumn("what", F.lit("provided not read")))


_ROUTE = "CASE WHEN rtrim(lower(regexp_replace(path, '\\{[^}]*\\}|<[^>]*>|:[A-Za-z_]\\w*', '{}', 'g')), '/') = '' THEN '/' ELSE rtrim(lower(regexp_replace(path, '\\{[^}]*\\}|<[^>]*>|:[A-Za-z_]\\w*', '{}', 'g')), '/') END"


@query(f"WITH {values('spec', SPEC, 'method, path')}, {values('routes', ROUTES, 'method, path')}, s AS (SELECT method, {_ROUTE} AS r FROM spec), x AS (SELECT method, {_ROUTE} AS r FROM routes) SELECT *, 'undocumented' AS what FROM (FROM x EXCEPT FROM s) UNION ALL SELECT *, 'unimplemented' FROM (FROM s EXCEPT FROM x)")
def spec_against_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, x = (relation(spark, rows, "method string, path string").select("method", route(F.col("path")).alias("r")).distinct() for rows in (SPEC, ROUTES))
    return x.join(s, ["method", "r"], "left_anti").withColumn("what", F.lit("undocumented")).union(s.join(x, ["method", "r"], "left_anti").withColumn("what", F.lit("unimplemented")))


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+/', '') AS path FROM pages), folders AS (SELECT DISTINCT regexp_extract(path, '^([^/]+)/', 1) AS folder FROM u WHERE page_id % 3 = 0), up AS (SELECT page_id, path, folder FROM u JOIN folders ON path LIKE folder || '/%')
SELECT u.page_id, arg_max(folder, length(folder)) AS folder FROM u LEFT JOIN up USING (page_id) GROUP BY u.page_id""")
def nearest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]+/", "").alias("path"))
    folders = u.where("page_id % 3 = 0").select(F.regexp_extract("path", "^([^/]+)/", 1).alias("folder")).where("folder <> ''").distinct()
    return matching.nearest_ancestor(u, "path", folders, "folder").select("page_id", "folder")


_REF = "WITH {}, {}, t AS (SELECT ref, target, 'class' AS how, 0 AS k FROM refs r JOIN symbols s ON s.name = r.name AND s.module = r.module AND s.class = r.class UNION ALL SELECT ref, min(target), 'module', 1 FROM refs r JOIN symbols s ON s.name = r.name AND s.module = r.module AND s.class IS NULL GROUP BY ref HAVING count(DISTINCT target) = 1 UNION ALL SELECT ref, min(target), 'import', 2 FROM refs r JOIN symbols s ON s.name = r.name AND s.module = r.imports AND s.class IS NULL GROUP BY ref HAVING count(DISTINCT target) = 1 UNION ALL SELECT ref, min(target), 'unique', 3 FROM refs r JOIN symbols s ON s.name = r.name GROUP BY ref HAVING count(DISTINCT target) = 1), b AS (SELECT ref, arg_min(target, k) AS target, arg_min(how, k) AS how FROM t GROUP BY ref) SELECT refs.ref, b.target, coalesce(b.how, 'unresolved') AS how FROM refs LEFT JOIN b USING (ref)"


@query(_REF.format(values("symbols", SYMBOLS, "name, module, class, target"), values("refs", REFERENCES, "ref, name, module, class, imports")))
def symbol_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = relation(spark, SYMBOLS, "name string, module string, class string, target string")
    refs = relation(spark, REFERENCES, "ref string, name string, module string, class string, imports string")
    top = symbols.where("class is null")
    return matching.fall_back(refs, [("class", symbols.where("class is not null"), ["name", "module", "class"]), ("module", top, ["name", "module"]), ("import", top.withColumnRenamed("module", "imports"), ["name", "imports"]), ("unique", symbols, ["name"])])


@query("""WITH n AS (SELECT n_nationkey, lower(regexp_replace(n_name, '([^^])([A-Z])', '\\1\\2', 'g')) AS t FROM nation), c AS (SELECT c_custkey, c_nationkey FROM customer)
SELECT t AS entity, count(*) AS uses FROM c JOIN n ON c_nationkey = n_nationkey GROUP BY t""")
def entity_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", snake_case(F.lower("n_name")).alias("entity"))
    uses = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return uses.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("entity").agg(F.sum("n").alias("uses"))


@query(f"WITH {FILES_SQL}, {values('claims', CLAIMS, 'framework, path')} SELECT framework, path, files.path IS NOT NULL AS there FROM claims LEFT JOIN files USING (path)")
def document_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = files(spark, sf_dir).select("path").distinct().withColumn("there", F.lit(True))
    return relation(spark, CLAIMS, "framework string, path string").join(there, "path", "left").select("framework", "path", F.coalesce("there", F.lit(False)).alias("there"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages), known AS (SELECT DISTINCT target FROM l WHERE page_id % 2 = 0) SELECT page_id, target FROM l WHERE page_id % 2 = 1 AND target NOT IN (FROM known)""")
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("target"))
    return links.where("page_id % 2 = 1").join(links.where("page_id % 2 = 0").select("target").distinct(), "target", "left_anti").select("page_id", "target")


@query("""WITH s AS (SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber % 2 = 1), e AS (SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT e.l_orderkey, e.l_linenumber, e.l_partkey, (SELECT arg_max(s.l_quantity, (s.l_shipdate, s.l_orderkey, s.l_linenumber)) FROM s WHERE s.l_partkey = e.l_partkey AND s.l_shipdate <= e.l_shipdate) AS quantity FROM e""")
def as_of_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot at or before each event, by a running last value instead of a range join. Odd lines are snapshots, even ones events."""
    lines = table(spark, sf_dir, "lineitem").withColumn("event", (F.col("l_linenumber") % 2 == 0).cast("int"))
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "event", "l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    found = lines.withColumn("quantity", F.last(F.when(F.col("event") == 0, F.col("l_quantity")), True).over(w))
    return found.where("event = 1").select("l_orderkey", "l_linenumber", "l_partkey", "quantity")


@query(f"WITH {FINDINGS_SQL}, changed AS (SELECT path, list(DISTINCT 'REQ-' || doc_id % 5) AS reqs FROM files WHERE doc_id % 3 = 0 GROUP BY path) SELECT id, array_to_string(list_sort(coalesce(reqs, ['REQ-global'])), ',') AS requirements FROM findings LEFT JOIN changed USING (path)")
def requirement_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = files(spark, sf_dir).where("doc_id % 3 = 0").groupBy("path").agg(F.collect_set(F.concat(F.lit("REQ-"), (F.col("doc_id") % 5).cast("string"))).alias("reqs"))
    return findings(spark, sf_dir).join(by, "path", "left").select("id", F.array_join(F.array_sort(F.coalesce("reqs", F.array(F.lit("REQ-global")))), ",").alias("requirements"))


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE doc_id % 10 = 0 OR path LIKE 'de/%'")
def partial_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    changed = f.where("doc_id % 10 = 0").select("path")
    context = f.where(F.col("path").startswith("de/"))
    return f.join(changed, "path", "left_semi").select("path").union(context.select("path")).distinct()


@query(f"""WITH {FINDINGS_SQL}, s AS (SELECT repo_id, path, start_line, dimension, list_sort(list_distinct(list(probe))) AS probes, min({'CASE severity ' + ' '.join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(('critical', 'high', 'medium', 'low', 'info'))) + ' END'}) AS worst, max({'CASE severity ' + ' '.join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(('critical', 'high', 'medium', 'low', 'info'))) + ' END'}) AS best FROM findings GROUP BY ALL)
SELECT CASE WHEN len(probes) > 1 AND best - worst >= 2 THEN 'contested' WHEN len(probes) > 1 THEN 'corroborated' ELSE 'gap' END AS kind, count(*) AS sites FROM s GROUP BY 1""")
def tool_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.operators.identity import rank

    s = findings(spark, sf_dir).groupBy("repo_id", "path", "start_line", "dimension").agg(F.countDistinct("probe").alias("probes"), F.min(rank(F.col("severity"))).alias("worst"), F.max(rank(F.col("severity"))).alias("best"))
    kind = F.when((F.col("probes") > 1) & (F.col("best") - F.col("worst") >= 2), "contested").when(F.col("probes") > 1, "corroborated").otherwise("gap")
    return s.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("sites"))


@query(f"WITH {FINDINGS_SQL}, t AS (SELECT DISTINCT title, rule_id FROM findings), w AS (SELECT title, rule_id, list_distinct(list_filter(string_split_regex(lower(title || ' ' || rule_id), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'a', 'an', 'is', 'are', 'not', 'no', 'in', 'on', 'for', 'of', 'to', 'with', 'and', 'or', 'be', 'this', 'that', 'it', 'has', 'have', 'should'))) AS w FROM t) SELECT a.rule_id AS a, b.rule_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM w a JOIN w b ON a.rule_id < b.rule_id AND len(list_intersect(a.w, b.w)) > 0")
def wording_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rules whose titles share a word, found by that word."""
    w = findings(spark, sf_dir).select("title", "rule_id").distinct().select("rule_id", words(F.concat_ws(" ", "title", "rule_id")).alias("w"))
    by = w.select("rule_id", "w", F.explode("w").alias("word"))
    a, b = by.select(F.col("rule_id").alias("a"), F.col("w").alias("wa"), "word"), by.select(F.col("rule_id").alias("b"), F.col("w").alias("wb"), "word")
    return a.join(b, "word").where("a < b").select("a", "b", F.round(jaccard(F.col("wa"), F.col("wb")), 6).alias("jaccard")).distinct()


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = findings(spark, sf_dir).withColumn("seq", F.abs(F.xxhash64("id", "rule_id", "path", "start_line")))
    a = rows.where("start_line % 3 <> 0")
    b = rows.where("start_line % 4 <> 0").withColumn("id", F.when(F.col("start_line") % 5 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id"))).withColumn("start_line", F.col("start_line") + F.when(F.col("start_line") % 5 == 0, 1).otherwise(0))
    return a, b


@query()
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _arms(spark, sf_dir)
    return matching.compare(a, b)


@query()
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir).withColumn("seq", F.abs(F.xxhash64("id", "rule_id", "start_line")))
    expected = rows.where("start_line % 2 = 0").selectExpr("concat('x', id, rule_id) as item", "path", "cast(conv(substring(id, 3, 6), 16, 10) as int) as ord", "case when rule_id like 'secret/%' then 'token & assigned' else 'address' end as match", "case when rule_id like 'privacy/%' then dimension end as dimension")
    return matching.ground_truth(expected, rows.select("seq", "path", "rule_id", "title", "dimension"))


@query(f"WITH {RUN_SQL}, notes(prefix, note) AS (VALUES ('de/1', 'first German'), ('de/', 'German'), ('e', 'English or Spanish')) SELECT id, (SELECT note FROM (SELECT note, row_number() OVER () AS o, prefix FROM notes) n WHERE starts_with(path, prefix) ORDER BY o LIMIT 1) AS note FROM run")
def scope_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.lit(None).cast("string")
    for prefix, text in reversed([("de/1", "first German"), ("de/", "German"), ("e", "English or Spanish")]):
        note = F.when(F.col("path").startswith(prefix), text).otherwise(note)
    return with_status(findings(spark, sf_dir)).select("id", note.alias("note"))


@query("SELECT o_custkey, min(o_orderkey) AS first_order, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"), F.min_by("o_orderstatus", "o_orderkey").alias("status"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedup_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")
