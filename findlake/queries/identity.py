"""Extraction, identity, de-duplication, run comparison, policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions.text import entropy, glob
from findlake.operators import identity, policy
from findlake.plans.registry import query
from findlake.queries.base import FILES_SQL, FINDINGS_SQL, RANK_SQL, RUN_SQL, WEIGHT_SQL, files, findings, relation, values, with_status

COLUMNS = ["id", "base_id", "occurrence", "rule_id", "severity", "repo_id", "path", "start_line"]
OVERRIDES = [("privacy/i*", "critical"), ("privacy/*", "low"), ("license/marker", "medium")]
SUPPRESS = [
    {"rule": "privacy/*", "path": "fr/*", "reason": "accepted in French texts", "expires": "2027-01-01"},
    {"rule": "license/*", "reason": "expired", "expires": "2020-01-01"},
    {"path": "*/1*.txt", "reason": "old corpus", "expires": "2026-12-31"},
    {"rule": "secret/*", "expires": "2030-01-01"},
    {"reason": "selects nothing", "expires": "2030-01-01"},
]
TODAY = "2026-06-30"
PATTERNS = [("secret/*", "CWE-798"), ("secret/token*", "CWE-532"), ("privacy/*", "CWE-359"), ("*", "CWE-710"), ("privacy/ip*", "CWE-200")]
LEDGER = [("secret/assigned-token", 400, 0, 0.95), ("secret/token-word", 40, 3, 0.9), ("privacy/e-mail", 200, 1, 0.7), ("privacy/ipv4", 130, 0, None), ("license/marker", 12, 0, None)]
OUTCOMES = [
    ("secrets", "ran", True, ["security"], 16), ("privacy", "ran", True, ["compliance", "security"], 3), ("licenses", "ran", True, ["quality"], 1),
    ("words", "skipped", True, ["security"], 2), ("seams", "inapplicable", False, ["interface"], 6), ("drift", "error", True, ["drift"], 0), ("quality", "ran", True, ["quality", "assurance"], 4),
]
CONTROLS = [
    ("iso", "A.1", "secret/assigned-token", "secrets"), ("iso", "A.2", "privacy/e-mail", "privacy"), ("iso", "A.2", "privacy/none", "privacy"), ("iso", "A.3", "words/none", "words"),
    ("iso", "A.4", None, None), ("soc", "C.1", "license/none", "licenses"), ("soc", "C.2", "drift/none", "drift"), ("soc", "C.2", "quality/none", "quality"),
]


@query(f"WITH {FINDINGS_SQL} SELECT {', '.join(COLUMNS)} FROM findings")
def extract_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select(*COLUMNS)


@query(f"WITH {FINDINGS_SQL} SELECT base_id, count(*) AS findings, count(DISTINCT id) AS sites, max(occurrence) AS last FROM findings GROUP BY base_id")
def occurrence_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("base_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("id").alias("sites"), F.max("occurrence").alias("last"))


@query(f"""WITH {FINDINGS_SQL}, doubled AS (SELECT *, 0 AS b FROM findings UNION ALL SELECT * REPLACE (CASE WHEN start_line % 2 = 0 THEN 'critical' ELSE severity END AS severity), 1 AS b FROM findings),
seqd AS (SELECT id, rule_id, title, severity, probe, repo_id, path, start_line, row_number() OVER (ORDER BY b, repo_id, path, start_line, rule_id) AS seq FROM doubled),
best AS (SELECT *, min(seq) OVER (PARTITION BY id) AS arrival, row_number() OVER (PARTITION BY id ORDER BY {RANK_SQL}, seq) AS n FROM seqd),
once AS (SELECT *, substr(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 1, 48) AS t FROM best WHERE n = 1),
sited AS (SELECT *, first_value(probe) OVER (PARTITION BY repo_id, path, start_line, t ORDER BY arrival) AS fp, row_number() OVER (PARTITION BY repo_id, path, start_line, t ORDER BY arrival) AS k,
  list(probe) OVER (PARTITION BY repo_id, path, start_line, t) AS probes FROM once)
SELECT id, rule_id, severity, path, start_line, CASE WHEN k = 1 THEN array_to_string(list_sort(list_distinct(list_transform(list_filter(probes, lambda p: p <> fp), lambda p: 'also:' || p))), ',') ELSE '' END AS tags FROM sited WHERE k = 1 OR probe = fp""")
def deduplicate_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    again = rows.withColumn("severity", F.when(F.col("start_line") % 2 == 0, "critical").otherwise(F.col("severity")))
    arrival = ["repo_id", "path", "start_line", "rule_id"]  # in this order, the second report after the first
    both = rows.withColumn("seq", F.struct(F.lit(0).alias("b"), *arrival)).union(again.withColumn("seq", F.struct(F.lit(1).alias("b"), *arrival)))
    return identity.deduplicate(both).select("id", "rule_id", "severity", "path", "start_line", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {FINDINGS_SQL}, known AS (SELECT DISTINCT id FROM findings WHERE start_line % 2 = 0) SELECT f.id, rule_id, CASE WHEN k.id IS NOT NULL THEN 'existing' ELSE 'new' END AS status FROM findings f LEFT JOIN known k ON f.id = k.id")
def baseline_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    return identity.baseline_status(rows, rows.where("start_line % 2 = 0").select("id")).select("id", "rule_id", "status")


@query(f"WITH {FINDINGS_SQL}, known AS (SELECT DISTINCT base_id FROM findings WHERE start_line % 2 = 0) SELECT f.id, CASE WHEN f.base_id IN (FROM known) OR f.id IN (FROM known) THEN 'existing' ELSE 'new' END AS status FROM findings f")
def baseline_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir)
    known = rows.where("start_line % 2 = 0").select(F.col("base_id").alias("id"))
    return identity.baseline_status(rows, known, legacy=True).select("id", "status")


_DIFF = "WITH {f}, one AS (SELECT id, min(severity) AS severity, min(start_line) AS start_line FROM findings GROUP BY id), b AS (SELECT * FROM one WHERE start_line % 3 <> 0), a AS (SELECT id, CASE WHEN start_line % 5 = 0 THEN 'critical' ELSE severity END AS severity, CASE WHEN start_line % 7 = 0 THEN start_line + 1 ELSE start_line END AS start_line FROM one WHERE start_line % 4 <> 0)"


@query(_DIFF.format(f=FINDINGS_SQL) + " SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'fixed' WHEN b.severity <> a.severity THEN 'severity_changed' WHEN b.start_line <> a.start_line THEN 'moved' ELSE 'persisting' END AS change FROM b FULL JOIN a ON b.id = a.id")
def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = findings(spark, sf_dir).groupBy("id").agg(F.min("severity").alias("severity"), F.min("start_line").alias("start_line"))
    after = one.where("start_line % 4 <> 0").selectExpr("id", "case when start_line % 5 = 0 then 'critical' else severity end severity", "case when start_line % 7 = 0 then start_line + 1 else start_line end start_line")
    return identity.diff(one.where("start_line % 3 <> 0"), after).select("id", "change")


@query(f"WITH {FINDINGS_SQL} SELECT id, CASE WHEN rule_id LIKE 'privacy/i%' THEN 'critical' WHEN rule_id LIKE 'privacy/%' THEN 'low' WHEN rule_id = 'license/marker' THEN 'medium' ELSE severity END AS severity FROM findings")
def severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.override_severity(findings(spark, sf_dir), OVERRIDES).select("id", "severity")


@query(f"WITH {FINDINGS_SQL} SELECT id, CASE WHEN rule_id LIKE 'privacy/%' AND path LIKE 'fr/%' THEN 'accepted in French texts' WHEN path LIKE '%/1%.txt' THEN 'old corpus' END AS reason FROM findings")
def suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.suppress(findings(spark, sf_dir), SUPPRESS, TODAY).select("id", F.col("suppression_reason").alias("reason"))


@query(f"WITH {FINDINGS_SQL}, {values('patterns', PATTERNS, 'pattern, cwe')}, r AS (SELECT DISTINCT rule_id FROM findings), best AS (SELECT rule_id, arg_max(cwe, (length(pattern), pattern)) AS cwe FROM r JOIN patterns ON rule_id LIKE replace(pattern, '*', '%') GROUP BY rule_id) SELECT id, rule_id, cwe FROM findings LEFT JOIN best USING (rule_id)")
def cwe_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.classify(findings(spark, sf_dir), F.broadcast(relation(spark, PATTERNS, "pattern string, cwe string"))).select("id", "rule_id", "cwe")


@query(f"WITH {FINDINGS_SQL}, {values('stats', [(a, b, c) for a, b, c, _ in LEDGER], 'rule_id, tp, fp')} SELECT id, coalesce(CASE WHEN tp + fp >= 20 THEN CASE WHEN tp / (tp + fp) >= 0.9 THEN 'high' WHEN tp / (tp + fp) >= 0.65 THEN 'medium' ELSE 'low' END END, confidence) AS confidence FROM findings LEFT JOIN stats USING (rule_id)")
def calibrate_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = relation(spark, [(a, b, c) for a, b, c, _ in LEDGER], "rule_id string, tp long, fp long")
    return policy.calibrate(findings(spark, sf_dir), F.broadcast(stats)).select("id", "confidence")


_WILSON = "greatest(0.0, ((tp / n) + 1.959964 * 1.959964 / (2 * n)) / (1 + 1.959964 * 1.959964 / n) - 1.959964 * sqrt((tp / n) * (1 - tp / n) / n + 1.959964 * 1.959964 / (4.0 * n * n)) / (1 + 1.959964 * 1.959964 / n))"
_ADMIT = f"{values('ledger', LEDGER, 'rule_id, tp, fp, kappa')}, bounds AS (SELECT *, tp + fp AS n FROM ledger), adm AS (SELECT rule_id, tp, fp, round({_WILSON}, 4) AS wilson_lower, CASE WHEN n < 30 THEN 'labels' WHEN {_WILSON} < 0.97 THEN 'lower bound' WHEN kappa < 0.8 THEN 'kappa' ELSE 'admitted' END AS why FROM bounds)"


@query(f"WITH {_ADMIT} SELECT rule_id, tp, fp, wilson_lower, why, why = 'admitted' AS admitted FROM adm")
def ledger_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, LEDGER, "rule_id string, tp int, fp int, kappa double")
    return policy.admission(rows).select("rule_id", "tp", "fp", "wilson_lower", "why", "admitted")


@query(f"WITH {RUN_SQL}, {_ADMIT} SELECT id, CASE WHEN provenance = 'inferred' THEN 'inferred' WHEN NOT coalesce(why = 'admitted', false) OR NOT (rule_id LIKE 'secret/%' OR rule_id = 'privacy/ipv4') THEN 'advisory' WHEN verdict = 'confirmed' THEN 'verified' WHEN verdict IN ('refuted', 'uncertain') THEN 'advisory' WHEN wilson_lower >= 0.99 THEN 'verified' ELSE 'advisory' END AS tier FROM run LEFT JOIN adm USING (rule_id)")
def tier_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = F.broadcast(relation(spark, LEDGER, "rule_id string, tp int, fp int, kappa double"))
    return policy.assign_tiers(with_status(findings(spark, sf_dir)), ledger, ["secret/*", "privacy/ipv4"]).select("id", "tier")


_CARD = f"""{values('outcomes', OUTCOMES, 'name, status, applicable, dimensions, checks')},
loc AS (SELECT sum(len(string_split(content, chr(10))))::BIGINT AS total_loc FROM files),
checked AS (SELECT status, greatest(checks, 1) AS checks, unnest(dimensions) AS dimension FROM outcomes WHERE applicable),
byd AS (SELECT dimension, sum(checks)::BIGINT AS checks_applicable, coalesce(sum(CASE WHEN status = 'ran' THEN checks END), 0)::BIGINT AS checks_run FROM checked GROUP BY dimension),
pen AS (SELECT dimension, sum({WEIGHT_SQL}) AS penalty, count(*) AS findings FROM run WHERE NOT suppressed GROUP BY dimension),
card AS (SELECT dimension, round(greatest(0.0, 100 - least(100.0, coalesce(penalty, 0) / greatest(1.0, sqrt(greatest(total_loc, 1) / 2000.0)))), 1) AS score, round(least(1.0, checks_run / checks_applicable), 3) AS coverage, coalesce(findings, 0) AS findings, checks_run, checks_applicable FROM byd LEFT JOIN pen USING (dimension), loc)"""


def _card(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = relation(spark, OUTCOMES, "name string, status string, applicable boolean, dimensions array<string>, checks int")
    loc = files(spark, sf_dir).agg(F.sum(F.size(F.split("content", "\n"))).alias("total_loc"))
    return policy.scorecard(with_status(findings(spark, sf_dir)), outcomes, loc)


@query(f"WITH {RUN_SQL}, {_CARD} SELECT * FROM card")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _card(spark, sf_dir)


@query(f"WITH {RUN_SQL}, {_CARD}, w AS (SELECT *, CASE dimension WHEN 'security' THEN 0.3 WHEN 'compliance' THEN 0.2 WHEN 'quality' THEN 0.2 WHEN 'drift' THEN 0.1 WHEN 'interface' THEN 0.1 WHEN 'supply_chain' THEN 0.1 WHEN 'assurance' THEN 0.0 ELSE 0.1 END::DOUBLE AS w FROM card), t AS (SELECT round(sum(checks_run) / sum(checks_applicable), 3) AS coverage, round(sum(score * w) / sum(w), 1) AS overall FROM w) SELECT coverage, CASE WHEN coverage >= 0.6 THEN overall END AS overall, coverage < 0.6 AS withheld FROM t")
def overall_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.overall(_card(spark, sf_dir))


@query(f"WITH {RUN_SQL}, c AS (SELECT * FROM run WHERE NOT suppressed AND provenance <> 'inferred'), g AS (SELECT count(*) AS considered, count(*) FILTER (severity IN ('critical', 'high')) AS at_severity, count(*) FILTER (status = 'new' AND severity IN ('critical', 'high', 'medium')) AS new_at FROM c) SELECT *, at_severity = 0 AND new_at = 0 AS passed FROM g")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.gate(with_status(findings(spark, sf_dir)), {"severity": "high", "new": "medium"})


@query(f"WITH {RUN_SQL} SELECT id, rule_id, severity, status FROM run WHERE NOT suppressed AND provenance <> 'inferred' AND (severity IN ('critical', 'high') OR status = 'new' AND severity IN ('critical', 'high', 'medium'))")
def gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.gate_failures(with_status(findings(spark, sf_dir)), {"severity": "high", "new": "medium"})


@query(f"""WITH {RUN_SQL}, {values('outcomes', OUTCOMES, 'name, status, applicable, dimensions, checks')}, {values('controls', CONTROLS, 'framework, control, rule, probe')},
hit AS (SELECT DISTINCT rule_id FROM run WHERE NOT suppressed),
s AS (SELECT framework, control, rule, CASE WHEN rule IS NULL THEN 2 WHEN rule_id IS NOT NULL THEN 0 WHEN coalesce(status, 'missing') <> 'ran' THEN 1 ELSE 3 END AS r FROM controls c LEFT JOIN hit ON c.rule = hit.rule_id LEFT JOIN outcomes o ON c.probe = o.name)
SELECT framework, control, ['violated', 'not_assessed', 'no_coverage', 'satisfied'][min(r) + 1] AS state, count(rule) AS checks FROM s GROUP BY framework, control""")
def control_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = relation(spark, OUTCOMES, "name string, status string, applicable boolean, dimensions array<string>, checks int")
    return policy.control_states(relation(spark, CONTROLS, "framework string, control string, rule string, probe string"), outcomes, with_status(findings(spark, sf_dir)))


@query(f"WITH {FINDINGS_SQL}, {values('sev', [(s, i) for i, s in enumerate(identity.SEVERITIES)], 'severity, ord')} SELECT sev.severity, count(id) AS n FROM sev LEFT JOIN findings USING (severity) GROUP BY sev.severity")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = relation(spark, [(s,) for s in identity.SEVERITIES], "severity string")
    counts = findings(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {FINDINGS_SQL} SELECT id, severity FROM findings WHERE severity IN ('critical', 'high', 'medium')")
def severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).where(identity.at_least(F.col("severity"), "medium")).select("id", "severity")


@query(f"WITH {FILES_SQL} SELECT path, regexp_full_match(path, '(?:.*/)?[^/]*1[^/]*\\.txt') AS spans, regexp_full_match(path, '[^/]*1[^/]*') AS inside, regexp_full_match(path, '.*1.*') AS across FROM files")
def path_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return files(spark, sf_dir).select("path", p.rlike(glob("**/*1*.txt")).alias("spans"), p.rlike(glob("*1*")).alias("inside"), p.rlike(glob("*1*", across=True)).alias("across"))


@query(f"WITH {FINDINGS_SQL} SELECT CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM findings GROUP BY 1")
def sarif_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy(identity.lookup(F.col("severity"), identity.SARIF_LEVEL, "note").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH hit AS (SELECT doc_id, regexp_extract(text, 'token = "([0-9a-f]+)"', 1) AS value FROM documents WHERE regexp_matches(text, 'token = "[0-9a-f]+"')),
c AS (SELECT doc_id, value, unnest(string_split(value, '')) AS ch FROM hit), n AS (SELECT doc_id, value, ch, count(*) AS k FROM c GROUP BY ALL)
SELECT doc_id, round(-sum(k / length(value) * log2(k / length(value))), 6) AS entropy, substr(any_value(value), 1, 4) || repeat('*', length(any_value(value)) - 8) || right(any_value(value), 4) AS masked FROM n GROUP BY doc_id""")
def token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.functions.text import masked

    d = files(spark, sf_dir).where(F.col("content").rlike('token = "[0-9a-f]+"')).select("doc_id", F.regexp_extract("content", 'token = "([0-9a-f]+)"', 1).alias("value"))
    return d.select("doc_id", F.round(entropy(F.col("value")), 6).alias("entropy"), masked(F.col("value")).alias("masked"))
