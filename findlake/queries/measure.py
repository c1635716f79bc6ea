"""Measurement: labels, intervals, raters, totals, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions import stats
from findlake.operators import measure
from findlake.plans.registry import query
from findlake.queries.base import FILES_SQL, FINDINGS_SQL, files, findings, relation, table, values

#: Two raters and a third for half of the labelled documents, with rule = language and cluster = source.
VOTES_SQL = """
votes AS (SELECT d.doc_id, d.lang AS rule_id, d.source AS cluster, CASE WHEN d.doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS category, l.toxic AS y,
  CASE WHEN d.doc_id % 13 = 0 THEN 1 - toxic ELSE toxic END AS r1, CASE WHEN d.doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END AS r2, CASE WHEN d.doc_id % 2 = 0 THEN CASE WHEN d.doc_id % 5 = 0 THEN 1 - toxic ELSE toxic END END AS r3
  FROM documents d JOIN labels l USING (doc_id) WHERE toxic IS NOT NULL)"""
Z2 = "(1.959964 * 1.959964)"


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("rule_id"), F.col("source").alias("cluster"))
    rows = d.join(table(spark, sf_dir, "labels").where("toxic is not null").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    return rows.selectExpr("*", "case when doc_id % 3 = 0 then 'a' else 'b' end category", "case when doc_id % 13 = 0 then 1 - y else y end r1", "case when doc_id % 7 = 0 then 1 - y else y end r2", "case when doc_id % 2 = 0 then case when doc_id % 5 = 0 then 1 - y else y end end r3")


def _wilson_sql(k: str, n: str, sign: str, z: str = "1.959964") -> str:
    return f"((({k}) / ({n}) + {z} * {z} / (2 * ({n}))) {sign} {z} * sqrt(greatest(0.0, ({k}) / ({n}) * (1 - ({k}) / ({n})) / ({n}) + {z} * {z} / (4.0 * ({n}) * ({n}))))) / (1 + {z} * {z} / ({n}))"


@query(f"WITH {VOTES_SQL}, g AS (SELECT rule_id, sum(y)::DOUBLE AS k, count(*)::DOUBLE AS n FROM votes GROUP BY rule_id) SELECT rule_id, k, n, round(greatest(0.0, {_wilson_sql('k', 'n', '-')}), 6) AS lower, round(least(1.0, {_wilson_sql('k', 'n', '+')}), 6) AS upper, round(greatest(0.0, {_wilson_sql('k', 'n', '-', '1.96')}), 6) AS lower_196 FROM g")
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = votes(spark, sf_dir).groupBy("rule_id").agg(F.sum("y").cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("rule_id", "k", "n", F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"), F.round(stats.wilson(F.col("k"), F.col("n"), 1.96)[0], 6).alias("lower_196"))


@query(f"WITH {VOTES_SQL}, c AS (SELECT rule_id, r1, r2, count(*) AS k FROM votes GROUP BY ALL), n AS (SELECT rule_id, sum(k) AS n, sum(k) FILTER (r1 = r2) AS s FROM c GROUP BY rule_id), e AS (SELECT a.rule_id, sum(a.k * b.k) AS e FROM (SELECT rule_id, r1 AS c, sum(k) AS k FROM c GROUP BY ALL) a JOIN (SELECT rule_id, r2 AS c, sum(k) AS k FROM c GROUP BY ALL) b USING (rule_id, c) GROUP BY a.rule_id) SELECT rule_id, n::BIGINT AS n, round(s / n, 6) AS agreed, round((s / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM n JOIN e USING (rule_id)")
def cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.agreement(votes(spark, sf_dir), ["rule_id"], "r1", "r2")


@query(f"""WITH {VOTES_SQL}, pop AS (SELECT lang AS rule_id, source AS cluster, count(*) AS population FROM documents GROUP BY ALL), s AS (SELECT rule_id, cluster, sum(r1)::DOUBLE AS tp, sum(1 - r1)::DOUBLE AS fp, any_value(population)::DOUBLE AS population FROM votes JOIN pop USING (rule_id, cluster) GROUP BY rule_id, cluster),
w AS (SELECT *, tp + fp AS n, tp / (tp + fp) AS q, population / sum(population) OVER (PARTITION BY rule_id) AS w FROM s), a AS (SELECT rule_id, sum(w * q) AS p, 1 / sum(w * w / n) AS kish, sum(w * w * q * (1 - q) / n) AS v, sum(tp) AS tp, sum(fp) AS fp, sum(population) AS population, count(*) AS strata FROM w GROUP BY rule_id), e AS (SELECT *, CASE WHEN v > 0 THEN least(kish, p * (1 - p) / v) ELSE kish END AS m FROM a)
SELECT rule_id, round(p, 4) AS precision, round(greatest(0.0, {_wilson_sql('p * m', 'm', '-')}), 4) AS wilson_lower, round(least(1.0, {_wilson_sql('p * m', 'm', '+')}), 4) AS wilson_upper, round(m, 1) AS n_eff, tp::BIGINT AS tp, fp::BIGINT AS fp, population::BIGINT AS population, strata FROM e""")
def weighted_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    pop = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("rule_id"), F.col("source").alias("cluster")).agg(F.count(F.lit(1)).alias("population"))
    strata = votes(spark, sf_dir).groupBy("rule_id", "cluster").agg(F.sum("r1").alias("tp"), F.sum(1 - F.col("r1")).alias("fp")).join(pop, ["rule_id", "cluster"])
    return measure.weighted_precision(strata, ["rule_id"])


@query(f"""WITH {VOTES_SQL}, c AS (SELECT rule_id, cluster, sum(r1)::DOUBLE AS tp, count(*)::DOUBLE AS m FROM votes GROUP BY ALL), t AS (SELECT *, sum(m) OVER (PARTITION BY rule_id) AS n, sum(tp) OVER (PARTITION BY rule_id) / sum(m) OVER (PARTITION BY rule_id) AS p FROM c),
a AS (SELECT rule_id, count(*) AS clusters, any_value(n) AS n, any_value(p) AS p, sum(((tp - p * m) / n) ** 2) AS v, sum((m / n) ** 2) AS mass2 FROM t GROUP BY rule_id), k AS (SELECT *, clusters > 1 AND p * (1 - p) > 0 AS known, v / nullif(p * (1 - p) / n, 0) AS raw, mass2 * n AS size FROM a)
SELECT rule_id, clusters, n::BIGINT AS n, round(size, 2) AS weighted_cluster_size, round(greatest(1.0, CASE WHEN known THEN raw ELSE size END), 3) AS deff, CASE WHEN known AND size > 1 THEN round((raw - 1) / (size - 1), 4) END AS icc FROM k""")
def cluster_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.cluster_design(votes(spark, sf_dir), ["rule_id"], y="r1")


_RECORDS = f"""{VOTES_SQL}, records AS (SELECT doc_id AS finding_id, 'ground_truth' AS role, 'x' AS labeller, CASE y WHEN 1 THEN 'tp' ELSE 'fp' END AS label, 1 AS seq FROM votes WHERE doc_id % 11 = 0
UNION ALL SELECT doc_id, 'mechanical', 'm1', CASE WHEN doc_id % 4 = 0 THEN 'unsure' ELSE 'tp' END, 2 FROM votes WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'mechanical', 'm2', CASE WHEN doc_id % 10 = 5 THEN 'fp' ELSE 'tp' END, 3 FROM votes WHERE doc_id % 15 = 0
UNION ALL SELECT doc_id, 'adjudicator', 'a', 'fp', 4 FROM votes WHERE doc_id % 17 = 0 UNION ALL SELECT doc_id, 'labeller', 'l1', CASE r1 WHEN 1 THEN 'tp' ELSE 'fp' END, 5 FROM votes UNION ALL SELECT doc_id, 'labeller', 'l2', CASE WHEN doc_id % 19 = 0 THEN 'unsure' WHEN r2 = 1 THEN 'tp' ELSE 'fp' END, 6 FROM votes)"""


@query(f"""WITH {_RECORDS}, g AS (SELECT finding_id, arg_max(label, seq) FILTER (role = 'ground_truth') AS t, list(DISTINCT label) FILTER (role = 'mechanical' AND label <> 'unsure') AS m, arg_max(label, seq) FILTER (role = 'adjudicator') AS a, list(DISTINCT label) FILTER (role = 'labeller' AND label <> 'unsure') AS l FROM records GROUP BY finding_id)
SELECT finding_id, CASE WHEN t IS NOT NULL THEN t WHEN len(m) = 1 THEN m[1] WHEN len(m) > 1 THEN 'unsure' WHEN a IS NOT NULL THEN a WHEN len(l) = 1 THEN l[1] ELSE 'unsure' END AS label FROM g""")
def final_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes(spark, sf_dir)
    word = lambda c: f"case when {c} = 1 then 'tp' else 'fp' end"
    parts = [v.where("doc_id % 11 = 0").selectExpr("doc_id", "'ground_truth'", "'x'", word("y"), "1"), v.where("doc_id % 5 = 0").selectExpr("doc_id", "'mechanical'", "'m1'", "case when doc_id % 4 = 0 then 'unsure' else 'tp' end", "2"), v.where("doc_id % 15 = 0").selectExpr("doc_id", "'mechanical'", "'m2'", "case when doc_id % 10 = 5 then 'fp' else 'tp' end", "3"), v.where("doc_id % 17 = 0").selectExpr("doc_id", "'adjudicator'", "'a'", "'fp'", "4"), v.selectExpr("doc_id", "'labeller'", "'l1'", word("r1"), "5"), v.selectExpr("doc_id", "'labeller'", "'l2'", f"case when doc_id % 19 = 0 then 'unsure' else {word('r2')} end", "6")]
    records = parts[0].toDF("finding_id", "role", "labeller", "label", "seq")
    for p in parts[1:]:
        records = records.union(p)
    return measure.final_verdicts(records)


@query(f"WITH {VOTES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY sha256(doc_id::VARCHAR) DESC, doc_id) AS rank FROM votes), h AS (SELECT *, sum(y) OVER (PARTITION BY rule_id ORDER BY rank) AS hits FROM r) SELECT rule_id, sum(y)::BIGINT AS positives, round(sum(CASE WHEN y = 1 THEN hits / rank END) / nullif(sum(y), 0), 3) AS ap FROM h GROUP BY rule_id")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.average_precision(votes(spark, sf_dir).withColumn("score", F.sha2(F.col("doc_id").cast("string"), 256)), ["rule_id"], "score", "y", "doc_id")


@query(f"""WITH {VOTES_SQL}, v AS (SELECT doc_id, cluster AS rule_id, rule_id AS language, y, CASE WHEN doc_id % 3 = 0 THEN 'high' WHEN doc_id % 3 = 1 THEN 'low' ELSE 'medium' END AS confidence FROM votes), t AS (SELECT * FROM v WHERE doc_id % 2 = 0), p AS (SELECT rule_id, language, (sum(y) + 1) / (count(*) + 2) AS s FROM t GROUP BY ALL HAVING count(*) >= 4), r AS (SELECT rule_id, (sum(y) + 1) / (count(*) + 2) AS s FROM t GROUP BY ALL), g AS (SELECT (sum(y) + 1) / (count(*) + 2) AS s FROM t)
SELECT doc_id, round(greatest(0.001, least(0.999, coalesce(p.s, r.s, g.s) + CASE confidence WHEN 'high' THEN 0.04 WHEN 'low' THEN -0.04 ELSE 0 END)), 6) AS score FROM v LEFT JOIN p USING (rule_id, language) LEFT JOIN r USING (rule_id), g WHERE doc_id % 2 = 1""")
def triage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes(spark, sf_dir).selectExpr("doc_id", "cluster as rule_id", "rule_id as language", "y", "case when doc_id % 3 = 0 then 'high' when doc_id % 3 = 1 then 'low' else 'medium' end as confidence")
    return measure.triage_scores(v.where("doc_id % 2 = 0"), v.where("doc_id % 2 = 1")).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {FINDINGS_SQL}, f AS (SELECT rule_id, repo_id, substr(repo_id, 4)::INT % 3 = 0 AS bad, count(*) AS n FROM findings GROUP BY ALL), e AS (SELECT count(DISTINCT repo_id) FILTER (substr(repo_id, 4)::INT % 3 = 0) AS b, count(DISTINCT repo_id) FILTER (substr(repo_id, 4)::INT % 3 <> 0) AS c FROM files), h AS (SELECT rule_id, coalesce(sum(n) FILTER (bad), 0)::BIGINT AS on_bad, coalesce(sum(n) FILTER (NOT bad), 0)::BIGINT AS on_clean, count(DISTINCT repo_id) AS repos FROM f GROUP BY rule_id), r AS (SELECT *, CASE WHEN on_bad = 0 THEN NULL WHEN on_clean = 0 THEN 'inf'::DOUBLE ELSE (on_bad / b) / (on_clean / c) END AS ratio FROM h, e)
SELECT rule_id, on_bad, on_clean, round(ratio, 6) AS ratio, CASE WHEN ratio IS NULL THEN NULL WHEN repos < 2 AND ratio >= 3 THEN 'low' WHEN ratio >= 10 THEN 'medium' WHEN ratio >= 3 THEN 'low' ELSE 'info' END AS band FROM r""")
def discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.substring("repo_id", 4, 9).cast("int") % 3 == 0
    hits = findings(spark, sf_dir).groupBy("rule_id", "repo_id", bad.alias("bad")).agg(F.count(F.lit(1)).alias("n"))
    size = files(spark, sf_dir).agg(F.countDistinct(F.when(bad, F.col("repo_id"))).alias("bad_size"), F.countDistinct(F.when(~bad, F.col("repo_id"))).alias("clean_size"))
    return measure.discrimination(hits, size)


@query("WITH r AS (SELECT lang, n_chars AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL) SELECT lang, any_value(n) AS n, avg(v) FILTER (k IN ((n - 1) // 2, n // 2)) AS median, max(v) FILTER (k = least(n - 1, floor(0.9 * n))) AS p90, max(v) FILTER (k = least(n - 1, floor(0.95 * n))) AS p95, max(v) FILTER (k = least(n - 1, floor(0.99 * n))) AS p99, max(v) AS max FROM r GROUP BY lang")
def distribution_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.profile(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


@query("WITH r AS (SELECT lang, n_chars AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL), p AS (SELECT lang, any_value(n) AS n, max(v) FILTER (k = least(n - 1, floor(0.95 * n))) AS p95 FROM r GROUP BY lang) SELECT lang, CASE WHEN n < 30 THEN 8000.0 ELSE greatest(4000.0, least(p95::DOUBLE, 8000.0)) END::DOUBLE AS threshold FROM p")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = measure.profile(table(spark, sf_dir, "documents"), ["lang"], "n_chars")
    return p.select("lang", measure.adaptive_threshold({"n": F.col("n"), "p95": F.col("p95")}, 8000).alias("threshold"))


@query(f"WITH {VOTES_SQL}, p AS (SELECT rule_id, r1 = 1 AS flagged, y = 1 AS real FROM votes), c AS (SELECT coalesce(rule_id, 'all') AS rule_id, count(*) FILTER (real AND flagged) AS tp, count(*) FILTER (NOT real AND flagged) AS fp, count(*) FILTER (real AND NOT flagged) AS fn, count(*) FILTER (NOT real AND NOT flagged) AS tn FROM p GROUP BY ROLLUP (rule_id)) SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(fp / nullif(fp + tn, 0), 4) AS fpr, round(tp / nullif(tp + fn, 0) - fp / nullif(fp + tn, 0), 4) AS youden FROM c")
def confusion_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.confusion(votes(spark, sf_dir).selectExpr("rule_id", "r1 = 1 as flagged", "y = 1 as real"), ["rule_id"], "all")


_HIST = f"{VOTES_SQL}, h AS (SELECT rule_id, 4 * r1 + 2 * r2 + coalesce(r3, 0) AS history FROM votes WHERE 4 * r1 + 2 * r2 + coalesce(r3, 0) > 0)"


def _histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(F.array(*[F.when(F.col(f"r{i}") == 1, F.lit(f"r{i}")) for i in (1, 2, 3)]), lambda x: x.isNotNull())
    return measure.capture_histories(votes(spark, sf_dir).withColumn("detectors", found), ["r1", "r2", "r3"], ["rule_id"])


@query(f"WITH {_HIST} SELECT rule_id, history::INT AS history, count(*) AS n FROM h GROUP BY rule_id, history")
def capture_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histories(spark, sf_dir)


@query(f"WITH {_HIST}, c AS (SELECT rule_id, count(*) FILTER (history & 4 > 0)::DOUBLE AS n1, count(*) FILTER (history & 2 > 0)::DOUBLE AS n2, count(*) FILTER (history & 6 = 6)::DOUBLE AS m FROM h GROUP BY rule_id), e AS (SELECT *, n1 + n2 - m AS s, (n1 + 1) * (n2 + 1) / (m + 1) - 1 AS t, (n1 + 1) * (n2 + 1) * (n1 - m) * (n2 - m) / ((m + 1) * (m + 1) * (m + 2)) AS v FROM c), i AS (SELECT *, t - s AS u, exp(1.959964 * sqrt(ln(1 + v / nullif((t - s) * (t - s), 0)))) AS c FROM e) SELECT rule_id, round(t, 6) AS n_hat, round(CASE WHEN u <= 1e-9 OR v <= 0 THEN s ELSE s + u / c END, 6) AS lo, round(CASE WHEN m = 0 THEN 'inf'::DOUBLE WHEN u <= 1e-9 OR v <= 0 THEN greatest(s, t) ELSE s + u * c END, 6) AS hi, round(sqrt(v), 6) AS se FROM i")
def chapman_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _histories(spark, sf_dir)
    has = lambda bits: F.sum(F.when(F.col("history").bitwiseAND(bits) == bits, F.col("n")).otherwise(0)).cast("double")
    c = h.groupBy("rule_id").agg(has(4).alias("n1"), has(2).alias("n2"), has(6).alias("m"))
    e = stats.chapman(F.col("n1"), F.col("n2"), F.col("m"))
    return c.select("rule_id", *[F.round(e[k], 6).alias(k) for k in ("n_hat", "lo", "hi", "se")])


@query(f"WITH {_HIST}, c AS (SELECT rule_id, count(*)::DOUBLE AS s, count(*) FILTER (bit_count(history) = 1)::DOUBLE AS f1, count(*) FILTER (bit_count(history) = 2)::DOUBLE AS f2, 2.0 / 3 AS a FROM h GROUP BY rule_id) SELECT rule_id, s AS observed, round(CASE WHEN f2 > 0 THEN s + a * f1 * f1 / (2 * f2) ELSE s + a * f1 * greatest(f1 - 1, 0) / 2 END, 6) AS n_hat FROM c")
def chao_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    caught = F.bit_count("history")
    c = _histories(spark, sf_dir).groupBy("rule_id").agg(F.sum("n").alias("s"), F.sum(F.when(caught == 1, F.col("n")).otherwise(0)).alias("f1"), F.sum(F.when(caught == 2, F.col("n")).otherwise(0)).alias("f2"))
    e = stats.chao(F.col("s"), F.col("f1"), F.col("f2"), 3)
    return c.select("rule_id", e["observed"].alias("observed"), F.round(e["n_hat"], 6).alias("n_hat"))


@query()
def loglinear_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fit over the at most seven cells of three detectors."""
    cells = {tuple(int(b) for b in f"{r['history']:03b}"): float(r["n"]) for r in _histories(spark, sf_dir).groupBy("history").agg(F.sum("n").alias("n")).collect()}
    e = measure.loglinear_total(cells)
    return spark.createDataFrame([(e["n_hat"], e["lo"], e["hi"], e["observed"], e["aic"], str(e["pairs"]))] if e else [], "n_hat double, lo double, hi double, observed double, aic double, pairs string")


@query()
def rater_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda c: F.when(F.col(c).isNull(), "unsure").when(F.col(c) == 1, "tp").otherwise("fp")
    v = votes(spark, sf_dir).withColumn("votes", F.create_map(F.lit("r1"), word("r1"), F.lit("r2"), word("r2"), F.lit("r3"), word("r3")))
    items = v.select(F.col("doc_id").alias("id"), F.col("rule_id").alias("grp"), "category", "votes", F.when(F.col("doc_id") % 9 == 0, word("y")).alias("truth"), (F.col("doc_id") % 27 == 0).alias("anchor"))
    return measure.fit_raters(items)[0].select("id", "grp", F.round("posterior", 6).alias("posterior"))


@query()
def precision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.summarise(rater_model(spark, sf_dir), ["grp"])


@query()
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = votes(spark, sf_dir).groupBy("rule_id", "cluster").agg(F.sum("r1").alias("tp"), F.count(F.lit(1)).alias("n"))
    return measure.cluster_bootstrap(cells, ["rule_id"])


@query(f"""WITH {FINDINGS_SQL}, p AS (SELECT min(id) AS id, rule_id, repo_id, path, start_line FROM findings GROUP BY rule_id, repo_id, path, start_line), s(rule_id, observations) AS (VALUES ('privacy/ipv4', 40), ('privacy/digits', 5), ('license/marker', 25)),
a AS (SELECT *, row_number() OVER (PARTITION BY rule_id, repo_id, path ORDER BY start_line, id) AS nth, count(*) OVER (PARTITION BY rule_id) AS size FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY rule_id, repo_id ORDER BY nth, path, id) AS depth FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY depth, repo_id, id) AS place FROM b), d AS (SELECT c.*, coalesce(observations, 0) AS have FROM c LEFT JOIN s USING (rule_id)),
r AS (SELECT *, row_number() OVER (ORDER BY have >= 20, place, have = 0, size DESC, rule_id) AS rank FROM d) SELECT id, rule_id, repo_id, path, rank::INT AS rank FROM r WHERE rank <= 60""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = findings(spark, sf_dir).groupBy("rule_id", "repo_id", "path", "start_line").agg(F.min("id").alias("id"))
    stats_ = relation(spark, [("privacy/ipv4", 40), ("privacy/digits", 5), ("license/marker", 25)], "rule_id string, observations long")
    return measure.review_queue(pool, F.broadcast(stats_), 60)


@query(f"WITH {FILES_SQL} SELECT language, repo_id, count(*) AS stratum_size, sum(count(*)) OVER (PARTITION BY language)::BIGINT AS rule_population FROM files GROUP BY language, repo_id")
def stratum_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    g = files(spark, sf_dir).groupBy("language", "repo_id").agg(F.count(F.lit(1)).alias("stratum_size"))
    return g.withColumn("rule_population", F.sum("stratum_size").over(Window.partitionBy("language")))


@query()
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.stratified_sample(files(spark, sf_dir).select("language", "repo_id", "path"), ["language"], ["path"], 100)


@query(f"WITH {FILES_SQL}, r AS (SELECT DISTINCT repo_id FROM files) SELECT repo_id, ('0x' || substr(sha256('split-1:' || repo_id), 1, 12))::BIGINT / 281474976710656.0 < 0.3 AS held_out FROM r")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("repo_id").distinct().select("repo_id", (measure.hash_share("split-1", F.col("repo_id")) < 0.3).alias("held_out"))


_LABELS = [("a", 0, 0), ("b", 30, 0), ("c", 50, 1), ("d", 200, 0), ("e", 5, 5)]


@query(f"WITH {values('l', _LABELS, 'rule_id, tp, fp')}, k AS (SELECT *, unnest(range(0, 2001)) AS k FROM l), ok AS (SELECT rule_id, min(k) AS needed FROM k WHERE tp + fp + k > 0 AND {_wilson_sql('(tp + k)::DOUBLE', '(tp + fp + k)::DOUBLE', '-')} >= 0.97 GROUP BY rule_id) SELECT l.rule_id, needed::INT AS needed FROM l LEFT JOIN ok USING (rule_id)")
def labels_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, _LABELS, "rule_id string, tp int, fp int")
    return rows.select("rule_id", measure.labels_needed(F.col("tp"), F.col("fp"), 0.97).alias("needed"))


@query("SELECT o_orderpriority, ceil(-ln(0.05) / (count(*) FILTER (o_orderstatus = 'P') / count(*)))::BIGINT AS needed FROM orders GROUP BY o_orderpriority HAVING count(*) FILTER (o_orderstatus = 'P') > 0")
def observations_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg((F.count_if(F.col("o_orderstatus") == "P") / F.count(F.lit(1))).alias("rate")).where("rate > 0")
    return g.select("o_orderpriority", stats.observations_needed(F.col("rate")).alias("needed"))


_BUDGET = [("privacy/", 0.2), ("secret/", 0.001)]


@query(f"""WITH {FINDINGS_SQL}, {values('budgets', _BUDGET, 'prefix, budget')}, k AS (SELECT sum(len(string_split(content, chr(10)))) / 1000.0 AS kloc FROM files), c AS (SELECT rule_id, count(*) AS n, count(DISTINCT repo_id) AS repos_hit FROM findings GROUP BY rule_id)
SELECT rule_id, n, repos_hit, round(n / kloc, 4) AS per_kloc, coalesce(budget, 5.0)::DOUBLE AS budget, n >= 5 AND round(n / kloc, 4) > coalesce(budget, 5.0) AS over_budget FROM c LEFT JOIN budgets ON starts_with(rule_id, prefix), k""")
def budget_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from findlake.operators.matching import longest_prefix

    kloc = files(spark, sf_dir).agg((F.sum(F.size(F.split("content", "\n"))) / 1000).alias("kloc"))
    c = findings(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repo_id").alias("repos_hit"))
    rows = longest_prefix(c, "rule_id", relation(spark, _BUDGET, "prefix string, budget double"), "budget", 5.0).crossJoin(F.broadcast(kloc))  # one row
    rate = F.round(F.col("n") / F.col("kloc"), 4)
    return rows.select("rule_id", "n", "repos_hit", rate.alias("per_kloc"), "budget", ((F.col("n") >= 5) & (rate > F.col("budget"))).alias("over_budget"))


@query(f"WITH {FINDINGS_SQL}, a AS (SELECT rule_id, repo_id, path, start_line, row_number() OVER (PARTITION BY rule_id, repo_id ORDER BY path, start_line) AS n FROM findings), b AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY repo_id, n) AS m FROM a WHERE n <= 3) SELECT rule_id, repo_id || ':' || path || ':' || start_line AS sample FROM b WHERE m <= 15")
def rule_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = findings(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("rule_id", "repo_id").orderBy("path", "start_line"))).where("n <= 3")
    rows = rows.withColumn("m", F.row_number().over(Window.partitionBy("rule_id").orderBy("repo_id", "n"))).where("m <= 15")
    return rows.select("rule_id", F.concat_ws(":", "repo_id", "path", "start_line").alias("sample"))


@query(f"WITH {FILES_SQL} SELECT language, count(*) AS files, sum(len(string_split(content, chr(10))))::BIGINT AS lines FROM files GROUP BY language")
def lines_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines"))


@query(f"WITH {FILES_SQL}, r AS (SELECT CASE WHEN length(content) = 0 THEN 'empty' WHEN length(content) > 8000 THEN 'too large' WHEN contains(content, '|') THEN 'table' END AS reason FROM files) SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM files), 6) AS share FROM r WHERE reason IS NOT NULL GROUP BY reason")
def skipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.length("content") == 0, "empty").when(F.length("content") > 8000, "too large").when(F.contains("content", F.lit("|")), "table")
    rows = files(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("all"))
    return rows.where("reason is not null").crossJoin(F.broadcast(total)).select("reason", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))  # one row


@query(f"WITH {FINDINGS_SQL}, t AS (SELECT rule_id, title, severity, 'req:' || substr(repo_id, 4) AS req FROM findings WHERE substr(repo_id, 4)::INT % 2 = 0 UNION ALL SELECT rule_id, title, severity, 'unattributed' FROM findings WHERE substr(repo_id, 4)::INT % 2 = 1) SELECT req, count(*) AS n, count(*) FILTER (severity = 'high') AS high, array_to_string(list_sort(list(DISTINCT title))[1:3], '; ') AS titles FROM t GROUP BY req")
def requirement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = F.substring("repo_id", 4, 9)
    tag = F.when(repo.cast("int") % 2 == 0, F.concat(F.lit("req:"), repo)).otherwise("unattributed")
    return findings(spark, sf_dir).groupBy(tag.alias("req")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "high").alias("high"), F.array_join(F.slice(F.sort_array(F.collect_set("title")), 1, 3), "; ").alias("titles"))


@query(f"WITH {FINDINGS_SQL}, a AS (SELECT rule_id, path, start_line FROM findings WHERE start_line % 3 <> 0), b AS (SELECT rule_id, path, start_line FROM findings WHERE start_line % 4 <> 0) SELECT *, 'lost' AS what FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'gained' FROM (FROM b EXCEPT ALL FROM a)")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir).select("rule_id", "path", "start_line")
    a, b = rows.where("start_line % 3 <> 0"), rows.where("start_line % 4 <> 0")
    return a.exceptAll(b).withColumn("what", F.lit("lost")).union(b.exceptAll(a).withColumn("what", F.lit("gained")))
