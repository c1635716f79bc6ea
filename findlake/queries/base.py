"""The tables the queries start from, in DataFrame and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.operators.identity import Rule, extract, number_occurrences

RULES = [
    Rule("secret/assigned-token", 'token = "[0-9a-f]{40}"', "Token assigned in text", "security", "high", "high", "secrets", needle="token = "),
    Rule("privacy/e-mail", "[a-z0-9.]+@[a-z0-9]+[.]example[.]com", "E-mail address", "compliance", "medium", "medium", "privacy", needle="@"),
    Rule("privacy/ipv4", "(^|[^0-9.])[0-9]{1,3}([.][0-9]{1,3}){3}([^0-9.]|$)", "IPv4 address", "compliance", "low", "medium", "privacy", needle="."),
    Rule("privacy/digits", "(^|[^0-9a-f])[0-9]{9,}([^0-9a-f]|$)", "Long run of digits", "compliance", "medium", "low", "privacy"),
    Rule("license/marker", "Licen[sc]e|Copyright", "License words", "quality", "info", "high", "licenses"),
    Rule("quality/shout", "[A-Z]{6,}!!", "Shouted words", "quality", "low", "low", "quality", needle="!!"),
    Rule("secret/token-word", "token = ", "Token assigned in text", "security", "medium", "medium", "words", needle="token = "),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: repo_id, path, language, content, lines."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.col("source").alias("repo_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_occurrences(extract(files(spark, sf_dir), RULES))


def with_status(rows: DataFrame) -> DataFrame:
    """Columns that a run adds: provenance, status, suppressed, verdict."""
    return rows.withColumn("provenance", F.when(F.col("rule_id") == "quality/shout", "inferred").otherwise("detected")).withColumn("status", F.when(F.col("id") < "f:8", "existing").otherwise("new")).withColumn("suppressed", F.col("path").startswith("de/")).withColumn("verdict", F.when(F.col("id") > "f:c", "confirmed").when(F.col("id") > "f:a", "uncertain"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


#: CTEs files, findings (as number_occurrences gives them) and run (as with_status does).
FILES_SQL = """
files AS (SELECT doc_id, source AS repo_id, lang || '/' || doc_id || '.txt' AS path, lang AS language, text AS content FROM documents WHERE text IS NOT NULL)"""
FINDINGS_SQL = (
    FILES_SQL
    + f""",
rules(rule_id, pattern, title, dimension, severity, confidence, probe) AS (VALUES {_values([(r.rule_id, r.pattern, r.title, r.dimension, r.severity, r.confidence, r.probe) for r in RULES])}),
text_lines AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS start_line FROM files),
hits AS (SELECT rule_id, title, dimension, severity, confidence, probe, repo_id, path, '' AS logical, start_line, line AS evidence FROM text_lines JOIN rules ON regexp_matches(line, pattern)),
based AS (SELECT *, 'f:' || substr(sha256(concat_ws('␟', rule_id, repo_id, path, logical, substr(lower(trim(regexp_replace(evidence, '\\s+', ' ', 'g'))), 1, 200))), 1, 12) AS base_id FROM hits),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY base_id ORDER BY start_line) - 1 AS occurrence FROM based),
findings AS (SELECT *, CASE WHEN occurrence = 0 THEN base_id ELSE 'f:' || substr(sha256(base_id || '␟#' || occurrence), 1, 12) END AS id FROM numbered)"""
)
RUN_SQL = (
    FINDINGS_SQL
    + """,
run AS (SELECT *, CASE WHEN rule_id = 'quality/shout' THEN 'inferred' ELSE 'detected' END AS provenance, CASE WHEN id < 'f:8' THEN 'existing' ELSE 'new' END AS status,
  starts_with(path, 'de/') AS suppressed, CASE WHEN id > 'f:c' THEN 'confirmed' WHEN id > 'f:a' THEN 'uncertain' END AS verdict FROM findings)"""
)
RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END"
WEIGHT_SQL = "(CASE severity WHEN 'critical' THEN 40.0 WHEN 'high' THEN 16.0 WHEN 'medium' THEN 5.0 WHEN 'low' THEN 1.5 WHEN 'info' THEN 0.0 ELSE 1.0 END * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 1.0 END)::DOUBLE"


def relation(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(name: str, rows: list[tuple], columns: str) -> str:
    """A CTE with literal rows; None is NULL, lists are lists."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        return "'" + str(v).replace("'", "''") + "'"

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"
