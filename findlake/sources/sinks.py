"""Sinks: findings as SARIF, JSON lines, Markdown and annotations. What grows is written by Spark; only bounded summaries are rendered."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.operators.identity import SARIF_LEVEL, at_least, lookup, rank


def sarif_result(f: DataFrame) -> Column:
    """One SARIF result as JSON from a finding's columns."""
    where = F.struct(F.struct(F.struct(F.when(F.col("path") != "", F.col("path")).otherwise(".").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), F.col("start_line")).alias("startLine")).alias("region")).alias("physicalLocation"))
    return F.to_json(F.struct(F.col("rule_id").alias("ruleId"), lookup(F.col("severity"), SARIF_LEVEL, "note").alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(where).alias("locations"), F.struct(F.col("id").alias("findlake/v1")).alias("fingerprints"), F.struct("severity", "confidence", F.col("repo_id").alias("repo")).alias("properties")))


def sarif_rows(findings: DataFrame, min_severity: str | None = None) -> DataFrame:
    some = findings.where(at_least(F.col("severity"), min_severity)) if min_severity else findings
    return some.select("id", sarif_result(some).alias("result"))


def write_sarif(findings: DataFrame, path: str, min_severity: str | None = None) -> None:
    """A run's results as JSON lines, one result a line, in many files; a document is a join of them."""
    sarif_rows(findings, min_severity).select("result").write.mode("overwrite").text(path)


def sarif_document(findings: DataFrame, most: int = 5_000) -> str:
    """One document of a bounded number of results (more is an error), for services that take a single file."""
    rows = sarif_rows(findings).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} results; use write_sarif")
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "findlake", "rules": []}}, "results": [json.loads(r["result"]) for r in rows]}]})


def annotations(findings: DataFrame, failing: DataFrame) -> DataFrame:
    """id and one workflow command a finding: error for those that fail the gate, else warning or notice."""
    bad = failing.select(F.col("id").alias("__bad")).distinct()
    level = F.when(F.col("__bad").isNotNull(), "error").when(F.col("severity").isin("critical", "high", "medium"), "warning").otherwise("notice")
    text = F.concat(F.lit("::"), level, F.lit(" file="), F.col("path"), F.lit(",line="), F.col("start_line").cast("string"), F.lit("::"), F.col("title"))
    return findings.join(bad, F.col("id") == F.col("__bad"), "left").select("id", text.alias("line"))


def append_history(row: DataFrame, path: str) -> None:
    row.write.mode("append").json(path)


def write_baseline(findings: DataFrame, path: str) -> None:
    """The ids a later run accepts, one row each."""
    findings.select("id", "rule_id").distinct().write.mode("overwrite").parquet(path)


def markdown_summary(findings: DataFrame) -> str:
    """Counts by severity and the twenty loudest rules."""
    by = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).orderBy(rank(F.col("severity"))).limit(10).collect()
    top = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(20).collect()
    return "\n".join(["| severity | findings |", "|---|---|", *(f"| {r['severity']} | {r['n']} |" for r in by), "", "| rule | findings |", "|---|---|", *(f"| {r['rule_id']} | {r['n']} |" for r in top)])
