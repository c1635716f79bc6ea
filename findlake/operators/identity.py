"""Findings: extraction by a rule table, stable identity, occurrences, de-duplication, comparison with earlier runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.functions.text import alphanumeric, short_hash, snippet

# fixed values: severities from worst to least, their weights, and the factor of each confidence
SEVERITIES = ("critical", "high", "medium", "low", "info")
SEVERITY_WEIGHT = {"critical": 40.0, "high": 16.0, "medium": 5.0, "low": 1.5, "info": 0.0}
CONFIDENCE_FACTOR = {"high": 1.0, "medium": 0.6, "low": 0.3}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


@dataclass(frozen=True)
class Rule:
    """What a line must match. A needle is text that every match holds; finding that is cheaper than matching."""

    rule_id: str
    pattern: str
    title: str
    dimension: str
    severity: str
    confidence: str
    probe: str
    needle: str = ""


def lookup(column: Column, values: dict, default=None) -> Column:
    """A small fixed table as one expression; no join."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def rank(severity: Column) -> Column:
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES)}, 99)


def weight(severity: Column, confidence: Column) -> Column:
    return lookup(severity, SEVERITY_WEIGHT, 1.0) * lookup(confidence, CONFIDENCE_FACTOR, 1.0)


def at_least(severity: Column, threshold: str) -> Column:
    """As severe as the threshold or worse; an unknown threshold matches nothing."""
    return rank(severity) <= SEVERITIES.index(threshold) if threshold in SEVERITIES else F.lit(False)


def extract(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per (line, rule) that matches. files: repo_id, path, content. One scan; rules are expressions, not a join."""
    lines = files.select("repo_id", "path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    hit = lambda r: F.contains("line", F.lit(r.needle)) & F.col("line").rlike(r.pattern) if r.needle else F.col("line").rlike(r.pattern)
    some = [F.when(hit(r), F.struct(*[F.lit(getattr(r, f)).alias(f) for f in ("rule_id", "title", "dimension", "severity", "confidence", "probe")])) for r in rules]
    hits = lines.select("repo_id", "path", (F.col("at") + 1).alias("start_line"), "line", F.explode(F.filter(F.array(*some), lambda h: h.isNotNull())).alias("rule"))
    return hits.select("rule.*", "repo_id", "path", F.lit("").alias("logical"), "start_line", F.col("line").alias("evidence")).withColumn("base_id", fingerprint())


def fingerprint() -> Column:
    """Identity that survives moved lines: rule, repository, path, logical place and the normalised evidence."""
    return short_hash("f:", F.col("rule_id"), F.col("repo_id"), F.col("path"), F.col("logical"), F.substring(snippet(F.col("evidence")), 1, 200))


def number_occurrences(findings: DataFrame) -> DataFrame:
    """occurrence and id: the n-th site of one fingerprint by place; the first keeps it, findings at one site share a number."""
    site = Window.partitionBy("base_id").orderBy("start_line")
    out = findings.withColumn("occurrence", F.dense_rank().over(site) - 1)
    later = short_hash("f:", F.col("base_id"), F.concat(F.lit("#"), F.col("occurrence").cast("string")))
    return out.withColumn("id", F.when(F.col("occurrence") == 0, F.col("base_id")).otherwise(later))


def deduplicate(findings: DataFrame, order: str = "seq") -> DataFrame:
    """One row per id (the most severe, then the first), then one per site and title across probes, tagging who also saw it."""
    best = Window.partitionBy("id").orderBy(rank(F.col("severity")), order)
    first_seen = Window.partitionBy("id")
    once = findings.withColumn("arrival", F.min(order).over(first_seen)).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    title = F.substring(alphanumeric(F.col("title")), 1, 48)
    placed = (F.col("path") != "") & (F.col("start_line") > 0)
    # the key is made of columns first, so that one shuffle serves every window over it
    once = once.withColumn("title_key", title).withColumn("alone", F.when(placed, "").otherwise(F.col("id")))
    site = Window.partitionBy("repo_id", "path", "start_line", "title_key", "alone")
    turn = F.row_number().over(site.orderBy("arrival"))
    once = once.withColumns({"turn": turn, "site_probe": F.first("probe").over(site.orderBy("arrival")), "others": F.collect_set("probe").over(site)})
    also = F.when(F.col("turn") == 1, F.array_sort(F.transform(F.array_except("others", F.array("site_probe")), lambda p: F.concat(F.lit("also:"), p)))).otherwise(F.array().cast("array<string>"))
    kept = once.where((F.col("turn") == 1) | (F.col("probe") == F.col("site_probe")))
    return kept.withColumn("tags", also).drop("turn", "others", "site_probe", "arrival", "title_key", "alone")


def baseline_status(findings: DataFrame, known: DataFrame, legacy: bool = False) -> DataFrame:
    """status existing or new. A legacy baseline knows base fingerprints, and each repeat of one matches."""
    ids = known.select(F.col("id").alias("__known")).distinct()
    key = F.col("base_id") if legacy else F.col("id")
    out = findings.join(ids, key == F.col("__known"), "left")
    if legacy:
        ids2 = ids.withColumnRenamed("__known", "__known2")
        out = out.join(ids2, F.col("id") == F.col("__known2"), "left")
        seen = F.col("__known").isNotNull() | F.col("__known2").isNotNull()
    else:
        seen = F.col("__known").isNotNull()
    return out.withColumn("status", F.when(seen, "existing").otherwise("new")).drop("__known", "__known2")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """id and change: new, fixed, severity_changed, moved or persisting."""
    b = before.select("id", F.col("severity").alias("severity_before"), F.col("start_line").alias("line_before"))
    a = after.select("id", F.col("severity").alias("severity_after"), F.col("start_line").alias("line_after"))
    change = F.when(F.col("severity_before").isNull(), "new").when(F.col("severity_after").isNull(), "fixed").when(F.col("severity_before") != F.col("severity_after"), "severity_changed").when(F.col("line_before") != F.col("line_after"), "moved").otherwise("persisting")
    return b.join(a, "id", "full_outer").withColumn("change", change)
