"""Policy over findings: overrides, suppressions, calibration, classification, tiers, scores and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.functions.stats import wilson
from findlake.functions.text import glob
from findlake.operators.identity import at_least, weight

# fixed values: dimensions in report order, their weights in the overall score, thresholds
DIMENSIONS = ("security", "compliance", "quality", "drift", "interface", "supply_chain", "assurance")
DIMENSION_WEIGHTS = {"security": 0.3, "compliance": 0.2, "quality": 0.2, "drift": 0.1, "interface": 0.1, "supply_chain": 0.1, "assurance": 0.0}
COVERAGE_THRESHOLD = 0.6
BAR = {"rule_min_n": 30, "rule_lower": 0.97, "kappa_min": 0.8, "offline_lower": 0.99}


def override_severity(findings: DataFrame, overrides: list[tuple[str, str]]) -> DataFrame:
    """The first pattern that the rule matches sets the severity."""
    out = F.col("severity")
    for pattern, severity in reversed(overrides):
        out = F.when((F.col("rule_id") == pattern) | F.col("rule_id").rlike(glob(pattern, across=True)), F.lit(severity)).otherwise(out)
    return findings.withColumn("severity", out)


def suppress(findings: DataFrame, rules: list[dict], today: str) -> DataFrame:
    """suppressed and suppression_reason: the first rule in force that matches. A rule without reason, end or selector has no force."""
    hit: Column = F.lit(None).cast("string")
    for r in reversed(rules):
        if not r.get("reason") or not r.get("expires") or not any(r.get(k) for k in ("rule", "path", "id")):
            continue
        on = F.to_date(F.lit(r["expires"])) >= F.to_date(F.lit(today))
        if r.get("rule"):
            on &= (F.col("rule_id") == r["rule"]) | F.col("rule_id").rlike(glob(r["rule"], across=True))
        if r.get("path"):
            on &= F.col("path").rlike(glob(r["path"], across=True))
        if r.get("id"):
            on &= (F.col("id") == r["id"]) | (F.col("base_id") == r["id"])
        hit = F.when(on, F.lit(r["reason"])).otherwise(hit)
    return findings.withColumn("suppression_reason", hit).withColumn("suppressed", F.col("suppression_reason").isNotNull())


def classify(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """cwe of the longest pattern that the rule matches. patterns: pattern, cwe; a rule table, broadcast while it is small."""
    rules = findings.select("rule_id").distinct()
    found = rules.join(patterns, F.expr("rule_id like replace(pattern, '*', '%')"), "left").groupBy("rule_id").agg(F.max_by("cwe", F.struct(F.length("pattern"), "pattern")).alias("cwe"))
    return findings.join(found, "rule_id", "left")


def calibrated(tp: Column, fp: Column) -> Column:
    """Confidence that the evidence supports, null below twenty observations."""
    n = tp + fp
    share = tp / n
    return F.when(n >= 20, F.when(share >= 0.9, "high").when(share >= 0.65, "medium").otherwise("low"))


def calibrate(findings: DataFrame, stats: DataFrame) -> DataFrame:
    """Confidence from rule statistics (rule_id, tp, fp) where these suffice."""
    by = stats.select("rule_id", calibrated(F.col("tp"), F.col("fp")).alias("learned"))
    return findings.join(by, "rule_id", "left").withColumn("confidence", F.coalesce("learned", "confidence")).drop("learned")


def admission(entries: DataFrame, bar: dict = BAR) -> DataFrame:
    """admitted and why for each rule's tp, fp and kappa."""
    n = F.col("tp") + F.col("fp")
    low = wilson(F.col("tp"), n)[0]
    why = F.when(n < bar["rule_min_n"], "labels").when(low < bar["rule_lower"], "lower bound").when(F.col("kappa") < bar["kappa_min"], "kappa").otherwise("admitted")
    return entries.withColumn("wilson_lower", F.round(low, 4)).withColumn("why", why).withColumn("admitted", F.col("why") == "admitted")


def assign_tiers(findings: DataFrame, entries: DataFrame, verified: list[str], deterministic: bool = True, bar: dict = BAR) -> DataFrame:
    """tier: inferred for a model's findings, verified where rule, ledger and profile allow, else advisory."""
    rules = admission(entries, bar).select("rule_id", "admitted", "wilson_lower")
    declared = F.lit(False)
    for pattern in verified:
        declared |= F.col("rule_id").rlike(glob(pattern, across=True))
    sure = F.coalesce(F.col("admitted"), F.lit(False)) & declared
    own = F.lit(deterministic) & (F.col("wilson_lower") >= bar["offline_lower"])
    tier = F.when(F.col("provenance") == "inferred", "inferred").when(~sure, "advisory").when(F.col("verdict") == "confirmed", "verified").when(F.col("verdict").isin("refuted", "uncertain"), "advisory").when(own, "verified").otherwise("advisory")
    return findings.join(rules, "rule_id", "left").withColumn("tier", tier).drop("admitted", "wilson_lower")


def scorecard(findings: DataFrame, outcomes: DataFrame, loc: DataFrame) -> DataFrame:
    """Per dimension that some check could apply to: score, coverage, findings, checks.

    outcomes: name, status, applicable, dimensions, checks; loc: one row, total_loc. A check that was prevented stays in
    the denominator, one that could never apply leaves it.
    """
    run = outcomes.where("applicable").select("status", F.greatest(F.col("checks"), F.lit(1)).alias("checks"), F.explode("dimensions").alias("dimension"))
    checks = run.groupBy("dimension").agg(F.sum("checks").alias("checks_applicable"), F.coalesce(F.sum(F.when(F.col("status") == "ran", F.col("checks"))), F.lit(0)).alias("checks_run"))
    found = findings.where(~F.col("suppressed")).groupBy("dimension").agg(F.sum(weight(F.col("severity"), F.col("confidence"))).alias("penalty"), F.count(F.lit(1)).alias("findings"))
    size = F.greatest(F.lit(1.0), F.sqrt(F.greatest(F.col("total_loc"), F.lit(1)) / 2000.0))
    out = checks.join(found, "dimension", "left").crossJoin(F.broadcast(loc))  # loc is one row
    score = F.greatest(F.lit(0.0), 100 - F.least(F.lit(100.0), F.coalesce("penalty", F.lit(0.0)) / size))
    return out.select("dimension", F.round(score, 1).alias("score"), F.round(F.least(F.lit(1.0), F.col("checks_run") / F.col("checks_applicable")), 3).alias("coverage"), F.coalesce("findings", F.lit(0)).alias("findings"), "checks_run", "checks_applicable")


def overall(card: DataFrame) -> DataFrame:
    """One row: coverage, overall (null when withheld) and withheld."""
    from findlake.operators.identity import lookup

    w = lookup(F.col("dimension"), DIMENSION_WEIGHTS, 0.1)
    coverage = F.coalesce(F.round(F.sum("checks_run") / F.sum("checks_applicable"), 3), F.lit(0.0))
    total = F.round(F.sum(F.col("score") * w) / F.when(F.sum(w) != 0, F.sum(w)).otherwise(1.0), 1)
    out = card.agg(coverage.alias("coverage"), total.alias("overall"))
    return out.select("coverage", F.when(F.col("coverage") >= COVERAGE_THRESHOLD, F.col("overall")).alias("overall"), (F.col("coverage") < COVERAGE_THRESHOLD).alias("withheld"))


def gate(findings: DataFrame, fail_on: dict, tiers: list[str] | None = None, inferred: bool = False) -> DataFrame:
    """One row: considered, at_severity, new_at, passed, failing ids (sorted)."""
    some = findings.where(~F.col("suppressed"))
    if not inferred:
        some = some.where("provenance <> 'inferred'")
    if tiers:
        some = some.where(F.coalesce("tier", F.lit("advisory")).isin(tiers))
    severe = at_least(F.col("severity"), fail_on.get("severity", ""))
    fresh = (F.col("status") == "new") & at_least(F.col("severity"), fail_on.get("new", ""))
    out = some.agg(F.count(F.lit(1)).alias("considered"), F.count_if(severe).alias("at_severity"), F.count_if(fresh).alias("new_at"))
    return out.withColumn("passed", (F.col("at_severity") == 0) & (F.col("new_at") == 0))


def gate_failures(findings: DataFrame, fail_on: dict) -> DataFrame:
    """The findings behind a failing gate, as rows and not as one list, however many."""
    some = findings.where(~F.col("suppressed") & (F.col("provenance") != "inferred"))
    severe = at_least(F.col("severity"), fail_on.get("severity", ""))
    fresh = (F.col("status") == "new") & at_least(F.col("severity"), fail_on.get("new", ""))
    return some.where(severe | fresh).select("id", "rule_id", "severity", "status")


def control_states(checks: DataFrame, outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    """Worst state of each control over the checks that satisfy it.

    checks: framework, control, rule (null for a control nothing checks). violated before not_assessed before satisfied;
    a control without a check is no_coverage.
    """
    hit = findings.where(~F.col("suppressed")).select("rule_id").distinct().withColumn("hit", F.lit(True))
    ran = outcomes.select(F.col("name").alias("probe"), "status")
    state = F.when(F.col("rule").isNull(), 2).when(F.col("hit"), 0).when(F.coalesce("status", F.lit("missing")) != "ran", 1).otherwise(3)
    rows = checks.join(hit, checks.rule == hit.rule_id, "left").join(ran, "probe", "left").withColumn("rank", state)
    worst = rows.groupBy("framework", "control").agg(F.min("rank").alias("rank"), F.count("rule").alias("checks"))
    names = F.element_at(F.array(*map(F.lit, ("violated", "not_assessed", "no_coverage", "satisfied"))), F.col("rank") + 1)
    return worst.select("framework", "control", names.alias("state"), "checks")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
