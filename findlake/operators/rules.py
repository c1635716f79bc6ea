"""Rule packs over captures, house rules, governance and data flow, as joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.functions.text import glob
from findlake.plans.checkpoint import cut


@dataclass(frozen=True)
class PackRule:
    """What a rule captures and the conditions that keep a hit; names are capture kinds."""

    rule_id: str
    captures: str
    unless_inside: tuple[str, ...] = ()
    requires_in_scope: tuple[str, ...] = ()
    unless_in_scope: tuple[str, ...] = ()
    requires_file: tuple[str, ...] = ()
    unless_in_file: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    languages: tuple[str, ...] = field(default=())


def run_rule(captures: DataFrame, scopes: DataFrame, rule: PackRule) -> DataFrame:
    """rule_id, repo_id, path, start, end of a rule's hits, one a start.

    captures: repo_id, path, language, kind, start, end; scopes: repo_id, path, start, end (functions; what lies in none has
    its file for a scope). Each condition is a semi or anti join on repository and path, with the places as its condition.
    """
    hits = captures.where(F.col("kind") == rule.captures)
    if rule.languages:
        hits = hits.where(F.col("language").isin(*rule.languages))
    if rule.paths:
        on = F.lit(False)
        for p in rule.paths:
            on |= F.col("path").rlike(glob(p))
        hits = hits.where(on)
    hits = hits.groupBy("repo_id", "path", "start").agg(F.max("end").alias("end"))
    s = scopes.select(F.col("repo_id").alias("r"), F.col("path").alias("p"), F.col("start").alias("s0"), F.col("end").alias("s1"))
    scoped = hits.join(s, (F.col("repo_id") == F.col("r")) & (F.col("path") == F.col("p")) & (F.col("s0") <= F.col("start")) & (F.col("s1") >= F.col("end")), "left")
    inner = F.min_by(F.struct("s0", "s1"), F.when(F.col("s0").isNotNull(), F.col("s1") - F.col("s0")))
    hits = scoped.groupBy("repo_id", "path", "start", "end").agg(inner.alias("scope"))
    hits = hits.withColumn("from", F.coalesce("scope.s0", F.lit(-1))).withColumn("to", F.coalesce("scope.s1", F.lit(1 << 60)))

    def others(kinds: tuple[str, ...]) -> DataFrame:
        return captures.where(F.col("kind").isin(*kinds)).select(F.col("repo_id").alias("r"), F.col("path").alias("p"), F.col("start").alias("a"), F.col("end").alias("b"))

    same = (F.col("repo_id") == F.col("r")) & (F.col("path") == F.col("p"))
    inside = same & (F.col("a") <= F.col("start")) & (F.col("b") >= F.col("end"))
    in_scope = same & (F.col("a") >= F.col("from")) & (F.col("b") <= F.col("to"))
    for kinds, on, how in ((rule.unless_inside, inside, "left_anti"), (rule.requires_in_scope, in_scope, "left_semi"), (rule.unless_in_scope, in_scope, "left_anti"), (rule.requires_file, same, "left_semi"), (rule.unless_in_file, same, "left_anti")):
        if kinds:
            hits = hits.join(others(kinds), on, how)
    return hits.select(F.lit(rule.rule_id).alias("rule_id"), "repo_id", "path", "start", "end")


def house_rules(files: DataFrame, rules: list[dict]) -> DataFrame:
    """id, path of each breach. Types: file_exists, file_absent, content_match (forbidden text), metric_threshold (lines).

    One scan decides every rule about single files, another, of paths alone, those about files that must exist.
    """

    def broken(r: dict) -> Column:
        on = F.col("path").rlike(glob(r["path"]))
        if r["type"] == "content_match":
            on &= F.col("content").rlike(r["pattern"])
        elif r["type"] == "metric_threshold":
            on &= F.size(F.split("content", "\n")) > r["max"]
        return F.when(on, F.lit(r["id"]))

    for r in rules:
        if r["type"] not in ("file_exists", "file_absent", "content_match", "metric_threshold"):
            raise ValueError(f"unknown house rule type {r['type']}")
    wanted, single = [r for r in rules if r["type"] == "file_exists"], [r for r in rules if r["type"] != "file_exists"]
    nothing = F.array().cast("array<string>")
    # an inner explode would have its condition, with every rule in it, computed once more below
    found = files.select(F.explode_outer(F.array(*map(broken, single)) if single else nothing).alias("id"), "path").where("id is not null")
    if not wanted:
        return found
    counts = files.agg(*[F.count_if(F.col("path").rlike(glob(r["path"]))).alias(f"n{i}") for i, r in enumerate(wanted)])
    absent = F.array(*[F.struct(F.lit(r["id"]).alias("id"), F.lit(r["path"]).alias("path"), F.col(f"n{i}").alias("n")) for i, r in enumerate(wanted)])
    return found.unionByName(counts.select(F.inline(absent)).where("n = 0").select("id", "path"))


def reference_integrity(references: DataFrame, anchors: DataFrame) -> DataFrame:
    """References (ref) that no anchor answers by lower case or slug."""
    slug = F.trim(F.regexp_replace(F.lower("anchor"), "[^a-z0-9]+", "-"), F.lit("-"))
    keys = anchors.select(F.lower("anchor").alias("__k")).union(anchors.select(slug)).distinct()
    return references.join(keys, F.lower("ref") == F.col("__k"), "left_anti")


def untested_failures(failures: DataFrame, changed: DataFrame) -> DataFrame:
    """Open failures that affect a changed path and have none of their tests changed. failures: id, status, paths, tests."""
    now = changed.select(F.col("path").alias("__path")).distinct()
    touched = failures.where("status = 'open'").select("id", F.explode("paths").alias("__path")).join(now, "__path", "left_semi").select("id").distinct()
    tested = failures.select("id", F.explode("tests").alias("__path")).join(now, "__path", "left_semi").select("id").distinct()
    return touched.join(tested, "id", "left_anti")


def missing_tests(failures: DataFrame, files: DataFrame) -> DataFrame:
    """id, path of regression tests that fixed failures name and no file has."""
    named = failures.where("status = 'fixed'").select("id", F.explode("tests").alias("path"))
    return named.join(files.select("path").distinct(), "path", "left_anti").select("id", "path")


# fixed values: how sure a value is to be tainted, least first
LATTICE = ("clean", "derived", "unknown", "taint")


def taint(uses: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, state: the worst state that reaches each node along def-use edges within some hops; a sanitiser's edge cuts.

    uses: source, target, cleans; start: node, state. Each round joins what grew in the last one and keeps maxima.
    """
    rank = F.array_position(F.array(*map(F.lit, LATTICE)), F.col("state")).cast("int")
    best = cut(start.groupBy("node").agg(F.max(rank).alias("k")))
    grown = best
    steps = uses.where("not cleans").select("source", F.col("target").alias("node"))
    for _ in range(depth):
        reached = grown.withColumnRenamed("node", "source").join(steps, "source").groupBy("node").agg(F.max("k").alias("new"))
        both = cut(best.join(reached, "node", "full_outer").select("node", F.greatest(F.coalesce("k", F.lit(0)), F.coalesce("new", F.lit(0))).alias("k"), (F.coalesce("new", F.lit(0)) > F.coalesce("k", F.lit(0))).alias("moved")))
        best, grown = both.drop("moved"), both.where("moved").drop("moved")
        if grown.isEmpty():
            break
    return best.select("node", F.element_at(F.array(*map(F.lit, LATTICE)), F.col("k")).alias("state"))


def withheld(run: dict[str, Column]) -> Column:
    """Why a grade is withheld, the first reason that holds; null when it stands."""
    return F.when(run["partial"], "partial").when(run["files_read"] == 0, "nothing_read").when(run["skipped_share"] > 0.2, "files_not_read").when(run["unassessed"] > 0, "unassessed_languages").when(run["coverage"] < 0.6, "coverage")


def applicability(outcomes: DataFrame) -> DataFrame:
    """name, in_denominator, prevented: a check that could never apply leaves the denominator, one that was kept from running stays."""
    return outcomes.select("name", F.col("applicable").alias("in_denominator"), (F.col("applicable") & (F.col("status") == "skipped")).alias("prevented"))
