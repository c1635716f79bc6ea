from __future__ import annotations

import pytest

from findlake.operators import assets, checks_off, routes
from findlake.sources import gaps

SCHEMA = "repo_id string, address string, kind string, native string, provider string, properties string, unknown array<string>, extra string"


def outcomes(spark, rows, rules):
    made = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {(r.address, r.rule_id): r.outcome for r in assets.evaluate(made, rules).collect()}


def test_equal_values_and_what_a_plan_leaves_open(spark):
    rule = assets.AssetRule("r", "property_equals", "low", ("k",), ("Mode",), ("Strict",))
    rows = [("a", "x1", "k", None, None, '{"mode": "strict"}', None), ("a", "x2", "k", None, None, '{"mode": "lax"}', []), ("a", "x3", "k", None, None, "{}", ["Mode"]), ("a", "x4", "other", None, None, "{}", [])]
    assert outcomes(spark, rows, [rule]) == {("x1", "r"): "satisfied", ("x2", "r"): "violated", ("x3", "r"): "unknown"}


def test_null_and_broken_properties_are_empty(spark):
    rule = assets.AssetRule("r", "property_truthy", "low", ("k",), ("on",))
    rows = [("a", "x1", "k", None, None, None, None), ("a", "x2", "k", None, None, "{broken", None), (None, "x3", "k", None, None, '{"on": [1]}', None), ("a", None, "k", None, None, '{"on": 0.0}', None), ("a", "x5", None, None, None, '{"on": 1}', None)]
    assert outcomes(spark, rows, [rule]) == {("x1", "r"): "violated", ("x2", "r"): "violated", ("x3", "r"): "satisfied", (None, "r"): "violated"}


def test_a_reference_of_its_own_or_of_another_repository_does_not_count(spark):
    rule = assets.AssetRule("r", "property_truthy", "low", ("k",), ("on",), unless_referenced_by=("log.to",))
    rows = [("a", "x1", "k", None, None, '{"log": {"to": "x1"}}', None), ("a", "x2", "k", None, None, '{"log": {"to": {"Ref": "X3"}}}', None), ("a", "x3", "k", None, None, "{}", None), ("b", "x3b", "k", None, None, '{"log": {"to": "x2"}}', None)]
    assert outcomes(spark, rows, [rule]) == {("x1", "r"): "violated", ("x2", "r"): "violated", ("x3", "r"): "satisfied", ("x3b", "r"): "violated"}


def test_unknown_assertions_are_refused_and_empty_tables_give_none(spark):
    with pytest.raises(ValueError, match="unknown assertion"):
        assets.outcome(assets.AssetRule("r", "nope", "low", ("k",)))
    assert outcomes(spark, [], None) == {}


def test_files_without_content_have_no_rows(spark):
    files = spark.createDataFrame([("r", "a", "go", None), ("r", "b", "go", ""), ("r", "c", "go", "x\n" * 50_000 + 'm.HandleFunc("DELETE /a", f)\nverify = False')], "repo_id string, path string, language string, content string")
    assert [(r.path, r.line_no, r.severity) for r in checks_off.disabled_checks(files).collect()] == [("c", 50_002, "high")]
    assert [(r.path, r.line_no, r.method, r.route, r.issue) for r in routes.open_routes(files).collect()] == [("c", 50_001, "delete", "/a", "destructive")]


def test_text_that_is_no_code_has_no_gaps():
    for text in ("", "def f(:", "x" * 100_000, "(" * 5_000, "a\0b"):
        assert not list(gaps.python_stubs(text)) and not list(gaps.python_growing_stores("import uuid\nuuid.uuid4()\n" + text))
