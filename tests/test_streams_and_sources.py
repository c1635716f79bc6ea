from __future__ import annotations

import json

from conftest import DATA
from pyspark.sql import functions as F

from findlake.operators import graph, incremental
from findlake.sources import readers, sinks
from findlake.streaming import events


def test_rate_limit_against_a_plain_loop(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("t")).collect()
    kept, expected = {}, {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.t, r.event_id)):
        mine = [t for t in kept.get(r.user_id, []) if r.t - t < 864000]
        if expected.setdefault(r.event_id, len(mine) < 2):
            mine.append(r.t)
        kept[r.user_id] = mine
    stream = events.stream(spark, DATA, "events").select("event_id", "user_id", "ts")
    found = {r.event_id: r.allowed for r in events.run(events.limit_rate(stream, "user_id", 2, 864000)).collect()}
    assert found == expected and not all(found.values())


def test_sessions_and_sliding_windows_run(spark):
    rows = events.stream(spark, DATA, "events")
    assert events.run(events.sessions(rows, "30 minutes", "10 minutes", "user_id")).count()
    assert events.run(events.sliding_counts(rows, "1 hour", "30 minutes", "10 minutes", "event_type")).count()


def test_tree_reads_text_and_says_what_it_skips(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01\x02")
    (tmp_path / "u.txt").write_bytes("﻿hey".encode("utf-16-le"))
    rows = {r.path: r for r in readers.tree(spark, str(tmp_path), "r").collect()}
    assert rows["src/a.py"].content == "x = 1\n" and rows["src/a.py"].language == "python" and rows["src/a.py"].role == "source"
    assert rows["b.bin"].skipped == "binary" and rows["b.bin"].content is None and rows["u.txt"].content == "hey"


def test_records_are_checked(spark, tmp_path):
    import pytest

    (tmp_path / "h.jsonl").write_text('{"time": "2026-01-01T00:00:00", "score": 1.5}\nbroken\n{"score": 2}\n')
    assert [r.score for r in readers.history(spark, str(tmp_path / "h.jsonl")).collect()] == [1.5]
    (tmp_path / "l.jsonl").write_text('{"finding_id": "a", "label": "maybe", "role": "labeller"}\n')
    with pytest.raises(Exception, match="unknown label"):
        readers.label_records(spark, str(tmp_path / "l.jsonl")).collect()
    (tmp_path / "e.csv").write_text("# name, category\nT1,sqli,true,89\n")
    assert [tuple(r) for r in readers.expected_results(spark, str(tmp_path / "e.csv")).collect()] == [("T1", "sqli", True, 89)]


def test_plan_resources(spark, tmp_path):
    plan = {"planned_values": {"root_module": {"resources": [{"address": "a.b", "type": "a", "values": {"x": {"y": 1}}}]}}, "resource_changes": [{"address": "a.b", "change": {"after_unknown": {"arn": True, "x": False}}}]}
    (tmp_path / "p.json").write_text(json.dumps(plan))
    row = readers.planned_resources(spark, str(tmp_path / "p.json")).select("address", "type", "unknown", readers.pick(F.col("properties"), "$.x.y", "int").alias("y")).first()
    assert tuple(row) == ("a.b", "a", ["arn"], 1)


def test_sarif_document(spark):
    rows = spark.createDataFrame([("r/x", "T", "high", "low", "repo", "p", 0, "f:1")], "rule_id string, title string, severity string, confidence string, repo_id string, path string, start_line int, id string")
    doc = json.loads(sinks.sarif_document(rows))
    result = doc["runs"][0]["results"][0]
    assert result["level"] == "error" and result["locations"][0]["physicalLocation"]["region"]["startLine"] == 1


def test_cache_replay_equals_recomputing(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "i long, content string").withColumn("key", incremental.cache_key(F.col("content"), F.lit("r")))
    work = lambda df: df.select("key", F.length("content").alias("n"))
    cache = work(rows.where("i < 6"))
    assert incremental.diverged(incremental.replay(rows, cache, work(incremental.misses(rows, cache))), work(rows)).isEmpty()


def test_walks_end_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "source string, target string")
    found = {r.node: r.hops for r in graph.reach(edges, spark.createDataFrame([("a",)], "node string"), 10).collect()}
    assert found == {"a": 0, "b": 1, "c": 2}
    assert graph.shortest_path(edges, "a", "e").isEmpty()
