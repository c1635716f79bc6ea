from __future__ import annotations

import random

from findlake.functions.text import glob
from findlake.operators import matching


def test_sites_are_anchored_not_chained(spark):
    rows = [("d1", "r", "p", 10), ("d2", "r", "p", 13), ("d1", "r", "p", 16), ("d3", "r", "q", 5)]
    found = matching.cluster_sites(spark.createDataFrame(rows, "detector string, repo string, path string, line int"), ["repo", "path"])
    assert sorted((r.path, r.anchor, r.detectors, r.members) for r in found.collect()) == [("p", 10, ["d1", "d2"], 2), ("p", 16, ["d1"], 1), ("q", 5, ["d3"], 1)]


def test_sites_against_a_plain_loop(spark):
    rnd = random.Random(3)
    rows = [(f"d{rnd.randrange(3)}", "r", f"p{rnd.randrange(5)}", rnd.randrange(60)) for _ in range(300)]
    found = matching.cluster_sites(spark.createDataFrame(rows, "detector string, repo string, path string, line int"), ["repo", "path"])
    expected = []
    for path in sorted({r[2] for r in rows}):
        mine = sorted((line, d) for d, _, p, line in rows if p == path)
        while mine:
            anchor = mine[0][0]
            members = [m for m in mine if m[0] - anchor <= 3]
            expected.append((path, anchor, sorted({d for _, d in members}), len(members)))
            mine = mine[len(members) :]
    assert sorted((r.path, r.anchor, r.detectors, r.members) for r in found.collect()) == sorted(expected)


def _pairs(a, b):
    """Each finding of a and b once: equal ids, then near lines, then like wording."""
    out, left, free = [], [], list(b)
    for f in a:
        hit = next((g for g in free if g[1] == f[1]), None)
        if hit:
            free.remove(hit)
            out.append((f[0], hit[0], "fingerprint"))
        else:
            left.append(f)
    a, left = left, []
    for f in a:
        hit = next((g for g in free if g[2] == f[2] and g[3] and f[3] and abs(g[3] - f[3]) <= 2), None)
        if hit:
            free.remove(hit)
            out.append((f[0], hit[0], "location"))
        else:
            left.append(f)
    for f in left:
        score = lambda g: len(set(f[4].split()) & set(g[4].split())) / len(set(f[4].split()) | set(g[4].split()))  # noqa: B023, E731
        best = max((g for g in free if g[2] == f[2]), key=lambda g: (score(g), -g[0]), default=None)
        if best and score(best) >= 0.5:
            free.remove(best)
            out.append((f[0], best[0], "wording"))
        else:
            out.append((f[0], None, "only_a"))
    return sorted([*out, *((None, g[0], "only_b") for g in free)], key=str)


def test_comparison_of_runs_against_a_plain_loop(spark):
    rnd = random.Random(5)
    words = ["alpha", "bravo", "charlie", "delta", "echo"]
    make = lambda base: [(base + i, f"f{rnd.randrange(40)}", f"p{rnd.randrange(4)}", rnd.choice([0, *range(1, 60)]), " ".join(sorted(rnd.sample(words, 3)))) for i in range(60)]
    a, b = make(0), make(1000)
    schema = "seq long, id string, path string, start_line int, title string, repo_id string, rule_id string"
    frames = [spark.createDataFrame([(*r, "r", "x/" + r[4].split()[0]) for r in rows], schema) for rows in (a, b)]
    found = matching.compare(*frames)
    assert sorted([(r.a, r.b, r.how) for r in found.collect()], key=str) == _pairs(a, b)


def test_ground_truth_uses_each_finding_once(spark):
    expected = spark.createDataFrame([("x1", "p", 1, "token & assigned", None), ("x2", "p", 2, "token", None), ("x3", "p", 3, "token", None), ("x4", "q", 1, "", "quality")], "item string, path string, ord int, match string, dimension string")
    rows = spark.createDataFrame([(1, "p", "secret/token", "Assigned", "security"), (2, "p", "a", "token", "security"), (3, "q", "b", "c", "security")], "seq long, path string, rule_id string, title string, dimension string")
    assert sorted((r.item, r.seq) for r in matching.ground_truth(expected, rows).collect()) == [("x1", 1), ("x2", 2), ("x3", None), ("x4", None)]


def test_one_file_with_many_findings_is_settled_without_holding_each_against_all(spark):
    import time

    n, BIG = 20_000, 1 << 60  # a float does not hold such a number
    made = spark.range(n).selectExpr(f"id + {BIG}L as seq", "'p' as path", "case when id % 2 = 0 then 'secret/a' else 'b' end as rule_id", "'Some title' as title", "'security' as dimension", "cast(id as string) as id", "'r' as repo_id", "cast(id * 10 + 1 as int) as start_line")
    items = spark.range(n).selectExpr("concat('x', id) as item", "'p' as path", "cast(id as int) as ord", "'secret & title' as match", "cast(null as string) as dimension")
    begun = time.time()
    found = sorted((int(r.item[1:]), r.seq) for r in matching.ground_truth(items, made).collect())
    assert found == [(i, BIG + 2 * i if i < n // 2 else None) for i in range(n)]
    other = made.selectExpr("seq + 100000 as seq", "path", "rule_id", "title", "dimension", "concat('y', id) as id", "repo_id", "start_line + 1000000 as start_line")
    pairs = sorted((r.a, r.b, r.how) for r in matching.compare(made, other).collect())
    assert pairs == [(BIG + i, BIG + 100_000 + i, "wording") for i in range(n)]
    assert time.time() - begun < 60  # every pair of one file: 400 million


def test_path_patterns():
    import re

    hit = lambda pattern, path, **k: bool(re.search(glob(pattern, **k), path))
    assert hit("**/*.py", "a.py") and hit("**/*.py", "x/y/a.py") and not hit("*.py", "x/a.py") and hit("*.py", "x/a.py", across=True)
    assert hit("src/**", "src/a/b") and not hit("src/**", "lib/src/a") and hit("a/[!b]?.txt", "a/cd.txt") and not hit("a/[!b]?.txt", "a/bd.txt") and hit("./x/*", "x/y")
