"""Every registered query against its SQL, and the operators that SQL can't express against plain loops."""

from __future__ import annotations

import pytest
from conftest import DATA, comparable

import findlake.queries  # noqa: F401
from findlake.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert comparable(ours) == comparable(theirs)
    assert len(ours)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count()


def test_entry_point_works_without_the_corpus_operators(spark, tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "findlake", tmp_path / "findlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scorecard' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2:3].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
