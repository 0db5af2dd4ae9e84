"""Every registered query has a schema; checks cover the same names; smallest folder runs."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_entry(spark):
    q, o = E.queries(), E.oracle_sql()
    assert len(q) > 150 and set(o) <= set(q)
    assert E.entry(spark).count() > 0


def test_sample_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in "customer supplier part orders lineitem events embeddings".split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    q, o = E.queries(), E.oracle_sql()
    for name in ("trade_screed", "measurement_protocol", "reconcile_counts", "correction_rules", "wall_faces", "room_priority_merge"):
        df = q[name](spark, sf)
        cols = sorted(df.columns)
        r = c.execute(o[name])
        names = [d[0] for d in r.description]
        want = sorted(repr(tuple(row[names.index(k)] for k in cols)) for row in r.fetchall())
        assert sorted(repr(tuple(row)) for row in df.select(*cols).collect()) == want, name


@pytest.mark.parametrize("gone", [("qtospark/llm", "tests/llm"), ("qtospark/llm", "tests/llm", "corpus_pipeline.py")])
def test_imports_without_optional_parts(tmp_path, gone):
    """The entry and every other query are there when the optional subpackage is not."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *(os.path.basename(g) for g in gone)))
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()))"], cwd=copy, capture_output=True, text=True,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
    assert "trade_plaster" in said.stdout and "op1_" not in said.stdout and "'pipeline'" not in said.stdout
