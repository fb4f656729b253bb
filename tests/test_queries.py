"""The registered queries against their SQL, where the driver's tables exist."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from brinewave.plans import queries as plans

TABLES = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not TABLES.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    a, b = plans.QUERIES[name](spark, str(TABLES)).toPandas(), con.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    rows = lambda f: sorted((tuple(None if x != x or x is None else x for x in r) for r in f[columns].itertuples(index=False)), key=str)
    assert rows(a) == rows(b)


@pytest.mark.skipif(not TABLES.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, str(TABLES)).count() > 0


def test_iterations_and_restarts_of_the_reference(spark, monkeypatch):
    seen = {}

    class Done(Exception):
        pass

    def note(df, *args, **options):
        seen.update(options)
        raise Done

    monkeypatch.setattr(plans, "vectors", lambda spark, d: spark.range(1))
    for name in ("normalize", "standardize"):
        monkeypatch.setattr(plans.cluster, name, lambda df, *args: df)
    monkeypatch.setattr(plans.cluster, "pca", lambda df, *args: (df.select("id").toDF("pcs").withColumn("vec_id", plans.F.lit(1)), None, None))
    for name in ("tsne", "kmeans"):
        monkeypatch.setattr(plans.cluster, name, note)
    for name in ("tsne", "cluster_scatter"):
        with pytest.raises(Done):
            plans.QUERIES[name](spark, "")
    assert seen["iterations"] == 2000 and seen["restarts"] == 10


def test_entry_without_the_llm_part(tmp_path):
    """The entry module imports without that folder, and this package never needs it."""
    root = Path(__file__).resolve().parents[1]
    for p in (root / "brinewave").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text()
    shutil.copytree(root / "brinewave", tmp_path / "brinewave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()) > 50, any(n.startswith('op') and n[2].isdigit() for n in e.queries()), 'pipeline' in e.oracle_sql())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split() == ["True", "False", "False"]


def test_missing_library_of_the_llm_part_is_not_hidden(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "brinewave", tmp_path / "brinewave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_library")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert run.returncode and "no_such_library" in run.stderr
