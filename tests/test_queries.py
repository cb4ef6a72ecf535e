"""Each query equals its SQL, run by DuckDB on the same tables."""

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tallyglass.queries import ORACLE_SQL, QUERIES, outside

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(columns).collect())))
    if name in ORACLE_SQL:
        assert got == sorted(map(repr, duck.sql(ORACLE_SQL[name]).select(", ".join(f'"{c}"' for c in columns)).fetchall()))
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    """Only the columns that are needed are read, dates are filtered in the scan; facts are summed once if the dimensions are
    small, before the joins if they are not."""
    plan = lambda name: QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan("monthly_revenue")
    by_region = plan("revenue_by_region")
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in by_region and by_region.count("HashAggregate") == 2 and by_region.count("BroadcastHashJoin") == 3
    assert "TakeOrderedAndProject" in plan("top5_products")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        by_region = plan("revenue_by_region")
        assert by_region.count("HashAggregate") == 4 and by_region.count("SortMergeJoin") == 3
        assert QUERIES["revenue_by_region"](spark, SF).count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_not_in_knows_nulls(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (None,)], "j int")
    keys = lambda others: sorted(r["k"] for r in outside(a, "k", others, "j").collect() if r["k"] is not None)
    assert keys(b) == [] and keys(b.filter("j is not null")) == [1] and outside(a, "k", b.filter("false"), "j").count() == 3


@pytest.mark.parametrize("missing", ["the subpackage", "one of its dependencies", "the pipeline"])
def test_entry_without_the_subpackage(tmp_path, missing):
    root = Path(entry.__file__).parent
    shutil.copytree(root / "tallyglass", tmp_path / "tallyglass", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if missing == "the subpackage" else [])))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if missing != "the pipeline" else [])):
        shutil.copy(root / name, tmp_path)
    if missing == "one of its dependencies":
        (tmp_path / "xxhash.py").write_text("raise ImportError('gone')")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    names = set(run.stdout.split())
    has_llm = (root / "tallyglass" / "llm").exists() and missing == "the pipeline"
    assert set(QUERIES) <= names and "pipeline" not in names and any(n.startswith("op1_") for n in names) == has_llm
