"""Every registered query with SQL is compared with DuckDB; plans are checked for costly nodes."""

import importlib
import math
import runpy

import duckdb
import pytest

import __spark_entry__ as entry
from pluvigrid.checks import catalog, oracle
from tests_support import SF

QUERIES, ORACLE = catalog.queries(), oracle.oracle_sql()
TABLES = "region nation customer supplier orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert _sorted_rows(df.columns, df.collect()) == _sorted_rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_without_the_optional_parts(monkeypatch):
    """Without the corpus operators and the pipeline, the other queries stay registered."""
    missing = {"pluvigrid.llm", "pluvigrid.llm.queries", "corpus_pipeline"}
    find = importlib.import_module

    def absent(name):
        if name in missing:
            raise ModuleNotFoundError(f"No module named {name!r}", name="pluvigrid.llm" if "llm" in name else name)
        return find(name)

    monkeypatch.setattr(importlib, "import_module", absent)
    bare = runpy.run_path(entry.__file__)
    assert set(bare["queries"]()) == set(QUERIES) and set(bare["oracle_sql"]()) == set(ORACLE)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["clean_daily", "monthly_departure", "above_normal_probability", "feature_matrix", "district_overview", "score_lookup"]
)
def test_plan_has_no_costly_nodes(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert node not in plan


def test_gap_fill_never_shuffles_whole_series(spark):
    """Exchanges by district alone carry chunk edges, not readings."""
    plan = _plan(catalog.daily(spark, SF))
    assert "Exchange SinglePartition" not in plan
    for line in plan.splitlines():
        if "Window [" in line and ("__known" in line or "row_number" in line):
            assert "__chunk" in line


def test_filters_and_columns_reach_the_scan(spark):
    folder, _ = catalog._processed(spark, SF)
    from pluvigrid.operators import filters
    from pluvigrid.sources import processed

    kharif = filters.filter_season(processed.read_table(spark, folder, "seasonal"), "Kharif")
    plan = _plan(filters.filter_district(kharif, "Nation_3").select("year", "total_rainfall_mm"))
    assert "EqualTo(district_name,Nation_3)" in plan
    assert "ReadSchema: struct<district_name:string,year:int,total_rainfall_mm:double>" in plan
    assert "season" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
