"""Every query of the catalogue against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from sitewright import catalog
from tests.helpers import as_set, table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    expected = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert table(catalog.queries()[name](spark, FOLDER)) == as_set(columns, expected.fetchall())


def test_every_query_without_sql_is_known():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_sample_is_a_bounded_repeatable_subset(spark):
    sample = catalog.queries()["downsample_by_group"]
    first, second = (sorted(map(tuple, sample(spark, FOLDER).collect())) for _ in range(2))
    everyone = set(map(tuple, catalog.cells(spark, FOLDER).select("cell_id", "gene").collect()))
    assert first == second and set(first) <= everyone and len(first) == len(set(first))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_down_and_stay_in_the_engine(spark):
    """Only the columns that are needed are read, and the hot path has no Python."""
    plan = catalog.bulk(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan.split("ReadSchema")[-1] and "Python" not in plan and plan.count("Exchange hashpartitioning") == 1
    plan = catalog.queries()["call_pipeline"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "lineitem" not in plan and plan.count("FileScan") <= 12
