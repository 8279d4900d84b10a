"""Every query with a SQL twin against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from stowage.plans import registry

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda x: "" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, duck, name):
    got, want = registry.queries()[name](spark, SMALL).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_twin(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_compare_plan_has_equality_joins_only(spark):
    plan = registry.queries()["compare_rows"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
