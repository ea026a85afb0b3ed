"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from inkwell.plans import registry


def _rows(table):
    table = table.select(sorted(table.column_names))
    show = lambda x: "" if x is None or x != x else (repr(round(x, 6)) if isinstance(x, float) else str(x))
    return sorted(tuple(show(v) for v in r.values()) for r in table.to_pylist())


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, folder, name):
    got = registry.queries()[name](spark, folder).toArrow()
    want = duck.execute(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, folder, name):
    assert registry.queries()[name](spark, folder).count() > 0
