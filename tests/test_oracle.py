"""Every registered query against its SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from effectspark.plans import catalog, oracle

QUERIES = catalog.queries()
ORACLES = oracle.queries()


@pytest.fixture(scope="module")
def duck(tiny, table_names):
    con = duckdb.connect()
    for table in table_names:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tiny}/{table}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    expected = duck.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(map(tuple, expected.fetchall()))
    got = Counter(map(tuple, df.select(*[f"`{n}`" for n in names]).collect()))
    assert got == want
    assert want


def test_the_entry_point_registers_them():
    assert QUERIES.keys() <= entry_points.queries().keys()
    assert ORACLES.items() <= entry_points.oracle_sql().items()


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["user_id", "item_id", "epoch_s", "rating", "b_item", "b_user", "pred"]
    assert df.count() == 561
