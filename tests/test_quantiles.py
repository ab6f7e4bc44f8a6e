"""Exact quantiles against a sorted list, for every type and order of values."""

import datetime as dt
import math
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from effectspark.operators import quantiles, split
from effectspark.operators.quantiles import exact_quantiles

r = random.Random(5)
NAN = float("nan")
VALUES = {
    "bigint": [*(r.randrange(-(2**63), 2**63) for _ in range(300)), 2**63 - 1, -(2**63), 0, -1, 1, *[7] * 200],
    "int": [r.randrange(-50, 50) for _ in range(500)],
    "tinyint": [1] * 9,
    "double": [*(r.uniform(-1, 1) * 10.0 ** r.randrange(-300, 300) for _ in range(400)), -0.0, 0.0, 5e-324, -5e-324, math.inf, -math.inf, NAN, NAN, *[0.1] * 60],
    "float": [float(r.randrange(-9, 9)) / 4 for _ in range(101)],
    "date": [dt.date(1900, 1, 1) + dt.timedelta(days=r.randrange(90000)) for _ in range(200)],
    "timestamp": [dt.datetime(1969, 12, 31) + dt.timedelta(microseconds=r.randrange(10**12)) for _ in range(200)],
    "timestamp_ntz": [dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=r.randrange(10**9)) for _ in range(200)],
    "decimal(18,4)": [Decimal(r.randrange(-(10**17), 10**17)).scaleb(-4) for _ in range(200)],
    "boolean": [True] * 3 + [False] * 8,
}


def order(x):
    return (isinstance(x, float) and math.isnan(x), 0 if isinstance(x, float) and math.isnan(x) else x)


def plain(values, groups):
    values = sorted((v for v in values if v is not None), key=order)
    return [values[-(-len(values) * i // groups) - 1] for i in range(1, groups)] if values else []


@pytest.mark.parametrize("kind", VALUES)
@pytest.mark.parametrize("groups", [2, 5, 16])
def test_types(spark, ws, kind, groups):
    values = [*VALUES[kind], None, None]
    df = ws.save(spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3), "values").df
    got = exact_quantiles(df, ["v"], groups, ws)["v"]
    assert list(map(str, got)) == list(map(str, plain([v + 0.0 if v == 0 and kind == "double" else v for v in values if v is not None], groups)))


def test_several_columns_at_once(spark, ws):
    rows = [(k, float(k % 7), None, dt.date(2020, 1, 1 + k % 9)) for k in range(200)]
    df = ws.save(spark.createDataFrame(rows, "a int, b double, c int, d date"), "values").df
    want = {c: plain([row[k] for row in rows], 4) for k, c in enumerate("abcd")}
    assert exact_quantiles(df, list("abcd"), 4, ws) == want


def test_few_rows(spark, ws):
    empty = spark.createDataFrame([], "v bigint")
    assert exact_quantiles(empty, ["v"], 5, ws) == {"v": []}
    assert exact_quantiles(spark.range(1).toDF("v"), ["v"], 5, ws) == {"v": [0] * 4}
    assert exact_quantiles(spark.range(9).toDF("v"), ["v"], 1, ws) == {"v": []}
    assert exact_quantiles(spark.range(9).toDF("v"), [], 4, ws) == {}
    with pytest.raises(ValueError):
        exact_quantiles(empty, ["v"], 0, ws)


def test_values_without_a_64_bit_order_are_refused(spark, ws):
    for kind in ("string", "decimal(30,2)"):
        with pytest.raises(TypeError):
            exact_quantiles(spark.createDataFrame([], f"v {kind}"), ["v"], 2, ws)


def test_equal_to_sql(spark, ws, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    got = exact_quantiles(lines, ["l_extendedprice", "l_shipdate"], 10, ws)
    levels = [i / 10 for i in range(1, 10)]
    for c in got:
        want = duckdb.execute(f"SELECT quantile_disc({c}, {levels}) FROM '{small}/lineitem.parquet'").fetchone()[0]
        assert got[c] == want


def test_ranges_are_counted_in_a_bounded_table(spark, ws, monkeypatch):
    """A skewed column: nearly all rows share one range, and no pass keeps more rows than ranges."""
    saved = []
    save = type(ws).save
    monkeypatch.setattr(type(ws), "save", lambda self, *a, **k: saved.append(save(self, *a, **k)) or saved[-1])
    df = spark.range(200_000).select((F.col("id") % 1000 + (1 << 40)).alias("v"))
    assert exact_quantiles(df, ["v"], 4, ws)["v"] == [(1 << 40) + k for k in (249, 499, 749)]
    assert [t.rows for t in saved] == [1, 1, 1000]
    assert quantiles.LEVELS[0] + quantiles.BITS == 64


def test_strata(spark, ws):
    df = spark.range(103).select((F.col("id") * 1.5).alias("v"))
    strata = df.select(split.quantile_strata(df, "v", ws, 4).alias("s")).groupBy("s").count().collect()
    assert dict(strata) == {0: 26, 1: 26, 2: 26, 3: 25}
