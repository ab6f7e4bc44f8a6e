"""Merged sketches against exact distinct counts."""

import pytest
from pyspark.sql import functions as F

from effectspark.operators import sketches as K


def log(spark, n=40_000):
    hot = F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") * 7919 % 9001)
    return spark.range(n).select((F.col("id") % 20).alias("day"), hot.alias("user_id"), F.expr("IF(id % 11 = 0, NULL, id % 700)").alias("item_id"))


COLUMNS = ["user_id", "item_id"]


@pytest.mark.parametrize("days", ["day < 1", "day BETWEEN 3 AND 9", "true"])
def test_any_range_is_answered_from_summaries(spark, ws, days):
    rows = log(spark)
    kept = ws.save(K.summarize(rows, ["day"], COLUMNS), "days").df
    assert kept.count() == 20
    got = K.distinct_counts(kept.filter(days), [], COLUMNS).first()
    want = rows.filter(days).agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(c) for c in COLUMNS]).first()
    assert got["n"] == want["n"]
    for c in COLUMNS:
        assert abs(got[f"distinct_{c}"] - want[c]) <= K.ERROR * want[c]


def test_days_may_arrive_in_pieces(spark, ws):
    rows = log(spark)
    whole = K.distinct_counts(K.summarize(rows, ["day"], COLUMNS), ["day"], COLUMNS)
    pieces = [K.summarize(rows.filter(F.col("user_id") % 3 == k), ["day"], COLUMNS) for k in range(3)]
    merged = K.merge(pieces[0].unionByName(pieces[1]).unionByName(pieces[2]), ["day"], COLUMNS)
    other = {r["day"]: r for r in K.distinct_counts(merged, ["day"], COLUMNS).collect()}
    for r in whole.collect():
        assert r["n"] == other[r["day"]]["n"]
        for c in COLUMNS:
            assert abs(r[f"distinct_{c}"] - other[r["day"]][f"distinct_{c}"]) <= K.ERROR * r[f"distinct_{c}"]


def test_a_copy_of_a_summary_adds_no_values(spark):
    day = K.summarize(log(spark, 5000), ["day"], COLUMNS)
    once, twice = (K.distinct_counts(d, ["day"], COLUMNS).orderBy("day").collect() for d in (day, day.unionByName(day)))
    assert [r["distinct_user_id"] for r in once] == [r["distinct_user_id"] for r in twice]


def test_small_counts_are_exact_and_nulls_are_no_values(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (1, "b"), (1, "a"), (2, None)], "day int, v string")
    got = {r["day"]: (r["n"], r["distinct_v"]) for r in K.distinct_counts(K.summarize(df, ["day"], ["v"]), ["day"], ["v"]).collect()}
    assert got == {1: (4, 2), 2: (1, 0)}
    assert K.distinct_counts(K.summarize(df.filter("false"), ["day"], ["v"]), ["day"], ["v"]).isEmpty()


def test_sketches_of_two_sizes_merge(spark):
    rows = log(spark, 3000)
    both = K.summarize(rows, ["day"], COLUMNS, 12).unionByName(K.summarize(rows, ["day"], COLUMNS))
    got = K.distinct_counts(both, [], COLUMNS).first()["distinct_item_id"]
    assert abs(got - 700) <= 0.06 * 700


def test_sketches_are_made_before_the_shuffle(spark):
    plan = K.summarize(log(spark), ["day"], COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_hll_sketch_agg") > plan.index("Exchange")
