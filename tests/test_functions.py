"""Column functions on edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from effectspark.functions import aggregates as A
from effectspark.functions import columns as C
from effectspark.operators import features


def one(df):
    return df.first()[0]


@pytest.mark.parametrize(
    "title, by_slice, by_pattern",
    [
        ("Boomerang (1992)", 1992, 1992),
        ("Boomerang (1992) ", None, 1992),
        ("Untitled", None, None),
        ("X (199d)", None, None),
        ("ab", None, None),
        ("", None, None),
        ("Twice (1950) (1992)", 1992, 1992),
    ],
)
def test_release_year(spark, title, by_slice, by_pattern):
    df = spark.createDataFrame([(title,)], "title string")
    assert features.add_release_year(df).first()["release_year"] == by_slice
    assert features.add_release_year(df, method="regex").first()["release_year"] == by_pattern


def test_right_chars_of_short_text(spark):
    df = spark.createDataFrame([("ab",)], "t string")
    assert one(df.select(C.right_chars(F.col("t"), 5))) == "ab"
    assert one(df.select(C.drop_last_char(F.col("t")))) == "a"


def test_calendar_parts(spark):
    df = features.add_calendar(spark.createDataFrame([(838985046,)], "epoch_s bigint"))
    row = df.first().asDict()
    assert row == {
        "epoch_s": 838985046, "review_year": 1996, "review_month": 8, "review_wday": 6,
        "review_mday": 2, "review_hour": 11,
    }
    assert {t for c, t in df.dtypes if c != "epoch_s"} == {"int"}


def test_calendar_before_1970_and_in_another_zone(spark):
    df = features.add_calendar(spark.createDataFrame([(-1,)], "epoch_s bigint"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        row = df.first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert (row["review_year"], row["review_month"], row["review_mday"], row["review_hour"]) == (1969, 12, 31, 23)


def test_reviewed_at_is_utc(spark):
    df = features.add_reviewed_at(spark.createDataFrame([(838985046,)], "epoch_s bigint"))
    assert one(df.select(F.col("reviewed_at").cast("timestamp_ntz"))) == dt.datetime(1996, 8, 2, 11, 24, 6)


def test_negative_age_is_kept(spark):
    df = spark.createDataFrame([(1999, 2003), (1999, None)], "review_year int, release_year int")
    assert [r["age_at_review"] for r in features.add_age(df).collect()] == [-4, None]


def test_sunday_is_day_one(spark):
    df = features.add_calendar(spark.createDataFrame([(3 * 86400,)], "epoch_s bigint"))
    assert df.first()["review_wday"] == 1


def test_hash_does_not_depend_on_partitioning(spark):
    df = spark.range(1000).withColumn("h", C.row_hash("id"))
    again = spark.range(1000).repartition(7).withColumn("h", C.row_hash("id"))
    assert df.exceptAll(again).isEmpty()
    assert not df.exceptAll(spark.range(1000).withColumn("h", C.row_hash("id", seed="x"))).isEmpty()


def test_strict_nulls_and_distinct_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    x = F.col("x")
    assert one(df.agg(A.mean(x))) == 2.0
    assert one(df.agg(A.mean(x, strict_nulls=True))) is None
    assert one(df.agg(A.sample_sd(x, strict_nulls=True))) is None
    assert one(df.agg(A.distinct_values(x))) == 2
    assert one(df.agg(A.distinct_values(x, count_null=True))) == 3


def test_double_sql_is_exact(spark):
    for x in (0.1, 1 / 3, -2.5e-17, 1e300, 3.058146829277293):
        assert one(spark.range(1).select(F.expr(A.double_sql(x)))) == x


def test_rmse(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "a double, b double")
    assert one(df.agg(A.rmse(F.col("a"), F.col("b")))) == pytest.approx(0.5**0.5)
