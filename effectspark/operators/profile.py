"""Descriptions of a rating frame: counts, means, extremes, plot data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectspark.functions import aggregates as A
from effectspark.sources.delimited import fact_join


def summary(
    df: DataFrame, strict_nulls: bool = False, count_null: bool = False, approx: bool = False
) -> DataFrame:
    """Rows, distinct items and users, mean and sample sd of the rating."""
    rating = F.col("rating")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        A.distinct_values(F.col("item_id"), count_null, approx).alias("items"),
        A.distinct_values(F.col("user_id"), count_null, approx).alias("users"),
        A.mean(rating, strict_nulls).alias("mean_rating"),
        A.sample_sd(rating, strict_nulls).alias("sd_rating"),
    )


def profile_by(
    df: DataFrame, key: str | Column, value: str = "rating", strict_nulls: bool = False
) -> DataFrame:
    """Mean of ``value`` and number of rows per key; a NULL key is a group."""
    return df.groupBy(key).agg(
        A.mean(F.col(value), strict_nulls).alias(f"mean_{value}"), F.count(F.lit(1)).alias("n")
    )


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def profile_by_item_attribute(
    ratings: DataFrame, items: DataFrame, key: Column, also_by: Sequence[str] = ()
) -> DataFrame:
    """:func:`profile_by` for a key made from item columns (and ``also_by``).

    Ratings are summed per item before the join, so the join sees one row per
    item instead of one per rating.
    """
    per_item = _per_item(ratings, also_by)
    return (
        fact_join(per_item, items)
        .groupBy(key)
        .agg((F.sum("__s") / F.sum("__n")).alias("mean_rating"), F.sum("__n").alias("n"))
    )


def count_by_item_attribute(ratings: DataFrame, items: DataFrame, key: str, name: str = "n") -> DataFrame:
    return fact_join(_per_item(ratings, ()), items).groupBy(key).agg(F.sum("__n").alias(name))


def sums_by_item_attribute(ratings: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, s, n): sum and number of ratings, summed per item before the join."""
    joined = fact_join(_per_item(ratings, ()), items)
    return joined.groupBy(key).agg(F.sum("__s").alias("s"), F.sum("__n").alias("n"))


def _per_item(ratings: DataFrame, also_by: Sequence[str]) -> DataFrame:
    return ratings.groupBy("item_id", *also_by).agg(
        F.sum("rating").alias("__s"), F.count(F.lit(1)).alias("__n")
    )


def mean_of_means(df: DataFrame, key: str, value: str = "rating") -> DataFrame:
    """Mean over groups of the group means, each group counting once."""
    means = df.groupBy(key).agg(F.avg(value).alias("group_mean"))
    return means.agg(F.avg("group_mean").alias(f"mean_of_{key}_means"))


def top_k(counts: DataFrame, by: str, ties: Sequence[str], k: int) -> DataFrame:
    return counts.orderBy(F.col(by).desc(), *ties).limit(k)


def greatest_row(df: DataFrame, by: str, ties: Sequence[str]) -> DataFrame:
    """One row with the greatest value; ties go to the lowest keys."""
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(1)


def least_row(df: DataFrame, by: str, ties: Sequence[str]) -> DataFrame:
    return df.filter(F.col(by).isNotNull()).orderBy(by, *ties).limit(1)


def first_per_item(ratings: DataFrame, order: Sequence[Column], ties: Sequence[str]) -> DataFrame:
    """Of each item the row that comes first by ``order`` and ``ties``.

    Partial aggregation leaves one row per item and task, so that a join with the
    items sees no more than one row per item.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)])
    row = F.struct(*ratings.columns)
    return ratings.groupBy("item_id").agg(F.min_by(row, rank).alias("__row")).select("__row.*")


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Rows per bin; a bin holds its lower edge, not its upper one.

    Bins are numbered in decimal arithmetic: 0.3 starts the fourth bin of width 0.1.
    """
    number = F.floor(_decimal(F.col(value)) / _decimal(F.lit(float(width))))
    counts = df.groupBy(number.alias("__bin")).agg(F.count(F.lit(1)).alias("n"))
    start = (F.col("__bin").cast("decimal(18,0)") * _decimal(F.lit(float(width)))).cast("double")
    return counts.select(start.alias("bin_start"), "n")


def _decimal(x: Column) -> Column:
    return x.cast("decimal(18,8)")


def density_grid(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """Counts of points per cell of a regular grid."""
    cell = [
        F.floor(F.col(c) / F.lit(float(w))).cast("bigint").alias(name)
        for c, w, name in ((x, x_width, "x_bin"), (y, y_width, "y_bin"))
    ]
    return df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
