"""Derived columns of a rating frame: review calendar, release year, age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectspark.functions import columns as C

CALENDAR = ("review_year", "review_month", "review_wday", "review_mday", "review_hour")

_YEAR_METHODS = {"slice": C.year_by_slice, "regex": C.year_by_pattern}


def add_reviewed_at(df: DataFrame, epoch: str = "epoch_s") -> DataFrame:
    return df.withColumn("reviewed_at", F.timestamp_seconds(epoch))


def add_calendar(df: DataFrame, epoch: str = "epoch_s") -> DataFrame:
    """UTC year, month, weekday (Sunday = 1), day of month and hour, as ints."""
    day = C.utc_date(F.col(epoch))
    return df.withColumns(
        {
            "review_year": F.year(day),
            "review_month": F.month(day),
            "review_wday": F.dayofweek(day),
            "review_mday": F.day(day),
            "review_hour": C.utc_hour(F.col(epoch)),
        }
    )


def add_release_year(df: DataFrame, title: str = "title", method: str = "slice") -> DataFrame:
    return df.withColumn("release_year", _YEAR_METHODS[method](F.col(title)))


def add_age(df: DataFrame) -> DataFrame:
    """Years between release and review; negative values are kept."""
    return df.withColumn("age_at_review", F.col("review_year") - F.col("release_year"))


def add_all(df: DataFrame, method: str = "slice") -> DataFrame:
    """Review time and calendar, release year and age."""
    return add_age(add_release_year(add_calendar(add_reviewed_at(df)), method=method))


def unparsed_year(df: DataFrame) -> DataFrame:
    """Rows whose title gave no release year."""
    return df.filter(F.col("release_year").isNull())


def preview(df: DataFrame, columns: list[str], order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in a stated order (a frame has none of its own)."""
    return df.orderBy(*order).select(*columns).limit(n)
