"""Aggregate expressions shared by profiles, fits and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_any_null(agg: Column, value: Column) -> Column:
    """``agg``, but NULL as soon as one input value is NULL."""
    return F.when(F.count_if(value.isNull()) == 0, agg)


def mean(value: Column, strict_nulls: bool = False) -> Column:
    out = F.avg(value)
    return null_if_any_null(out, value) if strict_nulls else out


def sample_sd(value: Column, strict_nulls: bool = False) -> Column:
    out = F.stddev_samp(value)
    return null_if_any_null(out, value) if strict_nulls else out


def distinct_values(value: Column, count_null: bool = False, approx: bool = False) -> Column:
    out = F.approx_count_distinct(value) if approx else F.count_distinct(value)
    if count_null:
        out = out + F.coalesce(F.max(value.isNull().cast("int")), F.lit(0))
    return out


def double_sql(value: float | None) -> str:
    """A double as SQL text that reads back as the same double."""
    return "CAST(NULL AS DOUBLE)" if value is None else f"double('{value!r}')"


def shrunk_sql(total: str, n: str, lambda_: float) -> str:
    """Group mean pulled towards 0 by ``lambda_`` extra rows; plain mean at 0.

    SQL text, because a sweep builds hundreds of these and text costs the
    driver one call each.
    """
    return f"try_divide({total}, {n} + {double_sql(float(lambda_))})"


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(actual - predicted, 2)))
