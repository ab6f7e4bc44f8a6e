"""Distinct counts over any range of days, from small summaries that can be merged.

An exact distinct count has to read the log again for every range it is asked for. Here
the log is read once: per day and key a HyperLogLog sketch of each counted column, built
map-side. Sketches of any days and keys merge into the sketch of their union, so a range
is answered from the summaries alone; new days, or more rows of a known day, are added as
further summaries. The relative error is about 1.04 / sqrt(2 ** lg_k), whatever the counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14
ERROR = 0.03  # more than three standard errors at LG_K


def _sketch(column: str) -> str:
    return f"sketch_{column}"


def summarize(rows: DataFrame, by: Sequence[str], columns: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """(by, n, sketch_...): rows and distinct values per group; NULLs are not counted as values."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(_sketch(c)) for c in columns]
    )


def merge(summaries: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Summaries of coarser groups; sketches of different sizes meet at the smaller one."""
    return summaries.groupBy(*by).agg(
        F.sum("n").alias("n"), *[F.hll_union_agg(_sketch(c), True).alias(_sketch(c)) for c in columns]
    )


def distinct_counts(summaries: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, n, distinct_...): estimates for the union of all summaries of a group."""
    estimates = [F.hll_sketch_estimate(_sketch(c)).alias(f"distinct_{c}") for c in columns]
    return merge(summaries, by, columns).select(*by, "n", *estimates)
