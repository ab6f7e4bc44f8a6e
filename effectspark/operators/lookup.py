"""Left join of a large frame to a table with one row per key.

The table's size decides how. Up to the broadcast limit it is broadcast, and
the frame is not shuffled. Beyond it the frame must be shuffled on the key, and
then one popular key would put its rows into one task; so the few keys that
hold a large share of rows are split off first:

* at most ``HOT_KEYS`` keys can each hold 1/HOT_KEYS of all rows, hence the
  table of hot keys has a proven size and is broadcast;
* rows that found their hot key carry a salt into the shuffle, which spreads
  them evenly; they need no second match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectspark.sources.store import Stored

HOT_KEYS = 1000
SALTS = 4096

_KEY = "__key_{}"
_HOT = "__hot_{}"


def same(left: Column, right: Column) -> Column:
    """Equality under which NULL equals NULL."""
    return left.eqNullSafe(right)


def attach(
    rows: DataFrame,
    table: Stored,
    on: Sequence[str],
    payload: Sequence[str],
    limit: int,
    prefix: str = "",
    weight: str = "n",
) -> DataFrame:
    """Add the ``payload`` columns of ``table`` to ``rows``; NULL where no key matches.

    They are called ``prefix`` + their name. ``weight`` names the column that counts the rows per key; it is read only
    when the table is too large to broadcast.
    """
    found = prefix + "{}"
    if table.fits(limit):
        return _join(rows, F.broadcast(_side(table.df, on, payload, found)), on)

    total = table.df.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_KEYS >= F.lit(total)
    hot = _side(table.df.filter(is_hot), on, payload, _HOT).withColumn("__is_hot", F.lit(True))
    cold = _side(table.df.filter(~is_hot), on, payload, found).withColumn("__salt_t", F.lit(0))

    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS)).cast("int") + 1
    salted = _join(rows, F.broadcast(hot), on).withColumn(
        "__salt", F.when(F.col("__is_hot"), spread).otherwise(F.lit(0))
    )
    joined = _join(salted, cold, on, extra=F.col("__salt") == F.col("__salt_t"))
    picked = [
        f"CASE WHEN __is_hot THEN {_HOT.format(p)} ELSE {found.format(p)} END AS {found.format(p)}" for p in payload
    ]
    return joined.selectExpr(*rows.columns, *picked)


def _side(table: DataFrame, on: Sequence[str], payload: Sequence[str], rename: str) -> DataFrame:
    keys = [f"{k} AS {_KEY.format(k)}" for k in on]
    return table.selectExpr(*keys, *[f"{p} AS {rename.format(p)}" for p in payload])


def _join(rows: DataFrame, side: DataFrame, on: Sequence[str], extra: Column | None = None) -> DataFrame:
    condition = extra
    for k in on:
        match = same(F.col(k), F.col(_KEY.format(k)))
        condition = match if condition is None else condition & match
    return rows.join(side, condition, "left").drop(*[_KEY.format(k) for k in on])


def missing_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``rows`` without an equal row in ``kept``, NULLs being equal."""
    other = kept.toDF(*[_KEY.format(c) for c in kept.columns])
    condition = F.lit(True)
    for c in kept.columns:
        condition = condition & same(F.col(c), F.col(_KEY.format(c)))
    return rows.join(other, condition, "left_anti")
