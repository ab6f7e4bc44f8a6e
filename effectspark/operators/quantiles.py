"""Exact quantiles of any number of columns, by counting.

A value becomes a 64-bit integer of the same order. The first pass counts rows per range
of values that share their upper bits, which tells the range in which each wanted rank
lies; the second pass counts the next bits within these ranges only, and the third ends
at single values. Three aggregations at any size, each with at most 2 ** BITS counts per
column and rank, summed map-side; no row is sorted, and nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effectspark.functions.ordered import from_ordered_bits, ordered_bits
from effectspark.sources.store import Workspace

BITS = 22
LEVELS = (42, 20, 0)  # bits below the ranges of each pass


def exact_quantiles(df: DataFrame, columns: Sequence[str], groups: int, ws: Workspace) -> dict[str, list]:
    """Per column the values at rank ceil(n * i / groups), i = 1 ... groups - 1, of its n values that are not NULL.

    At most one value per column and i reaches the driver. A column without values has none.
    ``df`` is read four times; pass a stored table.
    """
    if groups < 1:
        raise ValueError("at least one group is needed")
    columns, fields = list(columns), df.schema
    if not columns or groups == 1:
        return {c: [] for c in columns}
    keys = [F.struct(F.lit(k).alias("col"), ordered_bits(F.col(c), fields[c].dataType).alias("key")) for k, c in enumerate(columns)]
    long = df.select(F.inline(F.array(*keys))).filter("key IS NOT NULL")
    totals = {r["col"]: r["n"] for r in long.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}
    # per wanted rank: the rank within the range it is known to lie in, and that range's upper bits
    wanted = {(k, i): (-(-n * i // groups), None) for k, n in totals.items() for i in range(1, groups)}
    above = None
    for bits in LEVELS:
        wanted = _narrow(long, wanted, bits, above, ws)
        above = bits
    return _values(df, columns, {key: place for key, (_, place) in wanted.items()})


def _narrow(long: DataFrame, wanted: dict, bits: int, above: int | None, ws: Workspace) -> dict:
    """The same ranks within ranges of values that differ in the lowest ``bits`` bits only."""
    if not wanted:
        return wanted
    range_of = lambda b: F.lit(None).cast("bigint") if b is None else F.shiftright("key", b)
    parts = {(k, part) for (k, _), (_, part) in wanted.items() if part is not None}
    inside = [(F.col("col") == k) & (range_of(above) == part) for k, part in sorted(parts)]
    rows = long.filter(reduce(lambda a, b: a | b, inside)) if inside else long
    counted = rows.groupBy("col", range_of(above).alias("part"), range_of(bits).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("col", "part").orderBy("place")
    summed = ws.save(counted, "range-counts").df.withColumn("upto", F.sum("n").over(upto))
    ranks = ws.spark.createDataFrame(
        [(k, i, rank, part) for (k, i), (rank, part) in wanted.items()], "of int, i int, rank bigint, within bigint"
    )
    match = (F.col("col") == F.col("of")) & F.col("part").eqNullSafe(F.col("within"))
    hit = summed.join(F.broadcast(ranks), match).filter("rank <= upto AND rank > upto - n")
    left = hit.select("of", "i", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "place").collect()
    return {(r["of"], r["i"]): (r["rank"], r["place"]) for r in left}


def _values(df: DataFrame, columns: Sequence[str], found: dict) -> dict[str, list]:
    """The values that have these 64-bit integers."""
    names = {key: f"v{at}" for at, key in enumerate(found)}
    picked = [from_ordered_bits(found[k, i], df.schema[columns[k]].dataType).alias(name) for (k, i), name in names.items()]
    row = df.sparkSession.range(1).select(*picked).first() if picked else {}
    return {c: [row[name] for (of, _), name in names.items() if of == k] for k, c in enumerate(columns)}
