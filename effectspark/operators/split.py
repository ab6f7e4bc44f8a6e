"""Reproducible training/validation splits and folds.

Rows are chosen by a hash of their key, never by position or ``rand``: the
same row lands on the same side however the data is partitioned. A flag that is
NULL counts as not held out, and NULL keys are equal to each other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectspark.functions import columns as C
from effectspark.operators.lookup import attach, same
from effectspark.operators.quantiles import exact_quantiles
from effectspark.sources.store import Stored, Workspace

PER_MILLE = 1000
REST = -(-(1 << 32) // PER_MILLE)  # values that ``h div PER_MILLE`` can take
INNER_PARTS = 10
BUCKETS = 1 << 20
CHUNK = 1 << 20


def _exact(p: float) -> Fraction:
    """The fraction as it is written: 0.1 is a tenth."""
    found = Fraction(repr(float(p)))
    if not 0 <= found <= 1:
        raise ValueError(f"a fraction lies between 0 and 1, not {p}")
    return found


def holdout(h: Column, p: float = 0.1) -> Column:
    """True for about the fraction ``p`` of rows; one pass, no shuffle.

    The last three digits of the hash decide, and its other digits within the last
    thousandth, so fractions are kept to one row in four billion.
    """
    place = F.pmod(h, F.lit(PER_MILLE)) * REST + F.floor(h / PER_MILLE)
    return place < F.lit(math.ceil(_exact(p) * PER_MILLE * REST))


def fold(h: Column, k: int = 10) -> Column:
    return C.hash_digits(h, PER_MILLE, k)


def inner_holdout(h: Column, k: int = 10) -> Column:
    """A tenth of each of ``k`` folds, from hash digits the folds do not use."""
    return C.hash_digits(h, PER_MILLE * k, INNER_PARTS) == 0


def held_out(flag: Column | str) -> Column:
    """The flag with NULL as false."""
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))


def quantile_strata(df: DataFrame, value: str, ws: Workspace, groups: int = 5) -> Column:
    """Index of the value's quantile group, for strata over continuous values; the cuts are exact."""
    return quantile_index(F.col(value), exact_quantiles(df, [value], groups, ws)[value])


def quantile_index(value: Column, cuts: Sequence) -> Column:
    """How many distinct cuts the value exceeds."""
    distinct = list(dict.fromkeys(cuts))
    return reduce(lambda acc, c: acc + (value > F.lit(c)).cast("int"), distinct, F.lit(0))


def _names(strata: str | Sequence[str]) -> list[str]:
    return [strata] if isinstance(strata, str) else list(strata)


def _bucket_offsets(df: DataFrame, strata: Sequence[str], h: str) -> DataFrame:
    """Per (stratum, hash range): rows in it, rows before it, rows in the stratum.

    The table has at most ``BUCKETS`` rows per stratum however long the log is; a
    stratum's part of it is ranked in one task.
    """
    counts = df.groupBy(*strata, _bucket(h).alias("bucket")).agg(F.count(F.lit(1)).alias("in_bucket"))
    upto = Window.partitionBy(*strata).orderBy("bucket")
    return counts.withColumns(
        {
            "before": F.sum("in_bucket").over(upto) - F.col("in_bucket"),
            "in_stratum": F.sum("in_bucket").over(Window.partitionBy(*strata)),
        }
    )


def _bucket(h: str) -> Column:
    return F.floor(F.col(h) / ((1 << 32) // BUCKETS))


def _with_copies(df: DataFrame) -> DataFrame:
    """Distinct rows and how often each occurs; copies of one row meet as counts only."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__copies"))


def _repeat(df: DataFrame, columns: Sequence[str], times: str) -> DataFrame:
    """Each row ``times`` times; only rows with copies move, dealt out to several tasks."""
    single = df.filter(F.col(times) == 1).select(*columns)
    left = F.col(times) - F.col("__chunk") * CHUNK
    several = (
        df.filter(F.col(times) > 1)
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / CHUNK))))
        .repartition("__chunk", *columns)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(CHUNK), left))))
        .select(*columns)
    )
    return single.unionByName(several)


def _quota(p: float) -> Column:
    """ceil(rows of the stratum * p), in whole numbers."""
    share = _exact(p)
    total = f"CAST(in_stratum AS DECIMAL(20, 0)) * {share.numerator}"
    return F.expr(f"CAST(({total} + {share.denominator - 1}) div {share.denominator} AS BIGINT)")


def exact_flags(
    df: DataFrame,
    ws: Workspace,
    strata: str | Sequence[str],
    h: str,
    ties: Sequence[str],
    p: float = 0.1,
    flag: str = "is_test",
) -> DataFrame:
    """Add a flag that holds for exactly ``ceil(n * p)`` rows of each stratum: those with the lowest hashes.

    Whole hash ranges are taken by comparing counts. Only the range in which the
    quota ends is ranked, about one distinct row in a million of its stratum, and
    copies of a row are ranked as one. ``df`` is read twice; pass a stored table.
    """
    names = _names(strata)
    edges = ws.save(
        _bucket_offsets(df, names, h)
        .withColumn("quota", _quota(p))
        .filter("before < quota AND quota <= before + in_bucket")
        .selectExpr(*names, "bucket AS __edge", "quota - before AS __wanted", "in_stratum AS n"),
        "holdout-edges",
    )
    placed = attach(df, edges, names, ["__edge", "__wanted"], ws.broadcast_bytes)
    bucket, columns = _bucket(h), [*df.columns, flag]
    # without an edge the quota is 0
    sure = placed.filter(F.col("__edge").isNull() | (bucket != F.col("__edge"))).withColumn(
        flag, F.coalesce(bucket < F.col("__edge"), F.lit(False))
    )
    upto = Window.partitionBy(*names).orderBy(h, *ties).rowsBetween(Window.unboundedPreceding, 0)
    at_edge = _with_copies(placed.filter(bucket == F.col("__edge")))
    before = F.sum("__copies").over(upto) - F.col("__copies")
    taken = F.greatest(F.lit(0), F.least(F.col("__copies"), F.col("__wanted") - F.col("__before")))
    ranked = at_edge.withColumn("__before", before).withColumn("__take", taken)
    ranked = ranked.withColumn("__leave", F.col("__copies") - F.col("__take"))
    chosen = _repeat(ranked.withColumn(flag, F.lit(True)), columns, "__take")
    left = _repeat(ranked.withColumn(flag, F.lit(False)), columns, "__leave")
    return sure.select(*columns).unionByName(chosen).unionByName(left)


def exact_holdout(
    df: DataFrame, ws: Workspace, strata: str | Sequence[str], h: str, ties: Sequence[str], p: float = 0.1
) -> DataFrame:
    """Exactly ``ceil(n * p)`` rows of each stratum: those with the lowest hashes."""
    return exact_flags(df, ws, strata, h, ties, p, "__held").filter("__held").drop("__held")


def exact_folds(
    df: DataFrame, strata: str | Sequence[str], h: str, ties: Sequence[str], k: int = 10
) -> DataFrame:
    """Folds whose sizes differ by at most one row within each stratum.

    A row's rank in its stratum is the number of rows in lower hash ranges plus
    its rank inside its own range, so no stratum is ever sorted in one task;
    consecutive copies of one row go to consecutive folds. Rows move once, to the others of
    their range. Only ranges of more than ``CHUNK`` rows, which are copies of few rows, are
    first reduced to distinct rows and counts.
    """
    names = _names(strata)
    at = F.struct(*names, _bucket(h).alias("bucket"))
    offsets = _bucket_offsets(df, names, h).select(F.struct(*names, "bucket").alias("__range"), "before")
    counts = df.groupBy(*names, _bucket(h).alias("bucket")).agg(F.count(F.lit(1)).alias("__rows"))
    crowded = counts.filter(F.col("__rows") > CHUNK).select(F.struct(*names, "bucket").alias("__range"), "__rows")
    placed = df.withColumn("__at", at).join(F.broadcast(crowded), F.col("__at") == F.col("__range"), "left")
    columns = [*df.columns, "fold"]
    number = F.row_number().over(Window.partitionBy("__at").orderBy(h, *ties)) - 1
    sparse = placed.filter("__rows IS NULL").drop("__range", "__rows")
    ranked = sparse.join(offsets, F.col("__at") == F.col("__range"), "left").withColumn("__first", F.col("before") + number)
    folded = ranked.withColumn("fold", F.pmod("__first", F.lit(k)).cast("int")).select(*columns)
    return folded.unionByName(_folds_of_copies(placed.filter("__rows IS NOT NULL").select(*df.columns, "__at"), offsets, h, ties, k))


def _folds_of_copies(df: DataFrame, offsets: DataFrame, h: str, ties: Sequence[str], k: int) -> DataFrame:
    """:func:`exact_folds` of rows with their place ``__at``, of which many are copies."""
    rows = _with_copies(df)
    joined = rows.join(offsets, F.col("__at") == F.col("__range"), "left")
    upto = Window.partitionBy("__at").orderBy(h, *ties).rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("before") + F.sum("__copies").over(upto) - F.col("__copies")
    ranked = joined.withColumn("__first", first)
    columns = [*[c for c in df.columns if c != "__at"], "fold"]
    single = ranked.filter("__copies = 1").withColumn("fold", F.pmod("__first", F.lit(k)).cast("int"))
    # a row with copies goes to as many folds as it has copies, at most all of them
    turns = F.sequence(F.lit(0), F.least(F.lit(k).cast("bigint"), F.col("__copies")).cast("int") - 1)
    several = (
        ranked.filter("__copies > 1")
        .withColumn("__turn", F.explode(turns))
        .withColumn("fold", F.pmod(F.col("__first") + F.col("__turn"), F.lit(k)).cast("int"))
        .withColumn("__take", F.floor((F.col("__copies") - F.col("__turn") + k - 1) / k))
    )
    return single.select(*columns).unionByName(_repeat(several, columns, "__take"))


def cold_keys(df: DataFrame, held: str, keys: Sequence[str], ws: Workspace) -> Stored:
    """Key values that occur in held-out rows only; one scan for all keys.

    Partial aggregation makes this safe for popular keys. The list is short:
    a key with many rows has training rows.
    """
    level = _set_number(len(keys))
    found = (
        df.withColumn("__held", held_out(held))
        .groupingSets([[k] for k in keys], *keys)
        .agg(
            level.alias("which"),
            F.bool_and("__held").alias("cold"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter("cold")
        .select("which", *keys, "n", "cold")
    )
    return ws.save(found, "cold-keys")


def _set_number(m: int) -> Column:
    """Position of the single grouped column among ``m`` grouping columns."""
    full = (1 << m) - 1
    gid = F.grouping_id()
    return reduce(
        lambda acc, i: acc.when(gid == full - (1 << (m - 1 - i)), F.lit(i)),
        range(1, m),
        F.when(gid == full - (1 << (m - 1)), F.lit(0)),
    )


def protected(
    df: DataFrame, ws: Workspace, held: str = "temp", keys: Sequence[str] = ("item_id", "user_id")
) -> DataFrame:
    """Add ``is_val``: held out, and every key also has training rows.

    Held-out rows with a cold key return to the training side. The frame is not
    shuffled while the list of cold keys can be broadcast.
    """
    found = cold_keys(df, held, keys, ws)
    out = df
    for i, key in enumerate(keys):
        part = replace(found, df=found.df.filter(F.col("which") == i))
        out = attach(out, part, [key], ["cold"], ws.broadcast_bytes)
        out = out.withColumnRenamed("cold", f"__cold_{i}")
    warm = reduce(lambda a, b: a & b, [F.col(f"__cold_{i}").isNull() for i in range(len(keys))])
    return out.withColumn("is_val", held_out(held) & warm).select(*df.columns, "is_val")


def protected_by_joins(
    df: DataFrame, held: str = "temp", keys: Sequence[str] = ("item_id", "user_id")
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same split by joins: (training, validation, rows returned to training).

    Reads ``df`` several times; :func:`protected` gives the same rows from one flag.
    """
    train, temp = df.filter(~held_out(held)), df.filter(held_out(held))
    validation = temp
    for key in keys:
        validation = in_both(validation, train, key)
    known = [train.select(F.col(k).alias(f"__seen_{k}")).distinct().withColumn(f"__is_{k}", F.lit(True)) for k in keys]
    flagged = temp
    for key, seen in zip(keys, known):
        flagged = flagged.join(seen, same(F.col(key), F.col(f"__seen_{key}")), "left")
    unseen = reduce(lambda a, b: a | b, [F.col(f"__is_{k}").isNull() for k in keys])
    returned = flagged.filter(unseen).select(*df.columns)
    return train.unionByName(returned), validation, returned


def in_both(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``other``; NULL keys occur if ``other`` has one."""
    keys = other.select(F.col(key).alias("__key")).distinct()
    return rows.join(keys, same(F.col(key), F.col("__key")), "left_semi")
