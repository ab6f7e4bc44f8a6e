"""Holdouts, folds, protected split."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from effectspark.functions import columns as C
from effectspark.operators import split
from effectspark.sources import standin

KEY = standin.ROW_KEY


@pytest.fixture(scope="module")
def flagged(spark, small):
    return standin.with_holdout(standin.ratings(spark, small)).cache()


def test_counts_at_both_scales(spark, ws, tiny, small):
    for folder, rows, temp, val in ((tiny, 6000, 712, 561), (small, 60000, 7120, 5801)):
        got = standin.split_ratings(spark, folder, ws).agg(
            F.count("*"), F.count_if("temp"), F.count_if("is_val"), F.count_if(F.expr("temp AND NOT is_val"))
        )
        assert tuple(got.first()) == (rows, temp, val, temp - val)


def test_flags_equal_joins(flagged, ws):
    train, validation, returned = split.protected_by_joins(flagged)
    flags = split.protected(flagged, ws)
    for mine, theirs in (
        (flags.filter("is_val"), validation),
        (flags.filter(~F.col("is_val")), train),
        (flags.filter("temp AND NOT is_val"), returned),
    ):
        mine = mine.select(*KEY)
        assert mine.exceptAll(theirs.select(*KEY)).isEmpty()
        assert mine.count() == theirs.count()


def test_split_does_not_depend_on_partitioning(flagged, ws):
    a = split.protected(flagged, ws).select(*KEY, "is_val")
    b = split.protected(flagged.repartition(13, "rating"), ws).select(*KEY, "is_val")
    assert a.exceptAll(b).isEmpty()


def test_every_validation_key_is_in_training(flagged, ws):
    out = split.protected(flagged, ws)
    train, val = out.filter(~F.col("is_val")), out.filter("is_val")
    for key in ("item_id", "user_id"):
        assert val.join(train, key, "left_anti").isEmpty()


def test_cold_keys_stay_out_without_broadcast(flagged, ws, spark):
    from effectspark.sources.store import Workspace

    tight = Workspace(spark, broadcast_bytes=0)
    a, b = split.protected(flagged, ws), split.protected(flagged, tight)
    assert a.select(*KEY, "is_val").exceptAll(b.select(*KEY, "is_val")).isEmpty()


def test_null_keys_are_keys(spark, ws):
    df = spark.createDataFrame(
        [(None, 1, True), (None, 2, False), (3, 1, True), (4, 1, False)], "item_id int, user_id int, temp boolean"
    )
    got = {(r.item_id, r.user_id): r.is_val for r in split.protected(df, ws).collect()}
    assert got == {(None, 1): True, (None, 2): False, (3, 1): False, (4, 1): False}


def test_exact_holdout_has_exact_sizes_and_lowest_hashes(flagged, ws):
    chosen = split.exact_holdout(flagged, ws, "rating", "h", KEY, p=0.1)
    sizes = {r["rating"]: r["count"] for r in flagged.groupBy("rating").count().collect()}
    got = {r["rating"]: r["count"] for r in chosen.groupBy("rating").count().collect()}
    assert got == {k: math.ceil(n * 100 / 1000) for k, n in sizes.items()}
    cut = {r["rating"]: r["m"] for r in chosen.groupBy("rating").agg(F.max("h").alias("m")).collect()}
    rest = flagged.join(chosen.select(*KEY), list(KEY), "left_anti")
    low = {r["rating"]: r["m"] for r in rest.groupBy("rating").agg(F.min("h").alias("m")).collect()}
    assert all(cut[k] <= low[k] for k in cut)


def test_exact_holdout_when_many_rows_share_a_hash(spark, ws):
    df = spark.range(1000).select(
        F.lit(1.0).alias("rating"), (F.col("id") % 3).alias("h"), F.col("id").alias("k")
    )
    chosen = split.exact_holdout(df, ws, "rating", "h", ["k"], p=0.4).collect()
    expect = sorted((r % 3, r) for r in range(1000))[:400]
    assert sorted((r.h, r.k) for r in chosen) == expect


def copies(spark):
    """A third of 3000 rows are copies of one row."""
    k = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))
    return spark.range(3000).select(F.lit(1.0).alias("rating"), F.pmod(F.xxhash64(k), F.lit(1 << 32)).alias("h"), k.alias("k"))


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_exact_splits_with_many_copies_of_a_row(spark, ws, monkeypatch, chunk):
    monkeypatch.setattr(split, "CHUNK", chunk)
    df = copies(spark)
    everything = sorted((r.h, r.k) for r in df.collect())
    for p in (0.1, 0.5, 0.9):
        got = sorted((r.h, r.k) for r in split.exact_holdout(df, ws, "rating", "h", ["k"], p).collect())
        assert got == everything[: round(3000 * p)]
    folds = split.exact_folds(df, "rating", "h", ["k"], k=7).collect()
    assert sorted((r.h, r.k, r.fold) for r in folds) == sorted((h, k, i % 7) for i, (h, k) in enumerate(everything))


def test_exact_folds(flagged):
    rows = split.exact_folds(flagged, "rating", "h", KEY, k=7)
    sizes = defaultdict(list)
    for r in rows.groupBy("rating", "fold").count().collect():
        sizes[r["rating"]].append(r["count"])
    assert rows.count() == 60000
    assert all(max(s) - min(s) <= 1 for s in sizes.values())


def test_folds_and_inner_holdout_use_different_digits(flagged):
    for k in (10, 20):
        rows = flagged.select(split.fold(F.col("h"), k).alias("f"), split.inner_holdout(F.col("h"), k).alias("t"))
        share = rows.groupBy("f").agg(F.avg(F.col("t").cast("int")).alias("s")).collect()
        assert len(share) == k
        assert all(0.05 < r["s"] < 0.15 for r in share)


@pytest.mark.parametrize("p", [0.0, 0.0004, 0.0015, 0.1, 0.25, 0.9996, 1.0])
def test_fractions_are_kept_to_the_row(spark, ws, p):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("s"), C.row_hash(F.col("id")).alias("h"), F.col("id").alias("k"))
    df = ws.save(df, "rows").df
    assert split.exact_holdout(df, ws, "s", "h", ["k"], p).count() == math.ceil(n * p - 1e-6)
    share = df.filter(split.holdout(F.col("h"), p)).count()
    assert abs(share - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + (0 if p in (0.0, 1.0) else 1)


def test_a_fraction_is_meant_as_written(spark, ws):
    df = ws.save(spark.range(70).selectExpr("1 AS s", "id AS h", "id AS k"), "rows").df
    assert split.exact_holdout(df, ws, "s", "h", ["k"], 0.1).count() == 7  # 70 * 0.1 is more than 7 in doubles
    with pytest.raises(ValueError):
        split.holdout(F.col("h"), 1.5)


def test_null_flags_are_not_held_out(spark, ws):
    rows = [(1, 1, None), (1, 2, False), (2, 1, True), (1, 1, True), (3, 3, None)]
    df = spark.createDataFrame(rows, "item_id int, user_id int, temp boolean")
    flags = split.protected(df, ws).collect()
    assert sorted((r.item_id, r.user_id, r.is_val) for r in flags) == [
        (1, 1, False), (1, 1, True), (1, 2, False), (2, 1, False), (3, 3, False)
    ]
    train, validation, returned = split.protected_by_joins(df)
    assert (train.count(), validation.count(), returned.count()) == (4, 1, 1)


def test_both_forms_treat_null_keys_alike(spark, ws):
    rows = [(None, 1, True), (None, 2, False), (3, 1, True), (4, 1, False), (4, None, True), (None, None, True), (3, 2, None)]
    df = spark.createDataFrame(rows, "item_id int, user_id int, temp boolean")
    flags = split.protected(df, ws)
    train, validation, returned = split.protected_by_joins(df)
    for mine, theirs in (("is_val", validation), ("NOT is_val", train), ("temp AND NOT is_val", returned)):
        want = Counter((r.item_id, r.user_id) for r in flags.filter(mine).collect())
        assert Counter((r.item_id, r.user_id) for r in theirs.collect()) == want


def test_exact_flags_by_two_strata(flagged, ws):
    rows = ws.save(split.exact_folds(flagged, "rating", "h", KEY, k=4), "folds").df
    got = split.exact_flags(rows, ws, ["rating", "fold"], "h", KEY)
    sizes = got.groupBy("rating", "fold").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert got.count() == 60000
    assert all(r["t"] == math.ceil(r["n"] / 10) for r in sizes)


def test_flags_with_many_copies_of_a_row(spark, ws):
    got = split.exact_flags(copies(spark), ws, "rating", "h", ["k"], 0.5)
    assert got.count() == 3000 and got.filter("is_test").count() == 1500
    assert max(r.h for r in got.filter("is_test").collect()) <= min(r.h for r in got.filter("NOT is_test").collect())


def test_quantile_strata(spark, ws):
    df = spark.range(1000).select((F.col("id") / 10).alias("x"))
    got = Counter(r[0] for r in df.select(split.quantile_strata(df, "x", ws, 5)).collect())
    assert set(got) == {0, 1, 2, 3, 4} and all(190 <= n <= 210 for n in got.values())


def test_holdout_fraction(flagged):
    share = flagged.agg(F.avg(split.holdout(F.col("h"), 0.25).cast("int"))).first()[0]
    assert abs(share - 0.25) < 0.01
