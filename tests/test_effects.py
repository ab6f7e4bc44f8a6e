"""Fits and scores: golden numbers, identities, brute force, skew."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from effectspark.operators import effects as E
from effectspark.operators import scoring as S
from effectspark.sources import model_store, standin
from effectspark.sources.store import Workspace

# Golden ladders after 0..10 effects.
PLAIN = {
    "0.001": [0.861375, 0.809036, 0.769974, 0.768454, 0.767783, 0.769824, 0.773856, 0.772856, 0.783164, 0.785148, 0.785539],
    "0.01": [0.884684, 0.801428, 0.765870, 0.765533, 0.765654, 0.765762, 0.766161, 0.766105, 0.766430, 0.766172, 0.766364],
}
SHRUNK = {
    "0.001": [0.861375, 0.803256, 0.762716, 0.763536, 0.772015, 0.774698, 0.773859, 0.775579, 0.776288, 0.775710, 0.779280],
    "0.01": [0.884684, 0.800201, 0.763904, 0.763728, 0.763991, 0.764444, 0.764375, 0.764500, 0.764695, 0.764798, 0.765208],
}


@pytest.fixture(scope="module")
def shared(spark):
    ws = Workspace(spark)
    yield ws
    ws.drop()


@pytest.fixture(scope="module")
def frame(spark, tiny, shared):
    return standin.model_frame(spark, tiny, shared, "h").df


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_golden_ladders(spark, shared, sf):
    frame = standin.model_frame(spark, f"/root/testdata/sf{sf}", shared).df
    for order, lam, golden in ((E.PLAIN_ORDER, 0.0, PLAIN), (E.SHRUNK_ORDER, 5.0, SHRUNK)):
        model = E.fit(frame, order, shared, [lam])
        rows = S.ladder_rmse(frame.filter("is_val"), model).orderBy("step").collect()
        assert [round(r["rmse"], 6) for r in rows] == golden[sf]


def brute_force(rows, keys, lam, held):
    """Sequential fit with dictionaries."""
    train = [r for r in rows if not r[held] and r["rating"] is not None]
    mu = sum(r["rating"] for r in train) / len(train)
    rest = [r["rating"] - mu for r in train]
    tables = {}
    for key in keys:
        total, n = defaultdict(float), defaultdict(int)
        for r, x in zip(train, rest):
            total[r[key]] += x
            n[r[key]] += 1
        b = {v: total[v] / (n[v] + lam) for v in total}
        rest = [x - b[r[key]] for r, x in zip(train, rest)]
        tables[key] = b
    return mu, tables


SPEC = {
    "i": E.EffectSpec("i", "i", wide=True),
    "u": E.EffectSpec("u", "u", wide=True),
    "x": E.EffectSpec("x", "x"),
    "y": E.EffectSpec("y", "y"),
    "z": E.EffectSpec("z", "z"),
}


def hot_rows(n=3000, seed=3):
    """One item, one user and one value of each attribute hold a third of the rows; some keys are NULL."""
    rng = random.Random(seed)

    def pick(hot, others):
        return hot if rng.random() < 0.34 else rng.choice(others)

    return [
        {
            "i": pick(0, list(range(1, 60))),
            "u": pick(0, list(range(1, 80))),
            "x": pick(None, list(range(12))),
            "y": pick("x", ["y", "z|w", "", None]),
            "z": pick(7, list(range(-3, 9))),
            "rating": None if rng.random() < 0.02 else rng.randint(1, 10) / 2,
            "held": rng.random() < 0.1,
        }
        for _ in range(n)
    ]


SCHEMA = "i bigint, u bigint, x int, y string, z int, rating double, held boolean"


@pytest.mark.parametrize("order", ["iuxyz", "uxiyz", "xyz", "iu", "y", "zyx"])
@pytest.mark.parametrize("limit", [None, 0])
def test_fit_equals_brute_force_on_skewed_rows(spark, order, limit):
    """Also with no table small enough to broadcast."""
    ws = Workspace(spark) if limit is None else Workspace(spark, broadcast_bytes=limit)
    rows = hot_rows()
    df = ws.save(spark.createDataFrame(rows, SCHEMA), "rows").df
    model = E.fit(df, [SPEC[k] for k in order], ws, [2.0], held="held")
    mu, tables = brute_force(rows, order, 2.0, "held")
    assert model.mu[None] == pytest.approx(mu, abs=1e-12)
    for key in order:
        got = {r[key]: r["b"] for r in model.table(key).collect()}
        assert got.keys() == tables[key].keys()
        assert all(got[v] == pytest.approx(tables[key][v], abs=1e-9) for v in got)
    scored = S.score(df.filter("held"), model).collect()
    assert len(scored) == sum(r["held"] for r in rows)
    for r in scored:
        assert r["pred"] == pytest.approx(mu + sum(tables[k].get(r[k], 0.0) for k in order), abs=1e-9)
    ws.drop()


def test_hot_keys_are_split_off_and_spread(spark, monkeypatch):
    """Above the broadcast limit, hot rows carry a salt and still get their effect."""
    from effectspark.operators import lookup

    monkeypatch.setattr(lookup, "HOT_KEYS", 5)
    ws = Workspace(spark, broadcast_bytes=0)
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("x")
    )
    table = ws.save(rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("s")), "t")
    joined = lookup.attach(rows, table, ["k"], ["s"], 0)
    assert joined.count() == 900
    assert joined.filter("s IS NULL").isEmpty()
    assert joined.filter("k = 0").select("s").distinct().count() == 1
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan and "xxhash64" in plan
    ws.drop()


@pytest.mark.parametrize("limit", [10**9, 0])
def test_skewed_folds_and_lambdas_equal_brute_force(spark, limit):
    """One fold holds most rows; several lambdas; with and without broadcasts."""
    ws = Workspace(spark, broadcast_bytes=limit)
    rows = [{**r, "fold": 0 if k % 5 else 1} for k, r in enumerate(hot_rows(1500))]
    df = ws.save(spark.createDataFrame(rows, SCHEMA + ", fold int"), "rows").df
    model = E.fit(df, [SPEC[k] for k in "iuxyz"], ws, [0.0, 3.0], held="held", by="fold")
    for fold in (0, 1):
        part = [r for r in rows if r["fold"] == fold]
        for lam in (0.0, 3.0):
            mu, tables = brute_force(part, "iuxyz", lam, "held")
            assert model.mu[fold] == pytest.approx(mu)
            for key in "iuxyz":
                got = {r[key]: r["b"] for r in model.table(key, lam).filter(f"fold = {fold}").collect()}
                assert got.keys() == tables[key].keys()
                assert all(got[v] == pytest.approx(tables[key][v], abs=1e-9) for v in got)
    ws.drop()


def test_keys_declared_narrow_are_paired_only_if_their_pairs_are_few(spark, monkeypatch):
    rows = hot_rows(2000)
    ws = Workspace(spark)
    df = ws.save(spark.createDataFrame(rows, SCHEMA), "rows").df
    specs = [E.EffectSpec(k, k) for k in "iuxyz"]
    monkeypatch.setattr(E, "MOST_PAIRS", 1500)  # 60 x 80 pairs of i and u would be more
    saved = {}
    keep = Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, d, n, *a: saved.setdefault(n, keep(self, d, n, *a)))
    model = E.fit(df, specs, ws, [2.0], held="held")
    assert saved["pair-counts"].rows <= 1500
    _, tables = brute_force(rows, "iuxyz", 2.0, "held")
    for key in "iuxyz":
        got = {r[key]: r["b"] for r in model.table(key).collect()}
        assert got.keys() == tables[key].keys()
        assert all(got[v] == pytest.approx(tables[key][v], abs=1e-9) for v in got)
    ws.drop()


def test_groups_may_be_texts_or_null(spark, ws):
    rows = [{**r, "g": (None, "a", "it's", "é")[k % 4]} for k, r in enumerate(hot_rows(800))]
    df = ws.save(spark.createDataFrame(rows, SCHEMA + ", g string"), "rows").df
    model = E.fit(df, [SPEC["i"], SPEC["x"]], ws, [1.0], held="held", by="g")
    for g in (None, "a", "it's", "é"):
        part = [r for r in rows if r["g"] == g]
        mu, tables = brute_force(part, "ix", 1.0, "held")
        assert model.mu[g] == pytest.approx(mu)
        got = {r["x"]: r["b"] for r in model.table("x").filter(F.col("g").eqNullSafe(F.lit(g))).collect()}
        assert got.keys() == tables["x"].keys() and all(got[v] == pytest.approx(tables["x"][v]) for v in got)
    scored = S.score(df, model)
    assert scored.filter("pred IS NULL").isEmpty()


def test_too_many_groups_are_refused(spark, ws, monkeypatch):
    monkeypatch.setattr(E, "MOST_GROUPS", 3)
    df = ws.save(spark.createDataFrame(hot_rows(100), SCHEMA), "rows").df
    with pytest.raises(ValueError, match="more than 3"):
        E.fit(df, [SPEC["i"]], ws, [1.0], held="held", by="z")


def test_a_null_flag_holds_no_row_out(spark, ws):
    df = ws.save(spark.createDataFrame([(1, 3.0, None), (1, 4.0, False), (1, 9.0, True)], "i bigint, rating double, held boolean"), "r").df
    assert E.fit(df, [SPEC["i"]], ws, [0.0], held="held").table("i").first()["n"] == 2


def test_rows_may_have_columns_named_like_the_tables_own(frame, shared):
    model = E.fit(frame, E.SHRUNK_ORDER[:3], shared, [5.0])
    rows = frame.filter("is_val").limit(5).withColumns({c: F.lit(1.0) for c in ("n", "dev", "b_0", "r")})
    assert S.score(rows, model).count() == 5


def test_many_lambdas_equal_one_at_a_time(frame, shared):
    lambdas = [0.0, 1.0, 5.0, 10.0]
    together = E.fit(frame, E.SHRUNK_ORDER, shared, lambdas)
    for lam in (0.0, 5.0):
        alone = E.fit(frame, E.SHRUNK_ORDER, shared, [lam])
        for spec in E.SHRUNK_ORDER:
            a = {r[spec.key]: r["b"] for r in together.table(spec.name, lam).collect()}
            b = {r[spec.key]: r["b"] for r in alone.table(spec.name).collect()}
            assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_lambda_zero_is_the_group_mean(frame, shared):
    model = E.fit(frame, [E.ITEM], shared)
    mu = model.mu[None]
    means = frame.filter("NOT is_val").groupBy("item_id").agg(F.avg("rating").alias("m"))
    off = model.table("item").join(means, "item_id").filter(F.abs(F.col("b") - (F.col("m") - mu)) > 1e-9)
    assert off.isEmpty()


def test_residuals_sum_to_zero_after_a_plain_effect(frame, shared):
    for order in (E.PLAIN_ORDER[:1], E.PLAIN_ORDER[:2], E.PLAIN_ORDER[:5]):
        model = E.fit(frame, order, shared)
        key = order[-1].key
        rest = E.residuals(frame.filter("NOT is_val"), model, [key])
        assert rest.groupBy(key).agg(F.sum("r_0").alias("s")).filter(F.abs("s") > 1e-6).isEmpty()


def test_effects_equal_window_form(frame, shared):
    """Effects over tables of values equal the row-by-row chain of window sums."""
    from pyspark.sql import Window

    model = E.fit(frame, E.SHRUNK_ORDER, shared, [5.0])
    rows = frame.filter("NOT is_val").withColumn("r", F.col("rating") - model.mean())
    for spec in E.SHRUNK_ORDER:
        w = Window.partitionBy(spec.key)
        rows = rows.withColumn("b", F.sum("r").over(w) / (F.count("*").over(w) + 5.0))
        rows = rows.withColumn("r", F.col("r") - F.col("b")).withColumn(f"w_{spec.name}", F.col("b")).drop("b")
    scored = S.score(rows, model)
    for spec in E.SHRUNK_ORDER:
        assert scored.filter(F.abs(F.col(f"b_{spec.name}") - F.col(f"w_{spec.name}")) > 1e-9).isEmpty()


def test_null_release_year_has_its_own_effect(frame, shared):
    model = E.fit(frame, E.PLAIN_ORDER[:3], shared)
    row = model.table("release_year").filter("release_year IS NULL").first()
    assert row["n"] == frame.filter("NOT is_val AND release_year IS NULL").count()
    scored = S.score(frame.filter("release_year IS NULL"), model)
    assert scored.select("b_release_year").distinct().first()[0] == pytest.approx(row["b"])


def test_unseen_keys_have_effect_zero_and_are_counted(spark, frame, shared):
    model = E.fit(frame, [E.ITEM, E.USER], shared, [5.0])
    rows = frame.limit(3).withColumn("item_id", F.lit(-1).cast("bigint"))
    scored = S.score_with_unseen(rows, model).collect()
    assert all(r["b_item"] == 0.0 and r["unseen_item"] and not r["unseen_user"] for r in scored)
    counts = {r["effect"]: r["unseen"] for r in S.unseen_counts(rows, model).collect()}
    assert counts == {"item": 3, "user": 0}


def test_fit_per_fold_equals_separate_fits(frame, shared):
    cv = shared.save(frame.withColumn("fold", F.pmod("user_id", F.lit(2)).cast("int")), "two").df
    specs = E.SHRUNK_ORDER[:4]
    both = E.fit(cv, specs, shared, [1.0, 5.0], by="fold")
    for fold in (0, 1):
        alone = E.fit(cv.filter(f"fold = {fold}"), specs, shared, [1.0, 5.0])
        assert both.mu[fold] == pytest.approx(alone.mu[None])
        for spec, lam in itertools.product(specs, (1.0, 5.0)):
            a = {r[spec.key]: r["b"] for r in both.table(spec.name, lam).filter(f"fold = {fold}").collect()}
            b = {r[spec.key]: r["b"] for r in alone.table(spec.name, lam).collect()}
            assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_mean_only_model(frame, shared):
    model = E.fit(frame, [], shared)
    got = S.rmse(S.score(frame.filter("is_val"), model)).first()[0]
    assert round(got, 6) == PLAIN["0.001"][0]


def test_save_and_load(spark, frame, shared):
    model = E.fit(frame, E.SHRUNK_ORDER[:4], shared, [5.0])
    path = model_store.save_model(model, shared.path("model"))
    again = model_store.load_model(spark, path, shared)
    assert again.mu == model.mu and again.specs == model.specs
    assert again.long().exceptAll(model.long()).isEmpty()


def test_bad_arguments(frame, shared):
    with pytest.raises(ValueError):
        E.fit(frame, [E.ITEM], shared, [])
    with pytest.raises(ValueError):
        E.fit(frame, [E.ITEM], shared, [-1.0])
    with pytest.raises(TypeError):
        E.fit(frame, [E.EffectSpec("rating", "rating")], shared)
    with pytest.raises(ValueError):
        E.fit(frame.withColumnRenamed("item_id", "n"), [E.EffectSpec("item", "n")], shared)
    with pytest.raises(ValueError):
        E.fit(frame.withColumnRenamed("item_id", "N"), [E.EffectSpec("item", "N")], shared)
    with pytest.raises(ValueError):
        E.fit(frame.withColumn("Effect", F.lit(1)), [E.ITEM], shared, by="Effect")
