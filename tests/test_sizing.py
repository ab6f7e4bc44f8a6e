"""Work of a task and of a sweep does not follow the size of the log."""

import random

import pytest
from pyspark.sql import functions as F

from effectspark import session
from effectspark.operators import effects as E
from effectspark.operators import parts, split
from effectspark.operators import tuning as T
from effectspark.sources import standin
from effectspark.sources.store import Workspace

SCHEMA = "user_id bigint, item_id bigint, rating double, review_wday int, fold int, is_test boolean, h bigint"


def some(n=4000, seed=5):
    r = random.Random(seed)
    item = lambda: r.choice([1] * 20 + [None, *range(300)])
    user = lambda: 3 if r.random() < 0.1 else r.choice([None, *range(700)])
    return [
        (user(), item(), r.choice([0.5, 2.0, 4.5, 5.0, None]), r.choice([None, 1, 2, 3]), k % 3, r.choice([True, False, False, False, None]), r.randrange(1 << 32))
        for k in range(n)
    ]


@pytest.fixture()
def shared(spark):
    ws = Workspace(spark, broadcast_bytes=0)
    yield ws
    ws.drop()


@pytest.fixture()
def settings(spark):
    kept = {k: spark.conf.get(k, None) for k in (session.INITIAL_PARTITIONS, session.ADVISORY_BYTES)}
    yield
    for key, value in kept.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_shuffle_partitions_follow_the_input(spark, settings):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    session.size_shuffles(spark, 1000)
    assert spark.conf.get(session.INITIAL_PARTITIONS) == str(least)
    session.size_shuffles(spark, 400 << 20)
    assert spark.conf.get(session.INITIAL_PARTITIONS) == "100"
    spark.conf.set(session.ADVISORY_BYTES, "8m")  # a smaller size that the user has chosen stays
    session.size_shuffles(spark, 400 << 20)
    assert spark.conf.get(session.ADVISORY_BYTES) == f"{8 << 20}b"


def test_rows_are_not_sorted_by_the_folders_they_are_written_to(spark, shared):
    session.configure(spark)
    spark.sql(f"CREATE TABLE sizing_flagged (id BIGINT, is_val BOOLEAN) USING parquet PARTITIONED BY (is_val) LOCATION '{shared.path('x')}'")
    try:
        plan = spark.sql("EXPLAIN INSERT INTO sizing_flagged SELECT id, id % 2 = 0 FROM range(10)").first()[0]
    finally:
        spark.sql("DROP TABLE sizing_flagged")
    assert "WriteFiles" in plan and "Sort" not in plan


def test_parts_follow_the_rows():
    assert parts.enough(1000, 8) == 8
    assert parts.enough(100 * parts.PART_ROWS + 1, 8) == 101


@pytest.mark.parametrize("by", [None, "fold"])
def test_sums_in_parts_give_the_effects_of_columns(spark, shared, by):
    frame = shared.save(spark.createDataFrame(some(), SCHEMA), "frame").df
    specs, lambdas = (E.ITEM, E.USER, E.REVIEW_WDAY), [x / 2 for x in range(40)]
    few = E.fit(frame, specs, shared, lambdas, held="is_test", by=by)
    few_rows = few.tables[1].in_parts
    one = lambda x: E.fit(frame, specs, shared, [x], held="is_test", by=by)
    assert few_rows
    for x in (0.0, 7.5):
        plain = one(x)
        for name in ("user", "review_wday"):
            rows = lambda m: sorted((str(r[:-2]), r["n"], round(r["b"], 9)) for r in m.table(name, x).collect())
            assert rows(few) == rows(plain)
        errors = lambda m: [r["rmse"] for r in T.grid_rmse(frame.filter("is_test"), m).filter(F.col("lambda") == x).orderBy("lambda", *m.on).collect()]
        assert errors(few) == pytest.approx(errors(plain), abs=1e-9)


def test_a_sweep_writes_no_rows_with_a_column_per_lambda(spark, shared, monkeypatch):
    frame = shared.save(spark.createDataFrame(some(), SCHEMA), "frame").df
    written = {}
    save = Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name, *a: written.setdefault(name, (save(self, df, name, *a), len(df.columns)))[0])
    E.fit(frame, (E.ITEM, E.USER, E.REVIEW_WDAY), shared, [x / 2 for x in range(40)], held="is_test", by="fold")
    assert "rest-user" not in written
    assert written["rest-item"][1] < 10 and written["effect-user"][1] < 10


def test_runs_of_kfold_one_by_one_give_the_same_grid_and_leave_nothing(spark, shared):
    train = shared.save(spark.createDataFrame(some(1500), SCHEMA).drop("fold", "is_test"), "train").df
    specs = (E.ITEM, E.USER, E.REVIEW_WDAY)
    rows = lambda at_once: [
        (r["fold"], r["lambda"], pytest.approx(r["rmse"], abs=1e-9))
        for r in T.kfold_rmse_grid(train, specs, shared, [1.0, 5.0], 3, at_once=at_once).orderBy("fold", "lambda").collect()
    ]
    from effectspark.sources import store

    before = set(store._open)
    assert rows(False) == rows(True)
    assert set(store._open) == before


@pytest.mark.parametrize("limit", [0, 1 << 26])
@pytest.mark.parametrize(
    "specs", [(E.REVIEW_WDAY,), (E.USER, E.REVIEW_WDAY), (E.ITEM, E.USER, E.EffectSpec("review_wday", "review_wday", wide=True))]
)
def test_runs_of_kfold_agree_for_any_number_of_wide_effects(spark, shared, specs, limit):
    rows = [(*r[:4], None if k % 9 == 0 else r[6]) for k, r in enumerate(some(900, seed=8))]
    train = shared.save(spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double, review_wday int, h bigint"), "train").df
    found = [
        [tuple(r) for r in T.kfold_rmse_grid(train, specs, shared.limited(limit), [0.0, 5.0], 3, at_once=at_once).orderBy("fold", "lambda").collect()]
        for at_once in (False, True)
    ]
    assert len(found[0]) == 6
    assert [r[:2] for r in found[0]] == [r[:2] for r in found[1]]
    assert [r[2] for r in found[0]] == pytest.approx([r[2] for r in found[1]], abs=1e-9)


def test_runs_of_kfold_write_the_rows_once(spark, shared, monkeypatch):
    train = shared.save(spark.createDataFrame(some(1500), SCHEMA).drop("fold", "is_test"), "train").df
    written = []
    save = Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name, *a: (written.append(name), save(self, df, name, *a))[1])
    T.kfold_rmse_grid(train, (E.ITEM, E.USER, E.REVIEW_WDAY), shared, [1.0, 5.0], 3, at_once=False).collect()
    assert written.count("rest-item") == 1 and len(written) == len(set(written))


@pytest.mark.parametrize("chunk", [1, 2, split.CHUNK])
def test_exact_folds_of_crowded_and_other_ranges_are_even(spark, monkeypatch, chunk):
    monkeypatch.setattr(split, "CHUNK", chunk)
    r = random.Random(2)
    rows = [(r.choice([None, 1.0, 2.0]), r.randrange(1 << 32), k) for k in range(300)]
    rows += [(1.0, 77, 5)] * 41 + [(None, 78, 6)] * 23
    df = spark.createDataFrame(rows, "rating double, h bigint, k bigint")
    found = split.exact_folds(df, "rating", "h", ["k"], 4)
    assert sorted(map(str, (tuple(x[:3]) for x in found.collect()))) == sorted(map(str, rows))
    for stratum in (None, 1.0, 2.0):
        here = sorted((x["h"], x["k"], x["fold"]) for x in found.collect() if x["rating"] == stratum)
        sizes = [sum(f == i for *_, f in here) for i in range(4)]
        assert max(sizes) - min(sizes) <= 1
        distinct = sorted({(h, k) for h, k, _ in here})
        place = 0
        for h, k in distinct:  # consecutive ranks, copies in consecutive folds
            folds = sorted(f for a, b, f in here if (a, b) == (h, k))
            assert folds == sorted((place + i) % 4 for i in range(len(folds)))
            place += len(folds)
