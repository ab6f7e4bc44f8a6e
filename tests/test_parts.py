"""A log in parts: effects of any size are joined without a shuffle of the log."""

import random

import pytest
from pyspark.sql import functions as F

from effectspark.operators import effects as E
from effectspark.operators import parts as P
from effectspark.operators import scoring as S
from effectspark.sources.store import Workspace

SCHEMA = "user_id bigint, item_id bigint, epoch_s bigint, rating double, review_wday int, is_val boolean"


def some(n=3000, seed=1, hot=0.35):
    r = random.Random(seed)
    user = lambda: 7 if r.random() < hot else r.choice([None, *range(200)])
    return [(user(), r.choice([3] * 30 + [None, *range(60)]), k, r.choice([1.0, 2.5, 4.0, None]), k % 7, r.choice([True, False, False, None])) for k in range(n)]


@pytest.fixture()
def log(spark):
    ws = Workspace(spark, broadcast_bytes=0)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    frame = ws.save(spark.createDataFrame(some(), SCHEMA).repartition(5), "frame").df
    with P.deal(frame, ws, ["user_id", "item_id"], 6) as parts:
        yield ws, frame, parts
    for key, value in old.items():
        spark.conf.set(key, value)
    ws.drop()


def plan_of(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return plan


def test_fits_and_scores_are_the_same(log):
    ws, frame, parts = log
    order = (E.ITEM, E.USER, E.REVIEW_WDAY)
    plain = E.fit(frame, order, ws, [0.0, 4.0])
    dealt = E.fit(parts.frame, order, ws, [0.0, 4.0], parts=parts)
    effects = lambda m: sorted((r["effect"], str(r["key"]), round(r["b"], 9), r["n"]) for r in m.long().collect())
    assert effects(plain) == effects(dealt)
    score = lambda rows, m: sorted((r["epoch_s"], round(r["pred"], 9)) for r in S.score(rows.filter("is_val"), m, 4.0).collect())
    assert score(frame, plain) == score(parts.frame, dealt) == score(frame, dealt)


def test_the_log_is_not_shuffled_above_its_scan(spark, log):
    ws, _, parts = log
    model = E.fit(parts.frame, (E.ITEM, E.USER), ws, [4.0], parts=parts)
    plan = plan_of(spark, S.score(parts.frame, model))
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    left_over = E.residuals(parts.frame, model, ["review_wday", P.PART])
    assert "Exchange" not in plan_of(spark, left_over)
    ordinary = plan_of(spark, S.score(parts.frame.drop(P.PART), model))
    assert ordinary.count("Exchange") >= 4


def test_a_hot_key_lies_in_all_parts(log):
    _, frame, parts = log
    sizes = [r["count"] for r in parts.frame.groupBy(P.PART).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * frame.count() / 6
    per_user = {r["user_id"]: r["k"] for r in parts.frame.groupBy("user_id").agg(F.count_distinct(P.PART).alias("k")).collect()}
    assert per_user[7] == 6
    assert parts.values["user_id"].filter("user_id = 7").count() == 6
    assert parts.values["item_id"].count() <= 6 * 61


def test_keys_below_the_hot_share_stay_together(spark, ws):
    frame = ws.save(spark.range(30_000).select((F.col("id") % 15_000).alias("user_id"), F.col("id").alias("item_id")), "frame").df
    with P.deal(frame, ws, ["user_id"], 4) as parts:
        assert parts.frame.groupBy("user_id").agg(F.count_distinct(P.PART).alias("k")).filter("k > 1").isEmpty()
        assert parts.values["user_id"].count() == 15_000


def test_the_rows_are_all_there(log):
    _, frame, parts = log
    assert sorted(map(str, parts.frame.drop(P.PART).collect())) == sorted(map(str, frame.collect()))


def test_no_table_is_left(spark, ws):
    before = {t.name for t in spark.catalog.listTables()}
    frame = ws.save(spark.createDataFrame(some(50), SCHEMA), "frame").df
    with pytest.raises(RuntimeError, match="stop"):
        with P.deal(frame, ws, ["user_id", "item_id"], 3):
            raise RuntimeError("stop")
    assert {t.name for t in spark.catalog.listTables()} == before
    assert spark.conf.get(P.CO_PLACED) == "true"


def test_an_empty_log(spark, ws):
    frame = ws.save(spark.createDataFrame([], SCHEMA), "frame").df
    with P.deal(frame, ws.limited(0), ["user_id", "item_id"], 3) as parts:
        model = E.fit(parts.frame, (E.ITEM, E.USER), ws.limited(0), [1.0], parts=parts)
        assert S.score(parts.frame, model).isEmpty()


def test_parts_serve_one_fit_at_a_time(log):
    ws, _, parts = log
    with pytest.raises(ValueError, match="parts"):
        E.fit(parts.frame, (E.ITEM,), ws, by="review_wday", parts=parts)
