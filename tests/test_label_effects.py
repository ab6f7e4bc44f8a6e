"""Joint label effects and users' tastes against plain linear algebra."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectspark.operators import effects as E
from effectspark.operators import label_effects as L
from effectspark.sources.store import Workspace

SCHEMA = "user_id bigint, item_id bigint, epoch_s bigint, rating double, genres string, is_val boolean, label string, b double, n int"
LISTS = ["a|b", "b|c", "a|b|c|d", "d", "a|a|b", "", "c|", None, "e|f", "f|e|a", "rare"]


def some(n=900, seed=1, hot=0.3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        user = 0 if r.random() < hot else r.choice([None, *range(1, 30)])
        item = r.randrange(25)
        rows.append((user, item, k, r.choice([None, 1.0, 2.5, 4.0, 5.0, 3.5]), LISTS[item % 11], r.choice([True, False, False, None]), "x", 9.0, 3))
    return rows


def held(text):
    return list(dict.fromkeys(text.split("|"))) if text is not None else []


def plain(rows, lam):
    """Base effects of item and user, then one linear system, then a mean per user and label."""
    train = [r for r in rows if not r[5] and r[3] is not None]
    mu = sum(r[3] for r in train) / len(train)
    b = {}
    for at in (1, 0):
        total, n = {}, {}
        for r in train:
            rest = r[3] - mu - (b[1][r[1]] if at == 0 else 0)
            total[r[at]] = total.get(r[at], 0) + rest
            n[r[at]] = n.get(r[at], 0) + 1
        b[at] = {v: total[v] / (n[v] + lam) for v in total}
    base = lambda r: mu + b[1].get(r[1], 0) + b[0].get(r[0], 0)
    names = sorted({x for r in train for x in held(r[4])})
    design = np.array([[float(x in held(r[4])) for x in names] for r in train])
    rest = np.array([r[3] - base(r) for r in train])
    c = np.linalg.solve(design.T @ design + lam * np.eye(len(names)), design.T @ rest)
    own = dict(zip(names, c))
    total, n = {}, {}
    for r, x in zip(train, rest - design @ c):
        for label in held(r[4]):
            total[r[0], label] = total.get((r[0], label), 0) + x
            n[r[0], label] = n.get((r[0], label), 0) + 1
    dev = {k: total[k] / (n[k] + lam) for k in total}

    def pred(r, tastes):
        labels = held(r[4])
        out = base(r) + sum(own.get(x, 0) for x in labels)
        return out + (sum(dev.get((r[0], x), 0) for x in labels) / len(labels) if tastes and labels else 0)

    return own, {k: own[k[1]] + v for k, v in dev.items()}, pred


def fitted(frame, ws, lam=3.0, **options):
    base = E.fit(frame, (E.ITEM, E.USER), ws, [lam])
    model = L.fit_labels(frame, base, ws, lam, **options)
    return L.fit_user_labels(frame, model, ws, lam)


@pytest.mark.parametrize("limit", [1 << 26, 0])
@pytest.mark.parametrize("dense", [L.DENSE_LABELS, 0])
def test_against_plain_algebra(spark, limit, dense):
    ws = Workspace(spark, broadcast_bytes=limit)
    rows = some()
    frame = ws.save(spark.createDataFrame(rows, SCHEMA).repartition(4), "frame").df
    model = fitted(frame, ws, dense=dense)
    own, tastes, pred = plain(rows, 3.0)
    got = {r["label"]: r["b"] for r in model.effects.df.collect()}
    assert got == pytest.approx(own, abs=1e-9)
    got = {(r["user_id"], r["label"]): r["b"] for r in model.tastes.df.collect()}
    assert got == pytest.approx(tastes, abs=1e-9)
    scored = L.score_labels(frame.filter("is_val").drop("label", "b", "n"), model, ws).collect()
    assert len(scored) == sum(bool(r[5]) for r in rows)
    want = {r[2]: pred(r, True) for r in rows if r[5]}
    assert {r["epoch_s"]: r["pred"] for r in scored} == pytest.approx(want, abs=1e-9)
    ws.drop()


def test_without_tastes(spark, ws):
    rows = some(300, 2)
    frame = ws.save(spark.createDataFrame(rows, SCHEMA).repartition(2), "frame").df
    model = L.fit_labels(frame, E.fit(frame, (E.ITEM, E.USER), ws, [3.0]), ws, 3.0)
    pred = plain(rows, 3.0)[2]
    scored = L.score_labels(frame.filter("is_val").drop("label", "b", "n"), model, ws).collect()
    assert {r["epoch_s"]: r["pred"] for r in scored} == pytest.approx({r[2]: pred(r, False) for r in rows if r[5]}, abs=1e-9)


def test_overlapping_labels_need_shrinkage(spark, ws):
    frame = spark.createDataFrame(some(50), SCHEMA)
    with pytest.raises(ValueError, match="positive"):
        L.fit_labels(frame, E.fit(frame, (E.ITEM,), ws, [3.0]), ws, 0.0)


@pytest.mark.parametrize("dense", [L.DENSE_LABELS, 0])
def test_no_rows_and_no_labels(spark, ws, dense):
    for rows in ([], [r[:4] + (None,) + r[5:] for r in some(40)]):
        frame = ws.save(spark.createDataFrame(rows, SCHEMA), "frame").df
        model = fitted(frame, ws, dense=dense)
        assert model.effects.df.count() == 0 and model.tastes.df.count() == 0
        assert L.score_labels(frame.filter("is_val").drop("label", "b", "n"), model, ws).filter("b_labels != 0 OR b_tastes != 0").count() == 0


def test_the_log_is_summed_before_it_is_exploded(spark, ws):
    """Lists are exploded after an aggregation, so their number and not that of the rows counts."""
    rows = [(k % 3, k % 2, k, float(k % 4), "a|b|c", False, "x", 0.0, 0) for k in range(500)]
    frame = ws.save(spark.createDataFrame(rows, SCHEMA), "frame").df
    base = E.fit(frame, (E.ITEM,), ws, [3.0])
    lists = L._lists(E.residuals(frame, base, ["genres", "user_id"]), "genres", "user_id")
    assert lists.count() == 3
    plan = L._exploded(lists, "genres").groupBy("user_id", "label").agg(F.sum("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")
