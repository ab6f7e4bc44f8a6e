"""Histogram trees against an exhaustive search."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from effectspark.operators import forest as T

SCHEMA = "id bigint, rating double, is_val boolean, a double, b int, c date, tree int, node int, y double, n int, bin int"
FEATURES = ("a", "b", "c")


def some(n, seed=1):
    import datetime as dt

    r = random.Random(seed)
    rows = []
    for k in range(n):
        a, b, c = r.choice([None, r.uniform(-5, 5), r.uniform(-5, 5)]), r.choice([None, 0, 1, 2, 3, 4]), dt.date(2020, 1, 1 + r.randrange(25))
        y = 3.0 + (a or 0 > 1) * 0.25 + (b in (2, 3)) - (c.day > 20) * 1.5
        rows.append((k, r.choice([None, round(y * 2) / 2, 1.0, 4.5]), r.choice([True, False, None]), a, b, c, 1, 2, 9.0, 7, 3))
    return rows


def bin_of(value, cuts):
    return -1 if value is None else sum(value > c for c in dict.fromkeys(cuts))


def plain(rows, features, depth, bins, trees, each, share):
    """Cuts by sorting, splits by trying every bin of every feature."""
    train = [r for r in rows if r[1] is not None and not r[2]]
    column = {f: [r[3 + FEATURES.index(f)] for r in train] for f in features}
    cuts = {}
    for f in features:
        v = sorted(x for x in column[f] if x is not None)
        cuts[f] = [v[-(-len(v) * i // bins) - 1] for i in range(1, bins)] if v else []
    binned = [[bin_of(column[f][k], cuts[f]) for f in features] for k in range(len(train))]
    grown, preds = [], []
    for t in range(trees):
        mine = [
            k for k, r in enumerate(train)
            if share >= 1000 or int(hashlib.md5(f"{t}|{r[0]}".encode()).hexdigest()[:8], 16) % 1000 < share
        ]
        order = sorted(range(len(features)), key=lambda f: hashlib.md5(f"{t}|{f}".encode()).hexdigest())[:each]
        nodes, members = {}, {1: mine}
        for level in range(depth):
            for node in range(1 << level, 2 << level):
                ks = members.get(node, [])
                best = None
                for f in sorted(order):
                    for b in sorted({binned[k][f] for k in ks}):
                        left = [train[k][1] for k in ks if binned[k][f] <= b]
                        nl, n, sl, s = len(left), len(ks), sum(left), sum(train[k][1] for k in ks)
                        if min(nl, n - nl) >= T.LEAST_ROWS:
                            gain = round(sl * sl / nl + (s - sl) ** 2 / (n - nl) - s * s / n, 6)
                            if gain > 0 and (best is None or (-gain, f, b) < best[0]):
                                best = ((-gain, f, b), n, nl, sl / nl, (s - sl) / (n - nl))
                if best:
                    (_, f, b), n, nl, ml, mr = best
                    nodes[node] = (features[f], b, n, nl, ml, mr)
                    members[2 * node] = [k for k in ks if binned[k][f] <= b]
                    members[2 * node + 1] = [k for k in ks if binned[k][f] > b]
        grown.append(nodes)
        mean = sum(train[k][1] for k in mine) / len(mine) if mine else None

        def value(r, nodes=nodes, mean=mean):
            node, out = 1, mean
            while node in nodes:
                f, b, _, _, ml, mr = nodes[node]
                right = bin_of(r[3 + FEATURES.index(f)], cuts[f]) > b
                node, out = 2 * node + right, mr if right else ml
            return out

        if mean is not None:
            preds.append(value)
    return grown, lambda r: sum(p(r) for p in preds) / len(preds) if preds else None


@pytest.mark.parametrize(
    "features, depth, bins, trees, each, share",
    [(FEATURES, 2, 16, 1, 3, 1000), (FEATURES, 4, 5, 3, 2, 632), (("b",), 3, 64, 2, 1, 500), (FEATURES, 0, 4, 2, 3, 632), (("a", "c"), 2, 2, 1, 1, 10)],
)
def test_against_an_exhaustive_search(spark, ws, features, depth, bins, trees, each, share):
    rows = some(700)
    frame = ws.save(spark.createDataFrame(rows, SCHEMA).repartition(3), "frame").df
    grown, pred = plain(rows, features, depth, bins, trees, each, share)
    model = T.fit_forest(frame, features, ["id"], ws, trees=trees, depth=depth, bins=bins, features_each=each, row_share=share)
    got = [{n: (model.features[s.feature], s.bin, s.n, s.n_left, s.mean_left, s.mean_right) for n, s in nodes.items()} for nodes in model.nodes]
    assert got == grown
    scored = {r["id"]: r["pred"] for r in model.predict(frame).collect()}
    assert scored == {r[0]: pytest.approx(pred(r)) if pred(r) is not None else None for r in rows}
    assert model.table(ws).count() == sum(map(len, grown))


def test_nothing_to_learn(spark, ws):
    for rows in ([], [r[:1] + (None,) + r[2:] for r in some(50)]):
        frame = ws.save(spark.createDataFrame(rows, SCHEMA), "frame").df
        model = T.fit_forest(frame, FEATURES, ["id"], ws)
        assert not any(model.nodes) and model.predict(frame).filter("pred IS NOT NULL").isEmpty()
        assert model.table(ws).count() == 0


def test_equal_targets_give_no_cut(spark, ws):
    frame = ws.save(spark.createDataFrame([r[:1] + (2.5, False) + r[3:] for r in some(200)], SCHEMA), "frame").df
    model = T.fit_forest(frame, FEATURES, ["id"], ws)
    assert not any(model.nodes)
    assert {r["pred"] for r in model.predict(frame).collect()} == {2.5}


def test_a_level_shuffles_cells_and_not_rows(spark, ws, monkeypatch):
    rows = spark.range(50_000).select(
        "id", (F.col("id") % 9 / 2).alias("rating"), F.lit(False).alias("is_val"), (F.col("id") % 97).alias("a"), (F.col("id") % 5).alias("b")
    )
    frame = ws.save(rows, "frame").df
    model = T.fit_forest(frame, ("a", "b"), ["id"], ws, trees=3, depth=2, bins=8)
    binned = model.bins(frame).selectExpr("rating AS y", "__bin_0", "__bin_1", *[f"true AS __in_{t}" for t in range(3)])
    held = []
    collect = type(binned).collect
    monkeypatch.setattr(type(binned), "collect", lambda self: held.append(collect(self)) or held[-1])
    T._best_splits(binned, model, 1, [[0, 1]] * 3)
    assert len(held[-1]) <= 6
    assert not math.isnan(model.means[0])
