"""Lambda grid, folds, winners."""

import pytest
from pyspark.sql import functions as F

from effectspark.operators import effects as E
from effectspark.operators import scoring as S
from effectspark.operators import tuning as T
from effectspark.sources import standin

# Golden winners per fold, final lambda and final RMSE.
GOLDEN = {
    "0.001": ([2.25, 10, 6.75, 2, 10, 10, 10, 10, 10, 10], 8.1, 0.777657),
    "0.01": ([3.25, 10, 5, 5, 5.5, 3, 4.25, 6, 7.5, 5.25], 5.475, 0.765407),
}


def test_grids(spark):
    values = [r[0] for r in T.lambda_grid(spark).collect()]
    assert values == T.grid_values() == [1 + i / 4 for i in range(37)]
    fine = T.grid_values(4, 6, 0.05)
    assert len(fine) == 41 and fine[-1] == pytest.approx(6.0)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_golden_winners(spark, ws, sf):
    frame = standin.model_frame(spark, f"/root/testdata/sf{sf}", ws, "h").df
    cv = ws.save(T.cv_frame(frame.filter("NOT is_val")), "cv", ["is_test"]).df
    best = T.best_lambda(ws.save(T.cv_rmse_grid(cv, E.SHRUNK_ORDER, ws), "grid").df)
    winners, final, error = GOLDEN[sf]
    assert [r["lambda"] for r in best.orderBy("fold").collect()] == winners
    chosen = T.final_lambda(best).first()[0]
    assert chosen == pytest.approx(final)
    model = E.fit(frame, E.SHRUNK_ORDER, ws, [chosen])
    assert round(S.rmse(S.score(frame.filter("is_val"), model)).first()[0], 6) == error


def test_blocks_of_lambdas_give_the_same_grid(spark, ws, tiny):
    frame = standin.model_frame(spark, tiny, ws, "h").df
    cv = ws.save(T.cv_frame(frame.filter("NOT is_val")), "cv", ["is_test"]).df
    specs, lambdas = E.SHRUNK_ORDER[:3], [1.0, 2.0, 5.0]
    whole = T.cv_rmse_grid(cv, specs, ws, lambdas)
    parts = T.cv_rmse_grid(cv, specs, ws, lambdas, block=2)
    both = whole.join(parts.withColumnRenamed("rmse", "other"), ["fold", "lambda"])
    assert both.count() == 30
    assert both.filter(F.abs(F.col("rmse") - F.col("other")) > 1e-12).isEmpty()


def test_kfold_fits_on_the_other_folds(spark, ws, tiny):
    frame = standin.model_frame(spark, tiny, ws, "h").df.filter("NOT is_val")
    cv = T.cv_frame(frame, k=3, mode="kfold")
    assert cv.count() == 3 * frame.count()
    assert cv.filter("is_test").count() == frame.count()
    grid = T.cv_rmse_grid(ws.save(cv, "cv").df, [E.ITEM], ws, [5.0]).orderBy("fold").collect()
    own = frame.withColumn("own", F.pmod(F.floor(F.col("h") / 1000), F.lit(3)).cast("int"))
    for r in grid:
        split = ws.save(own.withColumn("out", F.col("own") == r["fold"]), "one").df
        model = E.fit(split, [E.ITEM], ws, [5.0], held="out")
        assert r["rmse"] == pytest.approx(S.rmse(S.score(split.filter("out"), model)).first()[0])


def test_stratified_frame_is_exact(spark, ws, tiny):
    train = standin.model_frame(spark, tiny, ws, "h").df.filter("NOT is_val")
    cv = ws.save(T.stratified_cv_frame(train, ws, standin.ROW_KEY, k=5), "cv").df
    assert cv.count() == train.count()
    cells = cv.groupBy("rating", "fold").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    by_rating = {}
    for r in cells:
        assert r["t"] == -(-r["n"] // 10)
        by_rating.setdefault(r["rating"], []).append(r["n"])
    assert all(max(n) - min(n) <= 1 for n in by_rating.values())


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        T.cv_frame(spark.range(1).withColumnRenamed("id", "h"), mode="other")


def test_tie_goes_to_the_smaller_lambda(spark):
    grid = spark.createDataFrame(
        [(0, 2.0, 0.5), (0, 1.0, 0.5 + 1e-13), (0, 3.0, 0.7), (1, 1.0, 0.9), (1, 4.0, 0.1)],
        'fold int, `lambda` double, rmse double',
    )
    best = {r["fold"]: (r["lambda"], r["rmse"]) for r in T.best_lambda(grid).collect()}
    assert best == {0: (1.0, 0.5 + 1e-13), 1: (4.0, 0.1)}
    assert T.final_lambda(T.best_lambda(grid)).first()[0] == 2.5
