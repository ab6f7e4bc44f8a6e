"""Choice of lambda: error of every lambda on every fold, in one fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectspark.functions.aggregates import double_sql
from effectspark.operators import all_but_one, split
from effectspark.operators.effects import EffectModel, EffectSpec, fit, residuals
from effectspark.sources.store import Workspace

# The grid 1, 1.25, ..., 10 and ten folds.
GRID_START, GRID_STOP, GRID_STEP = 1.0, 10.0, 0.25
FOLDS = 10

PLACES = 9


def grid_values(start: float = GRID_START, stop: float = GRID_STOP, step: float = GRID_STEP) -> list[float]:
    count = int((stop - start) / step + 1e-9) + 1
    return [start + i * step for i in range(count)]


def lambda_grid(
    spark: SparkSession, start: float = GRID_START, stop: float = GRID_STOP, step: float = GRID_STEP
) -> DataFrame:
    count = len(grid_values(start, stop, step))
    return spark.range(count).select((F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("lambda"))


def cv_frame(
    train: DataFrame, k: int = FOLDS, mode: str = "within_fold", h: str = "h", run: int | None = None
) -> DataFrame:
    """Add ``fold`` and ``is_test``, chosen by hash.

    ``within_fold`` fits on nine tenths of each fold and tests on its last
    tenth. ``kfold`` tests on each fold what was fitted on all others; every
    row then takes part in ``k`` fits and appears ``k`` times, so keep the rows
    as they are and let each pass repeat them, or take one ``run`` of the ``k``. :func:`stratified_cv_frame` chooses exactly.
    """
    own = split.fold(F.col(h), k)
    if mode == "within_fold":
        return train.withColumns({"fold": own, "is_test": split.inner_holdout(F.col(h), k)})
    if mode == "kfold":
        runs = F.explode(F.sequence(F.lit(0), F.lit(k - 1))) if run is None else F.lit(run)
        return train.withColumn("__own", own).withColumn("fold", runs).withColumn(
            "is_test", F.col("fold") == F.col("__own")
        ).drop("__own")
    raise ValueError(f"unknown mode {mode}")


def stratified_cv_frame(
    train: DataFrame,
    ws: Workspace,
    ties: Sequence[str],
    k: int = FOLDS,
    stratum: str = "rating",
    h: str = "h",
    p: float = 0.1,
) -> DataFrame:
    """Add ``fold`` and ``is_test``: exact folds, and an exact part ``p`` of each fold, by stratum.

    Within a stratum folds differ by one row at most, and every fold tests
    ``ceil(n * p)`` of its ``n`` rows of the stratum.
    """
    folded = ws.save(split.exact_folds(train, stratum, h, ties, k), "folds").df
    return split.exact_flags(folded, ws, [stratum, "fold"], h, ties, p)


def cv_rmse_grid(
    frame: DataFrame,
    specs: Sequence[EffectSpec],
    ws: Workspace,
    lambdas: Sequence[float] | None = None,
    block: int | None = None,
) -> DataFrame:
    """(fold, lambda, rmse) for a frame with ``fold`` and ``is_test``.

    Every lambda is a column and ``fold`` a group key, so the frame is read a
    fixed number of times per block of lambdas. A smaller ``block`` needs less
    memory per task and more passes.
    """
    lambdas = list(lambdas if lambdas is not None else grid_values())
    size = block or len(lambdas)
    out = None
    for start in range(0, len(lambdas), size):
        model = fit(frame, specs, ws, lambdas[start : start + size], held="is_test", by="fold")
        part = grid_rmse(frame.filter("is_test"), model)
        out = part if out is None else out.unionByName(part)
    return out


def kfold_rmse_grid(
    train: DataFrame,
    specs: Sequence[EffectSpec],
    ws: Workspace,
    lambdas: Sequence[float] | None = None,
    k: int = FOLDS,
    at_once: bool = True,
) -> DataFrame:
    """:func:`cv_rmse_grid` of folds that are each tested on a fit of all others.

    ``at_once`` fits all runs together, on ``k`` times the rows. Else rows are moved and written once for
    all runs (:mod:`all_but_one`), and what the fit has written is deleted when the grid is there.
    """
    if at_once:
        return cv_rmse_grid(cv_frame(train, k, "kfold"), specs, ws, lambdas)
    own = Workspace(ws.spark, ws.broadcast_bytes)
    rest, model = all_but_one.residuals(cv_frame(train, k).drop("is_test"), specs, own, lambdas or grid_values(), k)
    grid = ws.save(_errors(rest, model), "grid").df
    own.drop()
    ws.forget_shuffles()
    return grid


def grid_rmse(rows: DataFrame, model: EffectModel) -> DataFrame:
    """Error of each lambda of the model per value of ``by``."""
    return _errors(residuals(rows, model, []), model)


def _errors(rest: DataFrame, model: EffectModel) -> DataFrame:
    count = len(model.lambdas)
    errors = rest.groupBy(*model.on).agg(*[F.expr(f"sqrt(avg(r_{i} * r_{i})) AS e_{i}") for i in range(count)])
    cells = ", ".join(
        f"named_struct('lambda', {double_sql(x)}, 'rmse', e_{i})" for i, x in enumerate(model.lambdas)
    )
    return errors.selectExpr(*model.on, f"inline(array({cells}))")


def best_lambda(grid: DataFrame, by: str = "fold") -> DataFrame:
    """Per fold the lambda with the least error; the smallest one on a tie.

    Errors that agree to PLACES places are ties: beyond, they depend on the order of sums.
    """
    least = F.min(F.struct(F.round("rmse", PLACES).alias("near"), "lambda", "rmse"))
    return grid.groupBy(by).agg(least.alias("least")).select(by, "least.lambda", "least.rmse")


def final_lambda(best: DataFrame) -> DataFrame:
    """Mean of the folds' winners."""
    return best.agg(F.avg("lambda").alias("final_lambda"))
