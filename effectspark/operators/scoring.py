"""Predictions from fitted effects, and their error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectspark.functions import aggregates as A
from effectspark.operators.effects import FOUND, EffectModel


def score(rows: DataFrame, model: EffectModel, lambda_: float | None = None) -> DataFrame:
    """Add ``b_<effect>`` and ``pred``; a key the model has not seen has effect 0."""
    return _predict(_effects(rows, model, lambda_), model)


def _effects(rows: DataFrame, model: EffectModel, lambda_: float | None, seen: bool = False) -> DataFrame:
    i = 0 if lambda_ is None else model.lambdas.index(lambda_)
    out, kept = rows, list(rows.columns)
    for table in model.tables:
        found = F.expr(table.effect(i, model.lambdas[i], FOUND))
        name = f"b_{table.spec.name}"
        extra = {name: F.coalesce(found, F.lit(0.0))}
        if seen:
            extra[f"unseen_{table.spec.name}"] = found.isNull()
        out = model.attach(out, table).select(*kept, *[c.alias(n) for n, c in extra.items()])
        kept += extra
    return out


def _predict(scored: DataFrame, model: EffectModel) -> DataFrame:
    pred = model.mean()
    for table in model.tables:
        pred = pred + F.col(f"b_{table.spec.name}")
    return scored.withColumn("pred", pred)


def score_with_unseen(rows: DataFrame, model: EffectModel) -> DataFrame:
    """:func:`score`, plus ``unseen_<effect>`` for keys the model does not know."""
    return _predict(_effects(rows, model, None, seen=True), model)


def unseen_counts(rows: DataFrame, model: EffectModel) -> DataFrame:
    """Scored rows per effect whose key the model does not know."""
    flagged = _effects(rows, model, None, seen=True)
    names = [t.spec.name for t in model.tables]
    counts = flagged.agg(*[F.count_if(f"unseen_{n}").alias(n) for n in names])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("effect"), F.col(n).alias("unseen")) for n in names]))
    )


def rmse(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(A.rmse(F.col("rating"), F.col("pred")).alias("rmse"))


def ladder(rows: DataFrame, model: EffectModel) -> DataFrame:
    """Add ``pred_0`` (mean only), ``pred_1`` ...: the prediction after each effect."""
    scored = _effects(rows, model, None)
    pred, steps = model.mean(), {"pred_0": model.mean()}
    for k, table in enumerate(model.tables, 1):
        pred = pred + F.col(f"b_{table.spec.name}")
        steps[f"pred_{k}"] = pred
    return scored.withColumns(steps)


def ladder_rmse(rows: DataFrame, model: EffectModel) -> DataFrame:
    """(step, effect, rmse), all steps in one pass over the rows."""
    scored = ladder(rows, model)
    names = ["mean", *[t.spec.name for t in model.tables]]
    errors = scored.agg(
        *[A.rmse(F.col("rating"), F.col(f"pred_{k}")).alias(f"rmse_{k}") for k in range(len(names))]
    )
    rows_out = [
        F.struct(F.lit(k).alias("step"), F.lit(n).alias("effect"), F.col(f"rmse_{k}").alias("rmse"))
        for k, n in enumerate(names)
    ]
    return errors.select(F.inline(F.array(*rows_out)))


def effect_means(scored: DataFrame, model: EffectModel) -> DataFrame:
    """Mean of each effect over the scored rows, as (effect, mean_b)."""
    names = [t.spec.name for t in model.tables]
    means = scored.agg(*[F.avg(f"b_{n}").alias(n) for n in names])
    return means.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("effect"), F.col(n).alias("mean_b")) for n in names]))
    )
