"""k fits at once, each on the rows of all folds but one; no row is moved or written k times.

A row takes part in k - 1 fits. What these need of a wide effect stands in one row per key
value, as arrays with a place per run, which join the log once for all runs. Rows are
repeated only inside a task, right before they are summed up.

Rows carry the arrays of a wide effect on to the next one only. The sums per value of a
narrow attribute are taken apart: what the last wide effect takes off is summed by
itself, from rows of a few columns, and added to the sums of what the others leave over.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectspark.functions import aggregates as A
from effectspark.operators import effects as E
from effectspark.operators.lookup import attach
from effectspark.sources.store import Stored, Workspace

FOLD = "fold"
_OWN = "__own"
_COUNTS, _SUMS, _TAKEN = "__counts", "__sums", "__taken"


@dataclass(frozen=True)
class _Wide:
    """A wide effect with a row per key value: arrays by run.

    The first effect keeps rows and sum of ratings, which serve every lambda; the others
    keep the effect of each lambda, run after run. NULL where a run has no rows.
    """

    spec: E.EffectSpec
    place: int
    stored: Stored
    arrays: tuple[str, ...]

    def attach(self, rows: DataFrame, ws: Workspace) -> DataFrame:
        return attach(rows, self.stored, [self.spec.key], self.arrays, ws.broadcast_bytes)

    def effect(self, i: int, lambda_: float, model: E.EffectModel) -> str:
        """The effect at the i-th lambda, as SQL over the places of one run."""
        if self.place:
            return f"get({self.arrays[0]}, {i})"
        return A.shrunk_sql(f"({_SUMS} - {_COUNTS} * {model.mean_sql()})", _COUNTS, lambda_)


def residuals(
    frame: DataFrame, specs: Sequence[E.EffectSpec], ws: Workspace, lambdas: Sequence[float], k: int
) -> tuple[DataFrame, E.EffectModel]:
    """``fold`` and per lambda what the fit on all other folds leaves over of each rating.

    ``frame`` has the row's ``fold``, 0 to k - 1; rows without one take part in every fit and are not scored. It is
    read several times; pass columns of a stored table. The model holds the means and the narrow effects of each run.
    """
    lambdas = tuple(float(x) for x in lambdas)
    E._check(frame, specs, lambdas, FOLD)
    train = frame.filter("rating IS NOT NULL")
    specs = E._widen(train, specs)
    last_wide = max((i for i, s in enumerate(specs) if s.wide), default=-1)
    wide, narrow = specs[: last_wide + 1], specs[last_wide + 1 :]
    keys = [s.key for s in narrow]

    cells = ws.save(_cells(train, wide[0].key if wide else None), "cells")
    model = E.EffectModel(tuple(specs), lambdas, FOLD, _means(cells.df, k), (), ws.broadcast_bytes)
    pairs = E._pair_counts(train, keys, model) if len(keys) > 1 else None
    with ws.saving(_runs_of_pairs(pairs, k) if pairs is not None else None, "pair-counts") as pair_counts:
        rows, before, last = frame.select(*_names([FOLD, *(s.key for s in specs)]), "rating"), [], None
        for spec in wide:
            if last is None:
                last = _first(cells, spec, k, ws)
                continue
            rows, before = _with_arrays(rows, last, ws), [*before, last]
            last = _later(rows, before, spec, model, k, ws)
            ws.forget_shuffles()  # of the log: the next pass makes others
        if narrow:
            sums = ws.save(_value_sums(rows, before, last, keys, model, k, ws), "value-sums")
            ws.forget_shuffles()
            model = E._fit_sums(train, sums, narrow, pair_counts, model, ws)
    return _scored(rows.filter(f"{FOLD} IS NOT NULL"), before, last, keys, model, ws), model


def _names(names: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(names))


def _cells(train: DataFrame, key: str | None) -> DataFrame:
    """Rows and sum of ratings per fold, and per value of the first wide key."""
    return train.groupBy(FOLD, *([key] if key else [])).agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("s"))


def _elsewhere(run: int) -> str:
    return f"NOT ({FOLD} <=> {run})"


def _means(cells: DataFrame, k: int) -> dict:
    """The mean of what each run is fitted on, for the runs that have rows."""
    means = [F.expr(f"try_divide(sum(CASE WHEN {_elsewhere(f)} THEN s END), sum(CASE WHEN {_elsewhere(f)} THEN n END)) AS m{f}") for f in range(k)]
    found = cells.agg(*means).first()
    return {f: found[f] for f in range(k) if found[f] is not None}


def _runs(rows: DataFrame, k: int) -> DataFrame:
    """Each row once per run that is fitted on it; ``fold`` is then the run."""
    repeated = rows.withColumnRenamed(FOLD, _OWN).withColumn(FOLD, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return repeated.filter(f"NOT ({_OWN} <=> {FOLD})").drop(_OWN)


def _runs_of_pairs(cells: DataFrame, k: int) -> DataFrame:
    names = [c for c in cells.columns if c != "pairs"]
    return _runs(cells, k).groupBy(*names).agg(F.sum("pairs").alias("pairs"))


def _sized(stored: Stored, numbers: int) -> Stored:
    """The table with the size of its arrays, which the workspace does not count."""
    return replace(stored, bytes=stored.bytes + stored.rows * 8 * numbers)


def _first(cells: Stored, spec: E.EffectSpec, k: int, ws: Workspace) -> _Wide:
    each = lambda what: [F.expr(f"sum(CASE WHEN {_elsewhere(f)} THEN {what} END)") for f in range(k)]
    sums = cells.df.groupBy(spec.key).agg(
        F.sum("n").alias("n"), F.array(*each("n")).alias(_COUNTS), F.array(*each("s")).alias(_SUMS)
    )
    stored = ws.save(sums, f"effect-{spec.name}")
    return _Wide(spec, 0, _sized(stored, 2 * k), (_COUNTS, _SUMS))


def _later(rows: DataFrame, before: Sequence[_Wide], spec: E.EffectSpec, model: E.EffectModel, k: int, ws: Workspace) -> _Wide:
    """A wide effect on what the ones before leave over; rows meet by its key before they are repeated."""
    count, taken = len(model.lambdas), f"{_TAKEN}{len(before)}"
    arrays = [a for t in before for a in t.arrays]
    met = rows.filter("rating IS NOT NULL").select(*_names([FOLD, spec.key]), "rating", *arrays).hint("rebalance", spec.key)
    by_run = E._shrunk_means(_left(_runs(met, k), before, [spec.key], model), spec.key, model)
    entries = F.expr(f"map_from_entries(collect_list(struct({FOLD}, array({', '.join(E._b(i) for i in range(count))}))))")
    placed = F.expr(f"transform(sequence(0, {k * count - 1}), j -> get(__runs[CAST(j div {count} AS INT)], j % {count}))")
    by_key = by_run.groupBy(spec.key).agg(F.max("n").alias("n"), entries.alias("__runs"))
    stored = ws.save(by_key.select(spec.key, "n", placed.alias(taken)), f"effect-{spec.name}")
    return _Wide(spec, len(before), _sized(stored, k * count), (taken,))


def _with_arrays(rows: DataFrame, table: _Wide, ws: Workspace) -> DataFrame:
    """The rows with a wide effect's arrays; written out if the table is too large to be joined again and again."""
    joined = table.attach(rows, ws)
    if table.stored.fits(ws.broadcast_bytes):
        return joined
    written = ws.save(joined, f"rest-{table.spec.name}").df
    ws.forget_shuffles()
    return written


def _left(rows: DataFrame, before: Sequence[_Wide], keep: Sequence[str], model: E.EffectModel) -> DataFrame:
    """``fold``, the ``keep`` columns and a residual per lambda, in the run ``fold``."""
    own = rows.selectExpr(*_names([FOLD, *keep]), "rating", *_own(before, model))
    return own.selectExpr(*_names([FOLD, *keep]), *E._named(_rest(before, model)))


def _own(tables: Sequence[_Wide], model: E.EffectModel) -> list[str]:
    """The places of the run ``fold`` in the arrays."""
    count = len(model.lambdas)
    place = lambda t, a: f"slice({a}, {FOLD} * {count} + 1, {count})" if t.place else f"get({a}, {FOLD})"
    return [f"{place(t, a)} AS {a}" for t in tables for a in t.arrays]


def _rest(tables: Sequence[_Wide], model: E.EffectModel) -> list[str]:
    taken = [f" - {b}" for b in _effects(tables, model)] if tables else [""] * len(model.lambdas)
    return [f"rating - {model.mean_sql()}{text}" for text in taken]


def _effects(tables: Sequence[_Wide], model: E.EffectModel) -> list[str]:
    """Per lambda the sum of the effects, as SQL over the run's places."""
    return [" - ".join(f"coalesce({t.effect(i, x, model)}, 0D)" for t in tables) for i, x in enumerate(model.lambdas)]


def _value_sums(
    rows: DataFrame, before: Sequence[_Wide], last: _Wide | None, keys: Sequence[str], model: E.EffectModel, k: int, ws: Workspace
) -> DataFrame:
    """Residual sums per run and value of each narrow key."""
    train = rows.filter("rating IS NOT NULL")
    sums = E._value_sums(_left(_runs(train, k), before, keys, model), keys, model)
    if last is None:
        return sums
    met = _runs(last.attach(train.select(*_names([FOLD, last.spec.key, *keys])), ws), k)
    own = met.selectExpr(*_names([FOLD, *keys]), *_own([last], model))
    taken = own.selectExpr(*_names([FOLD, *keys]), *E._named([f"-{b}" for b in _effects([last], model)]))
    both = sums.unionByName(E._value_sums(taken, keys, model).withColumn("n", F.lit(0).cast("bigint")))
    return both.groupBy("effect", FOLD, "value").agg(F.sum("n").alias("n"), *E._sums(model))


def _scored(
    rows: DataFrame, before: Sequence[_Wide], last: _Wide | None, keys: Sequence[str], model: E.EffectModel, ws: Workspace
) -> DataFrame:
    """What each row's own run, which was not fitted on it, leaves over of its rating."""
    tables = [*before, last] if last else []
    if last:
        rows = rows.selectExpr(*_names([FOLD, last.spec.key, *keys]), "rating", *_own(before, model))
        arrays = [a for t in before for a in t.arrays]
        rows = last.attach(rows, ws).selectExpr(*_names([FOLD, *keys]), "rating", *arrays, *_own([last], model))
    columns = tuple(E._r(i) for i in range(len(model.lambdas)))
    rest = E.Rest(rows.selectExpr(*_names([FOLD, *keys]), *E._named(_rest(tables, model))), tuple(keys), columns, columns)
    for i, table in enumerate(model.tables):
        rest = rest.minus(table, model, [t.spec.key for t in model.tables[i + 1 :]])
    return rest.final(model, [])
