"""Effects of single labels, and of a user's taste for a label.

A row belongs to all labels of its list, so their effects overlap and are solved
together: with ``G`` the number of rows per pair of labels and ``s`` the residual sum
per label, the shrunk effects ``c`` solve ``(G + lambda I) c = s``. One pass over the
log sums the residual per label *list*, map-side; everything else follows from the
distinct lists. ``G`` has a row per pair of labels that occur together.

A user's effect for a label is shrunk towards the label's own effect: what the label
effects leave over is summed per (user, list), map-side, and only these pairs are
exploded. A row takes the mean deviation over its labels, since lists differ in length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectspark.functions import aggregates as A
from effectspark.operators.effects import EffectModel, residuals
from effectspark.operators.labels import label_array
from effectspark.operators.lookup import attach, same
from effectspark.operators.scoring import score
from effectspark.operators.split import held_out
from effectspark.sources.store import Stored, Workspace

DENSE_LABELS = 2048  # up to here one task solves the dense system, beyond it goes on as joins
PRECISION = 1e-13  # of the residual norm, relative to that of the right side, where the joins stop


@dataclass(frozen=True)
class LabelModel:
    """Label effects on top of ``base``: ``effects`` is (label, b, n), ``tastes`` (user_id, label, dev, b, n)."""

    base: EffectModel
    effects: Stored
    labels: str
    tastes: Stored | None = None
    user: str = "user_id"


def _lists(rows: DataFrame, labels: str, *by: str) -> DataFrame:
    """(by, labels, s, n): residual sums and row counts per label list."""
    return rows.groupBy(*by, labels).agg(F.sum("r_0").alias("s"), F.count(F.lit(1)).alias("n"))


def _exploded(lists: DataFrame, labels: str) -> DataFrame:
    """A row per distinct label of a list; rows without a list have no label."""
    return lists.withColumn("label", F.explode(F.array_distinct(label_array(labels))))


def fit_labels(
    frame: DataFrame,
    base: EffectModel,
    ws: Workspace,
    lambda_: float,
    labels: str = "genres",
    held: str | None = "is_val",
    dense: int = DENSE_LABELS,
) -> LabelModel:
    """Joint shrunk effects of all labels on what ``base`` leaves over.

    ``frame`` is a stored table as for ``effects.fit``. Without shrinkage the effects of
    labels that always occur together are not determined, so ``lambda_`` must be positive.
    """
    if lambda_ <= 0:
        raise ValueError("lambda must be positive: label effects overlap")
    train = frame.filter("rating IS NOT NULL")
    train = train.filter(~held_out(held)) if held else train
    lists = ws.save(_lists(residuals(train, base, [labels]), labels), "label-lists").df
    one = _exploded(lists, labels)
    sums = ws.save(one.groupBy("label").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "label-sums")
    names = F.array_distinct(label_array(labels))
    gram = ws.save(
        one.select("label", F.explode(names).alias("other"), "n").groupBy("label", "other").agg(F.sum("n").alias("g")),
        "label-pairs",
    )
    solved = _solve_dense(gram, sums, lambda_) if sums.rows <= dense else _solve_by_joins(gram, sums, lambda_, ws)
    effects = sums.df.join(solved, "label").select("label", "b", "n")
    return LabelModel(base, ws.save(effects, "label-effects"), labels)


def _solve_dense(gram: Stored, sums: Stored, lambda_: float) -> DataFrame:
    """(label, b) by one task; at most DENSE_LABELS squared numbers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        own = table.filter(pa.compute.is_null(table["other"])).sort_by("label")
        pairs = table.filter(pa.compute.is_valid(table["other"]))
        where = lambda c: pa.compute.index_in(pairs[c], own["label"].combine_chunks()).to_numpy()
        matrix = np.zeros((own.num_rows, own.num_rows))
        matrix[where("label"), where("other")] = pairs["x"].to_numpy()
        b = np.linalg.solve(matrix + lambda_ * np.eye(own.num_rows), own["x"].to_numpy())
        yield pa.record_batch([own["label"].combine_chunks(), pa.array(b)], ["label", "b"])

    both = gram.df.select("label", "other", F.col("g").cast("double").alias("x")).unionByName(
        sums.df.select("label", F.lit(None).cast("string").alias("other"), F.col("s").alias("x"))
    )
    return both.coalesce(1).mapInArrow(task, "label string, b double")


def _solve_by_joins(gram: Stored, sums: Stored, lambda_: float, ws: Workspace) -> DataFrame:
    """(label, b) by conjugate gradients: per step one join of the pairs with a vector, and two sums."""
    # scaled by the diagonal, which makes frequent and rare labels alike
    scale = gram.df.filter("label = other").select("label", (1 / F.sqrt(F.col("g") + F.lit(lambda_))).alias("w"))
    scaled = sums.df.join(scale, "label")
    state = ws.save(
        scaled.select("label", "w", F.lit(0.0).alias("x"), (F.col("s") * F.col("w")).alias("r"), (F.col("s") * F.col("w")).alias("p")),
        "label-steps",
    )
    now = start = state.df.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    for _ in range(2 * sums.rows):
        if now <= start * PRECISION**2:
            break
        vector = state.df.select(F.col("label").alias("other"), (F.col("p") * F.col("w")).alias("v"))
        vector = F.broadcast(vector) if state.fits(ws.broadcast_bytes) else vector
        product = gram.df.join(vector, "other").groupBy("label").agg(F.sum(F.col("g") * F.col("v")).alias("gv"))
        ahead = F.col("w") * (F.col("gv") + F.lit(lambda_) * F.col("w") * F.col("p"))
        moved = ws.save(state.df.join(product, "label").withColumn("q", ahead).drop("gv"), "label-steps")
        step = now / moved.df.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        left = (F.col("r") - F.lit(step) * F.col("q")).alias("r")
        further = moved.df.select("label", "w", (F.col("x") + F.lit(step) * F.col("p")).alias("x"), left, "p")
        then = further.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        turned = (F.col("r") + F.lit(then / now) * F.col("p")).alias("p")
        state, now = ws.save(further.select("label", "w", "x", "r", turned), "label-steps"), then
    return state.df.select("label", (F.col("x") * F.col("w")).alias("b"))


def fit_user_labels(
    frame: DataFrame, model: LabelModel, ws: Workspace, lambda_: float, user: str = "user_id", held: str | None = "is_val"
) -> LabelModel:
    """Add each user's effect per label, shrunk by ``lambda_`` towards the label's effect."""
    train = frame.filter("rating IS NOT NULL")
    train = train.filter(~held_out(held)) if held else train
    lists = ws.save(_lists(_left_over(train, model, ws, [user]), model.labels, user), "user-lists").df
    sums = _exploded(lists, model.labels).groupBy(user, "label").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    deviations = ws.save(sums.selectExpr(user, "label", "n", f"{A.shrunk_sql('s', 'n', lambda_)} AS dev"), "user-label-sums").df
    own = model.effects.df.select(F.col("label").alias("__label"), F.col("b").alias("__b"))
    joined = deviations.join(ws.small(Stored(own, "", model.effects.rows, model.effects.bytes)), F.col("label") == F.col("__label"))
    tastes = joined.select(user, "label", "dev", (F.col("__b") + F.col("dev")).alias("b"), "n")
    return LabelModel(model.base, model.effects, model.labels, ws.save(tastes, "user-labels"), user)


def _left_over(train: DataFrame, model: LabelModel, ws: Workspace, keep: Sequence[str]) -> DataFrame:
    """What ``base`` and the label effects leave over, as ``r_0``."""
    rows = residuals(train, model.base, [model.labels, *keep])
    found = _attach_lists(rows, model, ws)
    return found.select(*keep, model.labels, (F.col("r_0") - F.col("__b_labels")).alias("r_0"))


def _attach_lists(rows: DataFrame, model: LabelModel, ws: Workspace) -> DataFrame:
    """Add ``__b_labels``: the sum of the effects of a row's labels; labels without an effect count 0."""
    lists = ws.save(rows.groupBy(model.labels).agg(F.count(F.lit(1)).alias("n")), "lists").df
    own = ws.small(model.effects).select("label", "b")
    summed = _exploded(lists, model.labels).join(own, "label").groupBy(model.labels, "n").agg(F.sum("b").alias("b"))
    table = ws.save(summed, "list-effects")
    found = attach(rows, table, [model.labels], ["b"], ws.broadcast_bytes, prefix="__list_")
    return found.withColumn("__b_labels", F.coalesce("__list_b", F.lit(0.0))).drop("__list_b")


def score_labels(rows: DataFrame, model: LabelModel, ws: Workspace) -> DataFrame:
    """``scoring.score`` by ``base``, plus ``b_labels``, ``b_tastes`` if fitted, and the new ``pred``."""
    scored = score(rows, model.base)
    found = _attach_lists(scored, model, ws).withColumnRenamed("__b_labels", "b_labels")
    pred = F.col("pred") + F.col("b_labels")
    if model.tastes is not None:
        found = _attach_tastes(found, model, ws)
        pred = pred + F.col("b_tastes")
    return found.withColumn("pred", pred)


def _attach_tastes(rows: DataFrame, model: LabelModel, ws: Workspace) -> DataFrame:
    """Add ``b_tastes``: the mean deviation of the user over the labels of the row, unknown ones counting 0."""
    on = [model.user, model.labels]
    met = ws.save(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), "user-lists").df
    wanted = met.withColumn("__k", F.size(F.array_distinct(label_array(model.labels))))
    own = model.tastes.df.select(F.col(model.user).alias("__user"), F.col("label").alias("__label"), "dev")
    match = same(F.col(model.user), F.col("__user")) & (F.col("label") == F.col("__label"))
    summed = _exploded(wanted, model.labels).join(own, match).groupBy(*on, "n", "__k").agg(F.sum("dev").alias("dev"))
    table = ws.save(summed.select(*on, "n", (F.col("dev") / F.col("__k")).alias("dev")), "user-list-effects")
    found = attach(rows, table, on, ["dev"], ws.broadcast_bytes, prefix="__list_")
    return found.withColumn("b_tastes", F.coalesce("__list_dev", F.lit(0.0))).drop("__list_dev")
