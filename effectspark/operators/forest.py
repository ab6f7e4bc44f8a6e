"""Regression forests grown level by level from histograms.

Every feature is cut once at its exact quantiles, and rows are stored with bin numbers
only. A level of all trees takes one pass: each row adds its target to one cell per tree
and feature, (tree, node, feature, bin), summed map-side, so that a pass shuffles cells
and not rows. The best cut of a node follows from running sums over its cells. The number
of cells is bounded by the parameters; of the result, one row per node reaches the driver,
where the trees become one expression over the bins, and no row is ever sent to a model.

Trees differ in the rows they learn from, chosen by a hash of the row's key, and in
their features, chosen by a hash of tree and feature.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effectspark.functions import columns as C
from effectspark.functions.aggregates import double_sql
from effectspark.operators.quantiles import exact_quantiles
from effectspark.operators.split import held_out, quantile_index
from effectspark.sources.store import Workspace

BINS = 16
DEPTH = 3
TREES = 4
LEAST_ROWS = 20  # training rows on either side of a cut
ROW_SHARE = 632  # rows in a thousand that a tree learns from
PLACES = 6  # gains that agree so far are equal: then the first feature and the least bin win
_BIN = "__bin_{}"


@dataclass(frozen=True)
class Split:
    """A cut of one node: rows whose bin of the feature is at most ``bin`` go left."""

    feature: int
    bin: int
    n: int
    n_left: int
    mean_left: float
    mean_right: float


@dataclass(frozen=True)
class Forest:
    """``nodes[tree][node]`` is the cut of a node; 1 is the root, 2k and 2k + 1 are the children of k."""

    features: tuple[str, ...]
    cuts: dict[str, list]
    nodes: tuple[dict[int, Split], ...]
    means: tuple[float | None, ...]  # of a tree's rows

    def value_sql(self, tree: int, node: int = 1, value: float | None = None) -> str:
        """The prediction of a tree below a node, over bin columns."""
        value = self.means[tree] if node == 1 else value
        split = self.nodes[tree].get(node)
        if split is None:
            return double_sql(value)
        left = self.value_sql(tree, 2 * node, split.mean_left)
        right = self.value_sql(tree, 2 * node + 1, split.mean_right)
        return f"CASE WHEN {_BIN.format(split.feature)} <= {split.bin} THEN {left} ELSE {right} END"

    def node_sql(self, tree: int, node: int = 1) -> str:
        """The node of a tree that a row has reached."""
        split = self.nodes[tree].get(node)
        if split is None:
            return str(node)
        left, right = self.node_sql(tree, 2 * node), self.node_sql(tree, 2 * node + 1)
        return f"CASE WHEN {_BIN.format(split.feature)} <= {split.bin} THEN {left} ELSE {right} END"

    def frontier(self, tree: int, level: int) -> list[int]:
        """Nodes of a level that may be cut."""
        known = self.nodes[tree]
        return [n for n in range(1 << level, 2 << level) if level == 0 or n >> 1 in known]

    def bins(self, rows: DataFrame) -> DataFrame:
        """Add a bin number per feature; a NULL is below all bins."""
        index = {_BIN.format(k): quantile_index(F.col(c), self.cuts[c]) for k, c in enumerate(self.features)}
        return rows.withColumns({name: F.coalesce(bin, F.lit(-1)) for name, bin in index.items()})

    def predict(self, rows: DataFrame, name: str = "pred") -> DataFrame:
        """Add the mean of the trees' predictions; NULL if nothing was learned."""
        known = [t for t, mean in enumerate(self.means) if mean is not None]
        total = " + ".join(f"({self.value_sql(t)})" for t in known)
        pred = F.expr(f"({total}) / {len(known)}D") if known else F.lit(None).cast("double")
        return self.bins(rows).withColumn(name, pred).drop(*[_BIN.format(k) for k in range(len(self.features))])

    def table(self, ws: Workspace) -> DataFrame:
        """(tree, node, feature, bin, cut, n, n_left, mean_left, mean_right), a row per cut; ``cut`` is the greatest value on its left, as text."""
        rows = []
        for tree, nodes in enumerate(self.nodes):
            for node, s in sorted(nodes.items()):
                levels = list(dict.fromkeys(self.cuts[self.features[s.feature]]))
                cut = str(levels[s.bin]) if s.bin >= 0 else None
                rows.append((tree, node, self.features[s.feature], s.bin, cut, s.n, s.n_left, s.mean_left, s.mean_right))
        return ws.spark.createDataFrame(
            rows,
            "tree int, node int, feature string, bin int, cut string, n bigint, n_left bigint, mean_left double, mean_right double",
        )


def features_of(tree: int, count: int, wanted: int) -> list[int]:
    """The features of a tree: those whose hash with the tree's number is least."""
    order = sorted(range(count), key=lambda f: hashlib.md5(f"{tree}|{f}".encode()).hexdigest())
    return sorted(order[:wanted])


def fit_forest(
    frame: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    ws: Workspace,
    target: str = "rating",
    held: str | None = "is_val",
    trees: int = TREES,
    depth: int = DEPTH,
    bins: int = BINS,
    features_each: int | None = None,
    row_share: int = ROW_SHARE,
) -> Forest:
    """Grow ``trees`` trees of at most ``depth`` levels on the rows that are not held out.

    ``key`` names the columns whose hash chooses a tree's rows; ``row_share`` of 1000 takes
    all. ``features`` are numbers or dates, read from a stored table.
    """
    features = tuple(features)
    each = len(features) if features_each is None else features_each
    train = frame.filter(F.col(target).isNotNull())
    train = train.filter(~held_out(held)) if held else train
    cuts = exact_quantiles(train, features, bins, ws)
    forest = Forest(features, cuts, tuple({} for _ in range(trees)), (None,) * trees)
    used = [F.lit(True) if row_share >= 1000 else (C.row_hash(F.lit(t), *key) % 1000 < row_share) for t in range(trees)]
    names = [_BIN.format(k) for k in range(len(features))]
    stored = forest.bins(train).select(
        F.col(target).cast("double").alias("y"), *[F.col(c).cast("short").alias(c) for c in names],
        *[u.alias(f"__in_{t}") for t, u in enumerate(used)],
    )
    rows = ws.save(stored, "binned").df
    chosen = [features_of(t, len(features), each) for t in range(trees)]
    forest = _with_means(rows, forest)
    for level in range(depth):
        found = _best_splits(rows, forest, level, chosen)
        if not found:
            break
        nodes = tuple(forest.nodes[t] | {n: s for (tree, n), s in found.items() if tree == t} for t in range(trees))
        forest = Forest(features, cuts, nodes, forest.means)
    return forest


def _with_means(rows: DataFrame, forest: Forest) -> Forest:
    trees = range(len(forest.nodes))
    row = rows.agg(*[F.avg(F.when(F.col(f"__in_{t}"), F.col("y"))).alias(f"m{t}") for t in trees]).first()
    return Forest(forest.features, forest.cuts, forest.nodes, tuple(row[f"m{t}"] for t in trees))


def _best_splits(rows: DataFrame, forest: Forest, level: int, chosen: Sequence[Sequence[int]]) -> dict:
    """The best cut of each node of a level, where one gains anything."""
    cells = []
    for t, features in enumerate(chosen):
        frontier = forest.frontier(t, level)
        if not frontier:
            continue
        open_row = f"__in_{t} AND ({forest.node_sql(t)}) IN ({', '.join(map(str, frontier))})"
        one = [f"named_struct('tree', {t}, 'node', {forest.node_sql(t)}, 'feature', {f}, 'bin', CAST({_BIN.format(f)} AS INT))" for f in features]
        cells.append(f"CASE WHEN {open_row} THEN array({', '.join(one)}) ELSE array() END")
    if not cells or not any(chosen):
        return {}
    long = rows.selectExpr("y", f"inline(flatten(array({', '.join(cells)})))")
    sums = long.groupBy("tree", "node", "feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    whole = Window.partitionBy("tree", "node", "feature")
    upto = whole.orderBy("bin")
    running = sums.select(
        "tree", "node", "feature", "bin",
        F.sum("n").over(upto).alias("nl"), F.sum("s").over(upto).alias("sl"),
        F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"),
    )
    gained = running.filter(f"nl >= {LEAST_ROWS} AND n - nl >= {LEAST_ROWS}").withColumn(
        "gain", F.round(F.expr("sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n"), PLACES)
    )
    best = gained.filter("gain > 0").groupBy("tree", "node").agg(
        F.min(F.struct((-F.col("gain")).alias("loss"), "feature", "bin", "n", "nl", "s", "sl")).alias("b")
    )
    return {
        (r["tree"], r["node"]): Split(
            r["feature"], r["bin"], r["n"], r["nl"], r["sl"] / r["nl"], (r["s"] - r["sl"]) / (r["n"] - r["nl"])
        )
        for r in best.select("tree", "node", "b.*").collect()
    }
