"""Connected components by alternating large-star and small-star steps.

Each step is a grouping and an equi-join. Groups are reduced to their least
neighbour before anything is shuffled, and a node with very many neighbours is
split by the adaptive skew join. Every round is written to the shared folder, so
lineage stays short. Every step keeps a forest's worth of edges or fewer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from effectspark.sources.store import Stored, Workspace


def components(edges: DataFrame, ws: Workspace, a: str = "a", b: str = "b") -> Stored:
    """(node, root) for every node with an edge; ``root`` is the least node of its component.

    Direction, repeats and loops do not matter; edges with a NULL end are left out.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} <> {b}").distinct()
    now, before = _saved(pairs, ws)
    while now.rows:
        now, after = _saved(_small_star(_large_star(now.df)), ws)
        if after == before:
            break
        before = after
    roots = now.df.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    found = now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    return ws.save(found, "components")


def _saved(edges: DataFrame, ws: Workspace) -> tuple[Stored, tuple]:
    """The edges, written, and a fingerprint of the edge set that does not depend on their order."""
    seen = Observation(f"edges-{uuid.uuid4().hex}")
    marks = [F.sum(F.xxhash64(*pair).cast("decimal(38,0)")).alias(name) for name, pair in (("x", "uv"), ("y", "vu"))]
    stored = ws.save(edges.observe(seen, F.count(F.lit(1)).alias("n"), *marks), "edges")
    return stored, tuple(seen.get.values())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # repeats go with the other step, whose result is stored
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them. Edges point to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
