"""A log stored in parts, to which effects of any size are joined without moving it.

Beyond the broadcast limit, a join with an effect table would shuffle the whole log, once
per wide effect. Here the log is dealt into parts once, by one of its keys, and written
as a table bucketed by part. For each wide key the distinct values per part are counted
within the part. An effect is then brought to the parts instead: joined to these values,
which is a table of keys and not of rows, and written in the same buckets. Log and effect
agree in part and key, and since both are bucketed by part, nothing is shuffled. For that
the planner must accept rows that are placed by one of the two join keys, which CO_PLACED
tells it for as long as the parts are open.

A key that holds at least one row in HOT_KEYS has its rows spread over all parts; there
are at most HOT_KEYS such keys, so their list is broadcast. Other keys that are not the
dealing one occur in several parts anyway, with one row of the effect in each.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectspark.operators.lookup import HOT_KEYS, same
from effectspark.sources.store import Stored, Workspace

PART = "__part"
PART_ROWS = 1 << 19  # a task sorts a part
CO_PLACED = "spark.sql.requireAllClusterKeysForCoPartition"


@dataclass
class Parts:
    """``frame`` is the log with its part; close the parts once what is made from them has been written."""

    ws: Workspace
    count: int
    frame: DataFrame
    values: dict[str, DataFrame]
    tables: list[str] = field(default_factory=list)
    _effects: dict[tuple, DataFrame] = field(default_factory=dict)
    _before: str | None = None

    def open(self) -> Parts:
        self._before = self.ws.spark.conf.get(CO_PLACED)
        self.ws.spark.conf.set(CO_PLACED, "false")
        return self

    def attach(self, rows: DataFrame, table: Stored, key: str, payload: Sequence[str], prefix: str = "") -> DataFrame:
        """Add the ``payload`` of a table with a row per ``key``; NULL where no key matches.

        ``rows`` come from ``frame`` without a shuffle in between, and still have their part.
        """
        at = (table.path, key, *payload)
        if at not in self._effects:
            effect = table.df.select(F.col(key).alias("__key"), *payload)
            met = self.values[key].select(PART, key).join(effect, same(F.col(key), F.col("__key")))
            self._effects[at] = self._write(met.select(PART, key, *payload))
        names = {PART: "__at", key: "__key"} | {p: prefix + p for p in payload}
        side = self._effects[at].select(*[F.col(c).alias(n) for c, n in names.items()])
        found = rows.join(side, (F.col(PART) == F.col("__at")) & same(F.col(key), F.col("__key")), "left")
        return found.drop("__at", "__key")

    def _write(self, df: DataFrame, dealt: bool = False) -> DataFrame:
        name = f"effectspark_{uuid.uuid4().hex}"
        rows = df if dealt else df.repartition(self.count, PART)
        rows.write.bucketBy(self.count, PART).option("path", self.ws.path(name)).saveAsTable(name)
        self.tables.append(name)
        return self.ws.spark.table(name)

    def close(self) -> None:
        """Take the tables out of the session's catalog; their files go with the workspace."""
        if self._before is not None:
            self.ws.spark.conf.set(CO_PLACED, self._before)
            self._before = None
        for name in self.tables:
            self.ws.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()

    def __enter__(self) -> Parts:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def enough(rows: int, least: int) -> int:
    """Parts for a log of so many rows: at least ``least``, and as many as keep each near ``PART_ROWS``."""
    return max(least, -(-rows // PART_ROWS))


def deal(frame: DataFrame, ws: Workspace, keys: Sequence[str], count: int | None = None) -> Parts:
    """Write ``frame`` in parts by the first of ``keys``; all of ``keys`` can be joined later.

    ``frame`` is read twice; pass a stored table. ``count`` is the number of parts, by
    default that of shuffle partitions.
    """
    by = keys[0]
    count = count or int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    parts = Parts(ws, count, frame, {}).open()
    counts = ws.save(frame.groupBy(by).agg(F.count(F.lit(1)).alias("n")), f"rows-per-{by}")
    total = counts.df.agg(F.sum("n")).first()[0] or 0
    hot = counts.df.filter(F.col("n") * HOT_KEYS >= total).select(F.col(by).alias("__hot"), F.lit(True).alias("__is_hot"))
    spread = F.when(F.col("__is_hot"), F.xxhash64(*frame.columns)).otherwise(F.xxhash64(by))
    labels = F.array(*[F.lit(x) for x in _labels(ws, count)])
    marked = frame.join(F.broadcast(hot), same(F.col(by), F.col("__hot")), "left")
    placed = marked.select(*frame.columns, F.get(labels, F.pmod(spread, F.lit(count)).cast("int")).alias(PART))
    parts.frame = parts._write(placed)
    for key in keys:
        values = parts.frame.groupBy(PART, key).agg(F.count(F.lit(1)).alias("n"))
        parts.values[key] = parts._write(values, dealt=True)
    return parts


def _labels(ws: Workspace, count: int) -> list[int]:
    """A number for each part that hashes to a bucket of its own, so that buckets are even."""
    found: dict[int, int] = {}
    start = 0
    while len(found) < count:
        tried = ws.spark.range(start, start + 16 * count, 1, 1).select(F.col("id").cast("int").alias("x"))
        buckets = tried.groupBy(F.pmod(F.hash("x"), F.lit(count)).alias("bucket")).agg(F.min("x").alias("x"))
        for r in buckets.collect():
            found.setdefault(r["bucket"], r["x"])
        start += 16 * count
    return [found[b] for b in range(count)]
