"""Windowed sums of a stream in which no row disappears.

Spark's own windows drop rows behind the watermark without a trace. Here the watermark
is part of a committed state, so every row is either counted or reported: rows of windows
that had already been closed go to a second output, with the window and how far they are
behind. The watermark a batch is judged by comes from the batches before it: the latest
time seen, less the allowed delay.

Each batch adds its sums, made map-side, to those of the windows still open; windows that
the new watermark closes are emitted once. Everything a batch writes lies in a folder of
its number and counts from the commit of that number on, so a batch that is repeated after
a failure or a restart replaces what it wrote. The state holds open windows only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from effectspark.sources.store import Workspace
from effectspark.sources.versions import Versions

_SUMS = ("s", "valued", "n")
MICROS = 1_000_000


class LateWindows:
    """Sums per window and key below one folder, which belongs to one stream.

    ``window`` and ``slide`` are durations as Spark writes them; ``delay`` is in seconds.
    """

    def __init__(
        self, ws: Workspace, path: str, schema: T.StructType, time: str, value: str, by: Sequence[str], window: str,
        delay: float, slide: str | None = None,
    ):
        self.ws, self.schema, self.time, self.value, self.by = ws, schema, time, value, list(by)
        self.window, self.delay, self.slide = window, int(delay * MICROS), slide
        self.versions = Versions(ws.spark, path)
        self.root = self.versions.root

    def add(self, rows: DataFrame, number: int) -> bool:
        """Take in one batch; false if its number has been taken in already."""
        last = self.versions.latest()
        if last is not None and number <= last:
            return False
        before = self.versions.read(last)["watermark"] if last is not None else None
        rows = rows.select(*self.schema.names).persist()
        try:
            newest = rows.agg(F.max(F.unix_micros(self.time))).first()[0]
            marks = [m for m in (before, None if newest is None else newest - self.delay) if m is not None]
            now = max(marks, default=None)
            self._judged(rows, before, late=True).write.mode("overwrite").parquet(f"{self.root}/late/batch={number}")
            sums = self._summed(self._judged(rows, before, late=False))
            if last is not None:
                sums = self._merged([sums, self._windows([last], closed=False)])
            done = F.lit(False) if now is None else F.unix_micros("window_end") <= now
            sums.withColumn("closed", done).write.mode("overwrite").partitionBy("closed").parquet(f"{self.root}/windows/batch={number}")
        finally:
            rows.unpersist()
        self.versions.commit(number, {"watermark": now})
        if last is not None:
            self.ws.delete(f"{self.root}/windows/batch={last}/closed=false")
        return True

    def _slots(self, rows: DataFrame) -> DataFrame:
        """A row per window a row lies in; rows without a time lie in none, and stay."""
        slot = F.window(self.time, self.window, self.slide) if self.slide else F.window(self.time, self.window)
        timed = rows.filter(F.col(self.time).isNotNull()).withColumn("__slot", slot)
        placed = timed.select("*", F.col("__slot.start").alias("window_start"), F.col("__slot.end").alias("window_end")).drop("__slot")
        never = F.lit(None).cast("timestamp")
        return placed.unionByName(rows.filter(F.col(self.time).isNull()).withColumns({"window_start": never, "window_end": never}))

    def _judged(self, rows: DataFrame, watermark: int | None, late: bool) -> DataFrame:
        """The rows behind the watermark, with ``seconds_behind``, or the others."""
        behind = F.lit(False) if watermark is None else F.unix_micros("window_end") <= watermark
        is_late: Column = F.coalesce(behind, F.lit(True)) if watermark is not None else F.col("window_end").isNull()
        slots = self._slots(rows).filter(is_late if late else ~is_late)
        if not late:
            return slots
        gap = F.lit(watermark).cast("bigint") + F.lit(self.delay) - F.unix_micros(self.time)
        return slots.withColumn("seconds_behind", gap / MICROS)

    def _summed(self, slots: DataFrame) -> DataFrame:
        return slots.groupBy("window_start", "window_end", *self.by).agg(
            F.sum(F.col(self.value).cast("double")).alias("s"), F.count(self.value).alias("valued"), F.count(F.lit(1)).alias("n")
        )

    def _merged(self, parts: Sequence[DataFrame]) -> DataFrame:
        both = reduce(DataFrame.unionByName, parts)
        return both.groupBy("window_start", "window_end", *self.by).agg(*[F.sum(c).alias(c) for c in _SUMS])

    def _window_schema(self) -> T.StructType:
        fields = [T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType())]
        fields += [self.schema[c] for c in self.by]
        return T.StructType([*fields, T.StructField("s", T.DoubleType()), T.StructField("valued", T.LongType()), T.StructField("n", T.LongType())])

    def _read(self, paths: Sequence[str], schema: T.StructType) -> DataFrame:
        there = [p for p in paths if self.ws.exists(p)]
        return self.ws.read(there, schema) if there else self.ws.spark.createDataFrame([], schema)

    def _windows(self, numbers: Sequence[int], closed: bool) -> DataFrame:
        part = str(closed).lower()
        return self._read([f"{self.root}/windows/batch={n}/closed={part}" for n in numbers], self._window_schema())

    def _shown(self, sums: DataFrame) -> DataFrame:
        mean = F.try_divide("s", "valued").alias(f"mean_{self.value}")
        return sums.select("window_start", "window_end", *self.by, mean, "n")

    def closed(self) -> DataFrame:
        """The windows emitted so far, each once."""
        return self._shown(self._windows(self.versions.numbers(), closed=True))

    def open(self) -> DataFrame:
        """The windows that may still change."""
        last = self.versions.latest()
        return self._shown(self._windows([] if last is None else [last], closed=False))

    def late(self) -> DataFrame:
        """The rows that came too late, or have no time: all columns, the window and the seconds behind the newest row."""
        schema = T.StructType(
            [*self.schema.fields, T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType()),
             T.StructField("seconds_behind", T.DoubleType())]
        )
        return self._read([f"{self.root}/late/batch={n}" for n in self.versions.numbers()], schema)


def window_stream(rows: DataFrame, windows: LateWindows, checkpoint: str) -> StreamingQuery:
    """Take in all rows that have arrived; a later call with the same folders goes on."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, number: windows.add(batch, number)).start()
