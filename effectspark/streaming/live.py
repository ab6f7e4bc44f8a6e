"""Ratings that arrive as a stream: scores and rolling profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectspark.operators.effects import EffectModel
from effectspark.operators.scoring import score
from effectspark.sources.store import Workspace


def score_stream(ratings: DataFrame, model: EffectModel) -> DataFrame:
    """Stream-static joins to the effect tables: no state is kept."""
    return score(ratings, model)


def rolling_profile(
    events: DataFrame, time: str, value: str, by: Sequence[str], window: str, late: str, slide: str | None = None
) -> DataFrame:
    """Mean and count per time window and key; state is dropped ``late`` after a window ends."""
    slot = F.window(time, window, slide) if slide else F.window(time, window)
    return (
        events.withWatermark(time, late)
        .groupBy(slot.alias("slot"), *by)
        .agg(F.avg(value).alias(f"mean_{value}"), F.count(F.lit(1)).alias("n"))
        .select(
            F.col("slot.start").alias("window_start"),
            F.col("slot.end").alias("window_end"),
            *by, f"mean_{value}", "n",
        )
    )


def run_to_table(stream: DataFrame, ws: Workspace, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Process all available input into a parquet table and return that table.

    A stream without state appends its rows. An aggregated one states its group
    ``keys``: each batch writes the groups it changed, and the table has the last word
    on each, the groups that are still open included. A batch that is repeated after a
    failure replaces what it wrote.
    """
    path = ws.path(name)
    writer = stream.writeStream.option("checkpointLocation", ws.path(f"{name}-progress")).trigger(availableNow=True)
    if not keys:
        writer.format("parquet").outputMode("append").start(path).awaitTermination()
        return ws.read(path, stream.schema)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/{number}")

    writer.outputMode("update").foreachBatch(write).start().awaitTermination()
    schema = stream.schema.add("__batch", "long")
    values = [c for c in stream.columns if c not in keys]
    if not ws.exists(path):  # no batch: nothing has arrived
        return ws.spark.createDataFrame([], stream.schema)
    last = F.max_by(F.struct(*values), "__batch").alias("__last")
    return ws.read(f"{path}/*", schema).groupBy(*keys).agg(last).select(*keys, "__last.*").select(*stream.columns)
