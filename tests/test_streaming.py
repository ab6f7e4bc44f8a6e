"""Streams: late rows, open windows, scores equal to batch."""

import datetime as dt

from pyspark.sql import functions as F

from effectspark.operators import effects as E
from effectspark.operators import scoring as S
from effectspark.sources import standin
from effectspark.streaming import live


def test_rolling_profile_drops_late_rows(spark, ws):
    def at(day, hour):
        return dt.datetime(2024, 1, day, hour)

    batches = [
        [(at(1, 1), "a", 1.0), (at(1, 2), "a", 3.0), (at(3, 12), "b", 5.0)],
        [(at(3, 13), "b", 7.0)],
        [(at(1, 3), "a", 100.0), (at(4, 12), "a", 7.0)],
    ]
    path = ws.path("events")
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
        df.coalesce(1).write.parquet(f"{path}/batch={i}")
    schema = "ts timestamp, event_type string, value double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/batch=*")
    rolling = live.rolling_profile(stream, "ts", "value", ["event_type"], "1 day", "1 hour")
    closed = live.run_to_table(rolling, ws, "closed")
    rows = lambda df: {(r["window_start"].day, r["event_type"], r["mean_value"], r["n"]) for r in df.collect()}
    assert rows(closed) == {(1, "a", 2.0, 2), (3, "b", 6.0, 2)}
    all_windows = live.run_to_table(rolling, ws, "all", ["window_start", "window_end", "event_type"])
    assert rows(all_windows) == {(1, "a", 2.0, 2), (3, "b", 6.0, 2), (4, "a", 7.0, 1)}


def test_sliding_windows(spark, ws):
    path = ws.path("events")
    rows = [(dt.datetime(2024, 1, 1, 12), "a", 1.0), (dt.datetime(2024, 1, 9), "a", 1.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(path)
    rolling = live.rolling_profile(stream, "ts", "value", ["event_type"], "1 day", "1 hour", slide="12 hours")
    out = live.run_to_table(rolling, ws, "out")
    assert out.filter("n = 1 AND window_start < '2024-01-02'").count() == 2


def test_stream_scores_equal_batch_scores(spark, ws, tiny):
    stored = standin.model_frame(spark, tiny, ws)
    model = E.fit(stored.df, E.SHRUNK_ORDER[:3], ws, [5.0])
    columns = [*standin.ROW_KEY, "pred"]
    batch = S.score(stored.df.filter("is_val"), model).select(*columns)
    arriving = spark.readStream.schema(stored.df.schema).parquet(stored.path).filter(F.col("is_val"))
    scored = live.run_to_table(live.score_stream(arriving, model).select(*columns), ws, "scores")
    assert scored.count() == batch.count() == 561
    assert scored.exceptAll(batch).isEmpty()


def test_event_profile_of_a_folder_of_files(spark, tiny, tmp_path):
    from effectspark.plans import catalog

    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    profile = catalog.queries()["stream_event_profile"]
    whole, parts = profile(spark, tiny), profile(spark, str(tmp_path))
    assert whole.agg(F.sum("n")).first()[0] == events.count()
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
