"""Windows of a stream: every row is counted once or reported late, across restarts."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from effectspark.streaming import live
from effectspark.streaming.lateness import LateWindows, window_stream

COLUMNS = {"ts": "timestamp", "kind": "string", "value": "double", "n": "integer", "closed": "string", "watermark": "integer"}
SCHEMA = T.StructType()
for name, column_type in COLUMNS.items():
    SCHEMA.add(name, column_type)
DAY = dt.timedelta(days=1)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def event(ts, kind="a", value=1.0):
    return (ts, kind, value, 5, "c", 7)


def plain(batches, delay, hours=24, slide=24):
    """Counts per window and key, late rows per window, straight from the rule."""
    sums, late, newest = defaultdict(list), defaultdict(int), None
    for batch in batches:
        mark = newest - delay if newest is not None else None
        for ts, kind, value, *_ in batch:
            if ts is None:
                late[None, kind] += 1
                continue
            start = dt.datetime(1970, 1, 1) + (ts - dt.datetime(1970, 1, 1)) // dt.timedelta(hours=slide) * dt.timedelta(hours=slide)
            while start + dt.timedelta(hours=hours) > ts:
                if mark is not None and start + dt.timedelta(hours=hours) <= mark:
                    late[start, kind] += 1
                else:
                    sums[start, kind].append(value)
                start -= dt.timedelta(hours=slide)
        times = [r[0] for r in batch if r[0] is not None]
        newest = max([t for t in (newest, max(times, default=None)) if t is not None], default=None)
    done = {w for w in sums if newest is not None and w[0] + dt.timedelta(hours=hours) <= newest - delay}

    def mean(values):
        known = [v for v in values if v is not None]
        return round(sum(known) / len(known), 9) if known else None

    return {w: (mean(v), len(v)) for w, v in sums.items()}, done, dict(late)


def make(ws, path, delay=3600, **options):
    return LateWindows(ws, path, SCHEMA, "ts", "value", ["kind"], options.pop("window", "1 day"), delay, **options)


def rows_of(df):
    got = df.collect()
    out = {(r["window_start"], r["kind"]): (r["mean_value"] if r["mean_value"] is None else round(r["mean_value"], 9), r["n"]) for r in got}
    assert len(out) == len(got)
    return out


def check(spark, ws, batches, delay=3600, hours=24, slide=24):
    options = {"window": f"{hours} hours", "slide": None if hours == slide else f"{slide} hours"}
    windows = make(ws, ws.path("w"), delay, **options)
    for number, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SCHEMA).repartition(2)
        assert windows.add(df, number)
        assert not windows.add(df, number)
    sums, done, late = plain(batches, dt.timedelta(seconds=delay), hours, slide)
    assert rows_of(windows.closed()) == {w: v for w, v in sums.items() if w in done}
    assert rows_of(windows.open()) == {w: v for w, v in sums.items() if w not in done}
    got = defaultdict(int)
    for r in windows.late().collect():
        got[r["window_start"], r["kind"]] += 1
    assert got == late
    return windows


def test_a_planted_late_row(spark, ws):
    batches = [[event(at(1, 1)), event(at(3, 12))], [event(at(1, 2), value=100.0), event(at(3, 13), "b")], [event(at(2, 23)), event(at(9))]]
    windows = check(spark, ws, batches)
    (first, second) = sorted(windows.late().collect(), key=lambda r: r["ts"])
    assert (first["window_start"], first["seconds_behind"], first["value"]) == (at(1), (at(3, 12) - at(1, 2)).total_seconds(), 100.0)
    assert second["seconds_behind"] == (at(3, 13) - at(2, 23)).total_seconds()


@pytest.mark.parametrize("hours, slide", [(24, 24), (24, 6), (6, 6)])
def test_random_streams_lose_nothing(spark, ws, hours, slide):
    r = random.Random(hours + slide)
    batches = []
    for k in range(6):
        times = [at(2 + 2 * k) + dt.timedelta(minutes=r.randrange(-5000, 3000)) for _ in range(r.choice([0, 1, 60]))]
        batches.append([event(r.choice([t, t, t, t, None]), r.choice(["a", None, ""]), r.choice([None, 1.5, 2.0])) for t in times])
    windows = check(spark, ws, batches, 7200, hours, slide)
    counted = sum(r["n"] for r in [*windows.closed().collect(), *windows.open().collect()]) + windows.late().filter("ts IS NOT NULL").count()
    assert counted == sum(r[0] is not None for b in batches for r in b) * (hours // slide)


def test_a_batch_that_dies_is_taken_in_once(spark, ws, monkeypatch):
    batches = [[event(at(1)), event(at(5))], [event(at(1)), event(at(5), value=3.0), event(at(6, 2))]]
    windows = make(ws, ws.path("w"))
    windows.add(spark.createDataFrame(batches[0], SCHEMA), 0)
    with monkeypatch.context() as patch:
        patch.setattr(windows.versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            windows.add(spark.createDataFrame(batches[1], SCHEMA), 1)
    assert rows_of(windows.open()) == {(at(5), "a"): (1.0, 1)} and windows.late().isEmpty()
    again = make(ws, windows.root)
    again.add(spark.createDataFrame(batches[1], SCHEMA), 1)
    assert rows_of(again.closed()) == {(at(1), "a"): (1.0, 1), (at(5), "a"): (2.0, 2)}
    assert again.late().count() == 1


def test_a_restarted_stream(spark, ws):
    folder, root, progress = ws.path("in"), ws.path("w"), ws.path("progress")
    parts = [[event(at(d, h)) for d in (1, 2, 3) for h in (1, 9)], [event(at(1, 3)), event(at(3, 10)), event(at(4, 2))]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(SCHEMA).parquet(folder)
        window_stream(arriving, make(ws, root), progress).awaitTermination()
    windows = make(ws, root)
    assert rows_of(windows.closed()) == {(at(d), "a"): (1.0, n) for d, n in ((1, 2), (2, 2), (3, 3))}
    assert rows_of(windows.open()) == {(at(4), "a"): (1.0, 1)}
    assert [r["ts"] for r in windows.late().collect()] == [at(1, 3)]


def test_nothing_has_arrived(spark, ws):
    windows = make(ws, ws.path("w"))
    assert windows.closed().isEmpty() and windows.open().isEmpty() and windows.late().isEmpty()
    folder = ws.path("in")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    arriving = spark.readStream.schema(SCHEMA).parquet(folder).withColumn("slot", live.F.col("ts"))
    rolling = live.rolling_profile(arriving, "ts", "value", ["kind"], "1 day", "1 hour")
    out = live.run_to_table(rolling, ws, "none", ["window_start", "window_end", "kind"])
    assert out.isEmpty() and out.columns == rolling.columns


def test_a_window_that_had_only_late_rows(spark, ws):
    windows = check(spark, ws, [[event(at(9))], [event(at(1)), event(at(1), "b")], []])
    assert rows_of(windows.closed()) == {} and windows.late().count() == 2
