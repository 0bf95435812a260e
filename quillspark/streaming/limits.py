"""Meters over events: quotas by month, caps by day, and the limiter whose window starts at a first request.

quota and window_limit take a batch or a stream; stream_quota is the same meter with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def quota(events: DataFrame, key: str, ts: str, unit: str, limit: int) -> DataFrame:
    """(key, period, n, over) by calendar month or day."""
    out = events.groupBy(key, F.date_trunc(unit, F.col(ts)).alias("period")).agg(F.count("*").alias("n"))
    return out.withColumn("over", F.col("n") > limit)


def stream_quota(events: DataFrame, key: str, ts: str, window: str, limit: int, late: str = "1 hour") -> DataFrame:
    """quota for a stream, in windows of fixed length; events later than the watermark are dropped."""
    out = events.withWatermark(ts, late).groupBy(key, F.window(ts, window).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("period"), "n", (F.col("n") > limit).alias("over"))


def _walk(times: list[float], start: float | None, count: int, seconds: float, limit: int) -> tuple[list[tuple[float, int, bool]], float, int]:
    out = []
    for t in times:
        if start is None or t - start >= seconds:
            start, count = t, 0
        count += 1
        out.append((start, count, count <= limit))
    return out, start, count


def _places(times: np.ndarray, start: int | None, count: int, length: int) -> tuple[np.ndarray, int, int]:
    """Places of the sorted times of one key, from a window that is open with so many events or none: a step for each window."""
    place, i = np.empty(len(times), np.int64), 0
    while i < len(times):
        if start is None or times[i] - start >= length:
            start, count = int(times[i]), 0
        j = max(i + 1, int(np.searchsorted(times, start + length, "left")))
        place[i:j] = np.arange(count + 1, count + 1 + j - i)
        count, i = count + j - i, j
    return place, start, count


def window_limit(events: DataFrame, key: str, event_id: str, ts: str, seconds: float, limit: int) -> DataFrame:
    """(event_id, place, allowed): place of each event in its key's window, which begins at the first event after the last window.

    The windows of a key depend on each other, so a key's events are gone through in order, a window at a time; they stream
    through the task in sorted batches with three numbers of state, so a key of any size fits. Times count in microseconds.
    Events without a time are in no window: place and allowed are null. A null key is a key.
    """
    kind = events.schema[event_id].dataType
    schema = T.StructType([T.StructField(event_id, kind), T.StructField("place", T.LongType()), T.StructField("allowed", T.BooleanType())])
    length = round(seconds * 1_000_000)
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = events.select(text.alias("k"), F.col(event_id).alias("e"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, count = None, None, 0
        for b in batches:
            t = np.asarray(b.column(2))
            runs = pa.compute.run_end_encode(b.column(0)) if b.num_rows else None
            ends, keys = (runs.run_ends.to_pylist(), runs.values.to_pylist()) if b.num_rows else ([], [])
            place, lo = np.empty(b.num_rows, np.int64), 0
            for hi, k in zip(ends, keys, strict=True):
                if k != now:
                    now, start, count = k, None, 0
                place[lo:hi], start, count = _places(t[lo:hi], start, count, length)
                lo = hi
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(place), pa.array(place <= limit)], names=[event_id, "place", "allowed"])

    timed = rows.where("t is not null").repartition(parts, "k").sortWithinPartitions("k", "t", "e").mapInArrow(run, schema)
    return timed.unionByName(rows.where("t is null").select(F.col("e").alias(event_id), F.lit(None).cast("long").alias("place"), F.lit(None).cast("boolean").alias("allowed")))


def stream_window_limit(events: DataFrame, key: str, ts: str, seconds: float, limit: int) -> DataFrame:
    """window_limit for a stream: (key, ts, place, allowed) as events come, with the window's start and count as state."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        times = sorted(t for pdf in batches for t in pdf["t"])
        out, start, count = _walk(times, start, count, seconds, limit)
        state.update((start, count))
        yield pd.DataFrame({"k": [k[0]] * len(times), "t": times, "place": [p for _, p, _ in out], "allowed": [a for _, _, a in out]})

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("k"), F.col(ts).cast("timestamp").cast("double").alias("t"))
    return rows.groupBy("k").applyInPandasWithState(run, f"k {kind}, t double, place long, allowed boolean", "start double, count long", "append", GroupStateTimeout.NoTimeout)


def changed_since(docs: DataFrame, ts: str, since: str, current: F.Column | None = None) -> DataFrame:
    rows = docs.where(F.col(ts) >= F.lit(since).cast("timestamp"))
    return rows if current is None else rows.where(current)
