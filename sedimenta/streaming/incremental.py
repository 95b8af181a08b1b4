"""The ordered analyses as streams: windows, sessions, and matching within a horizon.

Each takes a streaming (or static) table of events and holds state only within
its watermark; `batch equals stream` is how the tests check them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark, folder: str) -> DataFrame:
    """A stream of the event files of a folder."""
    rows = spark.readStream.schema(EVENTS).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def monthly(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events by type and 30-day window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "30 days").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def trailing(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events by type over six periods, moved one period at a time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "6 days", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))


def quiet_sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Sessions of a user, parted by a quiet time of `gap` or longer."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))


def retouched(events: DataFrame, days: int = 14, late: str = "1 day") -> DataFrame:
    """user_id, ts, again: events followed by another of the same user within `days`.

    State is a user's last event; it goes when the watermark passes the horizon.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "ts": [pd.Timestamp(last, unit="us")], "again": [False]})
            return
        times = sorted(int(t.value // 1000) for b in batches for t in b["ts"])
        last = state.get[0] if state.exists else None
        rows = []
        for t in times:
            if last is not None:
                rows.append((key[0], pd.Timestamp(last, unit="us"), t - last <= days * 86_400_000_000))
            last = t
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["user_id", "ts", "again"])

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, ts timestamp, again boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def hook_risk(hooks: DataFrame, watched: DataFrame) -> DataFrame:
    """id, score, watched: the risk of the paths an editor's events (id, body as JSON) touch; `watched` is static."""
    paths = hooks.select("id", F.explode(F.array_distinct(F.from_json(F.get_json_object("body", "$.paths"), "array<string>"))).alias("path"))
    return paths.join(watched.select("path", "score"), "path", "left").select("id", "path", F.coalesce("score", F.lit(0.0)).alias("score"))
