"""Loss of signal: a pilot is LOST after two minutes without a fix, by the stream's own clock."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOST_AFTER_S = 120
OUTPUT = T.StructType([T.StructField("task_id", T.StringType()), T.StructField("pilot_id", T.StringType()),
                       T.StructField("last_t", T.LongType()), T.StructField("tracking", T.StringType())])
STATE = T.StructType([T.StructField("last_t", T.LongType())])


def lost_periods(track: DataFrame) -> DataFrame:
    """Silences in a finished track: when the pilot was declared lost and when heard again."""
    w = Window.partitionBy("task_id", "pilot_id").orderBy("t")
    rows = track.select("task_id", "pilot_id", "t", F.lead("t").over(w).alias("next_t"))
    return rows.where(F.col("next_t") - F.col("t") > LOST_AFTER_S).select(
        "task_id", "pilot_id", (F.col("t") + LOST_AFTER_S).alias("lost_t"), F.col("next_t").alias("back_t"))


def _watch(key, batches, state):
    """One state row per pilot: the last time heard; a timer fires when it gets too old."""
    if state.hasTimedOut:
        (last,) = state.get
        state.remove()
        yield pd.DataFrame({"task_id": [key[0]], "pilot_id": [key[1]], "last_t": [last], "tracking": ["LOST"]})
        return
    last = state.get[0] if state.exists else -1
    for pdf in batches:
        last = max(last, int(pdf["t"].max()))
    state.update((last,))
    state.setTimeoutTimestamp(max((last + LOST_AFTER_S) * 1000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"task_id": [key[0]], "pilot_id": [key[1]], "last_t": [last], "tracking": ["ONLINE"]})


def watch_silence(fixes: DataFrame) -> DataFrame:
    """Streaming fixes (task_id, pilot_id, t) to ONLINE / LOST changes, by event time."""
    timed = fixes.select("task_id", "pilot_id", "t", F.timestamp_seconds("t").alias("at")).withWatermark("at", "10 seconds")
    return timed.groupBy("task_id", "pilot_id").applyInPandasWithState(_watch, OUTPUT, STATE, "append", "EventTimeTimeout")
