"""Streams of events: captures appended, keys seen once, windows, state by key.

Each function takes and returns a streaming DataFrame; the caller starts the query with a checkpoint location."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def captures(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a landing folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(rows: DataFrame, key: str, event_time: str, late: str = "1 day") -> DataFrame:
    """One row of each key, of those that arrive together any one; keys are remembered until the watermark passes them.  See earliest()."""
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def earliest(rows: DataFrame, key: str, event_time: str) -> DataFrame:
    """The row of each key that is earliest so far, for update mode: a key comes again when a still earlier row of it arrives.

    The state is a row per key and is never forgotten; of rows at the same time the one with the least other columns counts."""
    others = [event_time, *(c for c in rows.columns if c not in (key, event_time))]
    first = F.min(F.when(F.col(event_time).isNotNull(), F.struct(*others)))
    return rows.groupBy(key).agg(first.alias("__first")).select(key, *(F.col(f"__first.{c}").alias(c) for c in others))


def windowed(rows: DataFrame, event_time: str, width: str, keys: list[str], value: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count, mean, least and greatest of a value by window and keys; late rows within the watermark count."""
    w = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    grouped = rows.withWatermark(event_time, late).groupBy(w, *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi")).select("window.start", "window.end", *keys, "n", "mean", "lo", "hi")


def sessions(rows: DataFrame, event_time: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Events of a key with no longer gap between them."""
    return rows.withWatermark(event_time, late).groupBy(F.session_window(event_time, gap), key).agg(F.count(F.lit(1)).alias("n")).select("session_window.start", "session_window.end", key, "n")


def price_moves(rows: DataFrame, key: str = "outcome_id") -> DataFrame:
    """Per key and batch: its first, last, least and greatest odds so far and how many rows; the state is five numbers."""
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, n long, first_odds double, last_odds double, lo double, hi double"

    def update(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last, lo, hi = state.get if state.exists else (0, None, None, float("inf"), float("-inf"))
        for part in parts:
            part = part.sort_values("captured_at")
            n, last = n + len(part), float(part["odds"].iloc[-1])
            first = float(part["odds"].iloc[0]) if first is None else first
            lo, hi = min(lo, float(part["odds"].min())), max(hi, float(part["odds"].max()))
        state.update((n, first, last, lo, hi))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "first_odds": [first], "last_odds": [last], "lo": [lo], "hi": [hi]})

    return rows.select(key, "captured_at", "odds").groupBy(key).applyInPandasWithState(update, schema, "n long, first double, last double, lo double, hi double", "update", GroupStateTimeout.NoTimeout)
