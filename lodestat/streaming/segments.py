"""Structured Streaming forms of the windowed series operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_stats(events: DataFrame, ts: str, value: str, by: str, length: str, hop: str | None = None, late: str = "1 hour") -> DataFrame:
    """(by, start, n, mean, sd) over tumbling or hopping windows of event time; rows later than ``late`` are left out."""
    w = F.window(F.col(ts).cast("timestamp"), length, hop) if hop else F.window(F.col(ts).cast("timestamp"), length)
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(by, w.alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).select(by, F.col("w.start").alias("start"), "n", "mean", "sd")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(by, start, finish, n): sessions that end after a gap."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def displacement(events: DataFrame, by: str, t: str, value: str, window: int) -> DataFrame:
    """(by, t, value, d): squared distance of each value from the mean of the ``window`` values before it, kept as state.

    State is the last ``window`` values of each key; rows of one micro-batch go by ``t``.
    """

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        rows = []
        for pdf in frames:
            for at, v in sorted(zip(pdf["t"], pdf["v"], strict=True)):
                rows.append((key[0], at, v, (v - sum(seen) / len(seen)) ** 2 if seen else 0.0))
                seen = [*seen, float(v)][-window:]
        state.update((seen,))
        yield pd.DataFrame(rows, columns=["k", "t", "value", "d"])

    rows = events.select(F.col(by).alias("k"), F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v")).dropna()
    kind = rows.schema["k"].dataType.simpleString()
    return rows.groupBy("k").applyInPandasWithState(run, f"k {kind}, t double, value double, d double", "seen array<double>", "append", "NoTimeout").withColumnRenamed("k", by)
