"""Joins by time: the latest row of another table at or before each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, values: Sequence[str], ties: Sequence[str] = (), within: Column | None = None, prefix: str = "last_") -> DataFrame:
    """``left`` with ``values`` and ``time`` of the latest row of ``right`` of the same ``by`` whose time is not later, named with ``prefix``.

    Of right rows at one time the last by ``ties`` counts.  ``within`` is the longest time apart (an interval, or a number for numeric times); what is older
    counts as none.  Keys that are null match each other, a null time matches nothing, every left row stays once, and equal left rows stay equal.
    Both tables are merged once by key and time, and the latest right row is carried along in a window: no pairs are made.
    """
    stamp = right.filter(F.col(time).isNotNull()).select(*by, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(*ties).alias("_tie") if ties else F.lit(0).alias("_tie"), F.struct(F.col(time).alias("_t"), *values).alias("_right"))
    rows = left.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    merged = stamp.unionByName(rows, allowMissingColumns=True)
    seen = F.last("_right", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col("_t").asc_nulls_first(), "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    out = merged.withColumn("_seen", seen).filter("_side = 1")
    if within is not None:
        out = out.withColumn("_seen", F.when(F.col("_seen._t") + within >= F.col("_t"), F.col("_seen")))
    return out.select(*[F.col("_left")[c].alias(c) for c in left.columns], *[F.col(f"_seen.{c}").alias(f"{prefix}{c}") for c in values], F.col("_seen._t").alias(f"{prefix}{time}"))
