"""Statistical building blocks as Spark columns and frames.

Missing values are SQL nulls; ``finite`` turns NaN and infinities into null so that aggregates skip them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def finite(x: str | Column) -> Column:
    """The value as double, or null where it is null, NaN or infinite."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is 0."""
    return F.try_divide(a, b)


def over(by: Sequence[str] | str) -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by))


def with_totals(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates over all its rows as columns: one row, sent to the others.

    Unlike a window without a partition this does not bring all rows into one task.
    """
    return df.crossJoin(F.broadcast(df.agg(*[a.alias(n) for n, a in aggregates.items()])))


def center(x: str, by: Sequence[str]) -> Column:
    return F.col(x) - F.avg(x).over(over(by))


def zscore(x: str, by: Sequence[str]) -> Column:
    """Deviation from the group's mean in sample standard deviations; null where there is no spread."""
    return ratio(center(x, by), F.stddev_samp(x).over(over(by)))


def unit_norm(x: str, by: Sequence[str]) -> Column:
    return ratio(F.col(x), F.sqrt(F.sum(F.col(x) * F.col(x)).over(over(by))))


def tied_rank(x: str, by: Sequence[str], descending: bool = False) -> Column:
    """1-based rank within the group; ties share their mean rank; null stays null."""
    order = F.col(x).desc_nulls_last() if descending else F.col(x).asc_nulls_last()
    first = F.rank().over(over(by).orderBy(order)).cast("double")
    ties = F.count("*").over(over([*([by] if isinstance(by, str) else by), x]))
    return F.when(F.col(x).isNotNull(), first + (ties - 1) / F.lit(2.0))


def percentiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Percentiles by group at Hazen plotting positions: place n * p + 1/2 clamped to 1..n, linear between ranks."""
    w = over(list(by)) if by else Window.partitionBy(F.lit(0))
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), F.row_number().over(w.orderBy(F.col(value))).alias("k"), F.count("*").over(w).alias("n"))
    out = []
    for name, p in probs.items():
        at = F.least(F.greatest(F.col("n") * p + 0.5, F.lit(1.0)), F.col("n").cast("double"))
        low = F.sum(F.when(F.col("k") == F.floor(at), F.col("v") * (1 - (at - F.floor(at)))))
        high = F.sum(F.when(F.col("k") == F.floor(at) + 1, F.col("v") * (at - F.floor(at))))
        out.append((low + F.coalesce(high, F.lit(0.0))).alias(name))
    return rows.groupBy(*by).agg(*out)


def held(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df``, a row a group, computed now: up to ``most`` rows by way of the driver, as a plan of its own, else kept on the cluster."""
    few = df.limit(most + 1).collect()  # bounded
    if len(few) <= most:
        return F.broadcast(df.sparkSession.createDataFrame(few, df.schema))  # Spark does not know its size otherwise
    df = df.persist()
    df.count()
    return df


def medians(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., median) of groups, exact, by counting: no task holds the values of a group.

    Rough quantiles enclose the middle; values below them are counted, and only those between are put in order.  Should they not enclose it, all values are.
    """
    keys, rows = list(by), df.select(*by, F.col(value).alias("_v")).dropna(subset=["_v"])
    rough = rows.groupBy(*keys).agg(F.percentile_approx("_v", [0.49, 0.51], 2000).alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    at = rows.join(held(rough), keys)
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    counted = at.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(F.when(F.col("_v") < lo, 1)).alias("_less"), F.count(F.when(F.col("_v") <= hi, 1)).alias("_upto"), F.first("_min").alias("_min"), F.first("_max").alias("_max"), F.first("_q").alias("_q"))
    first, last = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    encloses = (F.col("_less") < first) & (F.col("_upto") >= last)
    bounds = counted.select(*keys, first.alias("_first"), last.alias("_last"), F.when(encloses, F.col("_less")).otherwise(0).alias("_less"), F.when(encloses, lo).otherwise(F.col("_min")).alias("_lo"), F.when(encloses, hi).otherwise(F.col("_max")).alias("_hi"))
    between = rows.join(held(bounds), keys).filter("_v >= _lo AND _v <= _hi").groupBy(*keys, "_v", "_first", "_last", "_less").agg(F.count("*").alias("_c"))
    upto = between.withColumn("_k", F.col("_less") + F.sum("_c").over(over(keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def ranked(k: str) -> Column:
        return F.max(F.when((F.col("_k") >= F.col(k)) & (F.col("_k") - F.col("_c") < F.col(k)), F.col("_v")))

    middle = upto.groupBy(*keys).agg(ranked("_first").alias("_a"), ranked("_last").alias("_b"))
    return middle.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(0.5 * F.col("_a") + 0.5 * F.col("_b")).alias("median"))


def detrended(df: DataFrame, value: str, t: str, by: Sequence[str], out: str = "resid") -> DataFrame:
    """``df`` with the residual of the group's least-squares line on t."""
    w = over(by)
    fit = {"_slope": F.regr_slope(value, t).over(w), "_cut": F.regr_intercept(value, t).over(w)}
    return df.withColumns(fit).withColumn(out, F.col(value) - (F.col("_cut") + F.col("_slope") * F.col(t))).drop(*fit)


def series(df: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    """(series_id, t from 1, value) of a table of timed rows."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.select(F.col(by).alias("series_id"), F.row_number().over(w).alias("t"), finite(value).alias("value"))


def unpack(df: DataFrame, id_col: str, array_col: str, dims: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(sample_id, var_id from 1, value) of an array column, its first ``dims`` entries where given."""
    array = F.slice(array_col, 1, dims) if dims else F.col(array_col)
    rows = df.select(F.col(id_col).alias("sample_id"), *keep, F.posexplode(array).alias("p", "v"))
    return rows.select("sample_id", *keep, (F.col("p") + 1).alias("var_id"), finite("v").alias("value"))
