"""Rows ready for plotting: smoothers, bands, ellipses, fences, projections and layouts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import finite, percentiles, ratio, with_totals
from .resample import boot_mean, boot_slope, boot_summary
from .univariate import friedman, friedman_ranks


def _kernel(d, h, kind: str, compat: bool):
    if kind == "box":
        return (F.abs(d) < h).cast("double")
    return F.exp(-d * d / (2 * h)) if compat else F.exp(-d * d / (2 * h * h))


def kernel_smooth(points: DataFrame, grid: DataFrame, x: str, y: str, h: float, kind: str = "gauss", compat: bool = False) -> DataFrame:
    """(x0, fit, n_eff): Nadaraya-Watson curve at the points x0 of a small grid, which is sent to the rows.

    ``compat`` divides by 2h instead of 2h^2.
    """
    rows = points.select(finite(x).alias("x"), finite(y).alias("y")).dropna().crossJoin(F.broadcast(grid.select("x0")))  # a plotting grid
    w = _kernel(F.col("x") - F.col("x0"), F.lit(float(h)), kind, compat)
    return rows.groupBy("x0").agg(ratio(F.sum(w * F.col("y")), F.sum(w)).alias("fit"), F.sum(w).alias("n_eff"))


def kernel_cv(points: DataFrame, x: str, y: str, bandwidths: Sequence[float], kind: str = "gauss") -> DataFrame:
    """(h, sse, n): leave-one-out error of each bandwidth.

    Points of one x count together, so that work grows with the square of the distinct x values, not of the rows.
    """
    rows = points.select(finite(x).alias("x"), finite(y).alias("y")).dropna()
    cells = rows.groupBy("x").agg(F.count("*").alias("c"), F.sum("y").alias("sy"), F.sum(F.col("y") ** 2).alias("syy"))
    other = cells.select(F.col("x").alias("xo"), F.col("c").alias("co"), F.col("sy").alias("so"))
    hs = F.explode(F.array(*[F.lit(float(h)) for h in bandwidths])).alias("h")
    pairs = cells.join(other, F.abs(cells.x - F.col("xo")) < float("inf")).select("x", "c", "sy", "syy", "xo", "co", "so", hs)
    w = _kernel(F.col("x") - F.col("xo"), F.col("h"), kind, False)
    sums = pairs.groupBy("h", "x", "c", "sy", "syy").agg(F.sum(w * F.col("so")).alias("a"), F.sum(w * F.col("co")).alias("b"))
    # Without the point itself (weight 1): fit = (a - y) / (b - 1), so y - fit = (y b - a) / (b - 1).
    err = ratio(F.col("syy") * F.col("b") ** 2 - 2 * F.col("sy") * F.col("a") * F.col("b") + F.col("c") * F.col("a") ** 2, (F.col("b") - 1) ** 2)
    return sums.filter("b > 1.0000001").groupBy("h").agg(F.sum(err).alias("sse"), F.sum("c").alias("n"))


def ellipse_params(df: DataFrame, x: str, y: str, by: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """(by..., cx, cy, major, minor, angle): principal-axis ellipse of each cloud, in closed form."""
    g = df.select(*by, finite(x).alias("x"), finite(y).alias("y")).dropna(subset=["x", "y"]).groupBy(*by)
    m = g.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_samp("x").alias("a"), F.var_samp("y").alias("b"), F.covar_samp("x", "y").alias("c"))
    mid, gap = (F.col("a") + F.col("b")) / 2, F.sqrt(((F.col("a") - F.col("b")) / 2) ** 2 + F.col("c") ** 2)
    return m.select(*by, "cx", "cy", (scale * F.sqrt(mid + gap)).alias("major"), (scale * F.sqrt(F.greatest(mid - gap, F.lit(0.0)))).alias("minor"), (0.5 * F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))).alias("angle"))


def ellipse_axis(df: DataFrame, x: str, y: str, ex: float, ey: float) -> DataFrame:
    """One row: centre and spread along a given direction and across it."""
    n = (ex * ex + ey * ey) ** 0.5
    along, across = (F.col(x) * ex + F.col(y) * ey) / n, (F.col(y) * ex - F.col(x) * ey) / n
    return df.agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.stddev_samp(along).alias("along"), F.stddev_samp(across).alias("across"))


def fence_segments(df: DataFrame, sample: str, treatment: str, value: str, tolerance: float = 0.0, reference: str | None = None) -> DataFrame:
    """(sample, treatment, value, next_value, direction -1/0/1): change to the next treatment, or from a reference one."""
    if reference is None:
        after = F.lead(value).over(Window.partitionBy(sample).orderBy(treatment))
        rows = df.select(sample, treatment, F.col(value).alias("value"), after.alias("next_value"))
    else:
        base = df.filter(F.col(treatment) == reference).select(sample, F.col(value).alias("value"))
        rows = df.filter(F.col(treatment) != reference).select(sample, treatment, F.col(value).alias("next_value")).join(base, sample)
    d = F.col("next_value") - F.col("value")
    return rows.filter(d.isNotNull()).withColumn("direction", F.when(d > tolerance, 1).when(d < -tolerance, -1).otherwise(0))


def cd_sets(df: DataFrame, treatment: str, block: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(treatment, mean_rank, top, low): who is within a critical difference of the best and of the worst mean rank."""
    r, cd = friedman_ranks(df, treatment, block, value), friedman(df, treatment, block, value, alpha).select("critical_difference")
    rows = with_totals(r, {"most": F.max("mean_rank"), "least": F.min("mean_rank")}).crossJoin(F.broadcast(cd))  # one row
    top, low = F.col("mean_rank") >= F.col("most") - F.col("critical_difference"), F.col("mean_rank") <= F.col("least") + F.col("critical_difference")
    return rows.select(treatment, "mean_rank", top.alias("top"), low.alias("low"))


def projections(df: DataFrame, axes: Sequence[str], value: str) -> DataFrame:
    """(axis, u, v, top, bottom): greatest and least value along each of three axes of a volume."""
    out = None
    for k, axis in enumerate(axes):
        u, v = [a for i, a in enumerate(axes) if i != k]
        part = df.groupBy(F.col(u).alias("u"), F.col(v).alias("v")).agg(F.max(value).alias("top"), F.min(value).alias("bottom")).select(F.lit(axis).alias("axis"), "u", "v", "top", "bottom")
        out = part if out is None else out.unionByName(part)
    return out


def slice_layout(df: DataFrame, width: int, height: int, per_row: int, value: str = "value") -> DataFrame:
    """``df`` (x, y, z, value) with panel places (px, py) of slices laid out ``per_row`` to a row."""
    return df.select("*", ((F.col("z") % per_row) * width + F.col("x")).alias("px"), (F.floor(F.col("z") / per_row) * height + F.col("y")).alias("py"))


def box_ci(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], reps: int = 1000, seed: int = 1) -> DataFrame:
    """(by..., av, se, bsr, p, ci_low, ci_high): bootstrap mean of each group."""
    return boot_summary(boot_mean(df, value, order, by, reps, seed), "stat", by)


def reg_band(df: DataFrame, grid: DataFrame, x: str, y: str, order: Sequence[str], reps: int = 1000, seed: int = 1) -> DataFrame:
    """(x0, fit, ci_low, ci_high): bootstrap band of the regression line at the points of a small grid."""
    lines = boot_slope(df, x, y, order, reps, seed).crossJoin(F.broadcast(grid.select("x0")))  # a plotting grid
    at = lines.withColumn("f", F.col("intercept") + F.col("stat") * F.col("x0")).persist()
    return at.groupBy("x0").agg(F.avg("f").alias("fit")).join(percentiles(at, "f", {"ci_low": 0.025, "ci_high": 0.975}, ["x0"]), "x0")


def error_offsets(df: DataFrame, group: str, mean: str, spread: str, gap: float = 0.05) -> DataFrame:
    """``df`` with (x, low, high): bars set apart by a small offset for each group."""
    place = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(group))
    return df.withColumns({"x": place * gap, "low": F.col(mean) - F.col(spread), "high": F.col(mean) + F.col(spread)})


def pchip(x: np.ndarray, y: np.ndarray, x0: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation (Fritsch and Carlson, 1980)."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        m[:] = d[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = d[:-1] * d[1:] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)
        for end, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
            e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            m[end] = 0.0 if e * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(e) > 3 * abs(d0) else e
    i = np.clip(np.searchsorted(x, x0, side="right") - 1, 0, len(x) - 2)
    t = (x0 - x[i]) / h[i]
    return (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h[i] * m[i] + t * t * (3 - 2 * t) * y[i + 1] + t * t * (t - 1) * h[i] * m[i + 1]


def shade_fill(df: DataFrame, by: str, x: str, low: str, high: str, points: int = 50) -> DataFrame:
    """(by, x, low, high): band edges interpolated at evenly spaced points, one grouped map a band."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        at = np.linspace(pdf["x"].min(), pdf["x"].max(), points)
        v = pdf["x"].to_numpy(float)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "x": at, "low": pchip(v, pdf["low"].to_numpy(float), at), "high": pchip(v, pdf["high"].to_numpy(float), at)})

    rows = df.select(F.col(by).alias("g"), F.col(x).cast("double").alias("x"), F.col(low).cast("double").alias("low"), F.col(high).cast("double").alias("high"))
    return rows.groupBy("g").applyInPandas(run, f"g {rows.schema['g'].dataType.simpleString()}, x double, low double, high double").withColumnRenamed("g", by)
