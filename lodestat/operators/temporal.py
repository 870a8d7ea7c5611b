"""Time-series operators over (series_id, t, value) frames, t running from 1 without gaps.

Those that are sums over windows are plain DataFrame plans; transforms that need a whole series at once run as
one grouped map for each series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import detrended, ratio


def cumulative_profile(df: DataFrame) -> DataFrame:
    """Running sum of the deviations from the series mean."""
    w = Window.partitionBy("series_id")
    dev = df.withColumn("dev", F.col("value") - F.avg("value").over(w))
    return dev.select("series_id", "t", F.sum("dev").over(w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)).alias("profile"))


def dfa_scales(n: int, least: int = 3, count: int = 20) -> list[int]:
    """Distinct window lengths, evenly spaced on a log scale between ``least`` and n: as many of ``count`` as stay apart."""
    for k in range(min(count, max(n - least + 1, 1)), 0, -1):
        scales = [int(round(x)) for x in np.exp(np.linspace(math.log(least), math.log(n), k))]
        if len(set(scales)) == k:
            return scales
    return [least]


def dfa_fluctuation(df: DataFrame, scales: Sequence[int], both_ways: bool = True) -> DataFrame:
    """(series_id, scale, f): root mean square of the profile about its line in each window, over all windows.

    The series' own line is taken out first.  Windows run from the front and, with ``both_ways``, also from the back; what is
    left over at an end is not used.  Scales longer than a series are left out.
    """
    counted = df.withColumn("n", F.count("*").over(Window.partitionBy("series_id")))
    flat = detrended(counted, "value", "t", ["series_id"])
    w = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    profile = flat.withColumn("y", F.sum("resid").over(w)).select("series_id", "t", "n", "y")
    scale = F.explode(F.array(*[F.lit(int(s)) for s in scales])).alias("scale")
    ways = profile.select("series_id", "t", "n", "y", scale).filter("scale <= n")
    front = ways.withColumn("way", F.lit(0)).withColumn("seg", F.floor((F.col("t") - 1) / F.col("scale")))
    back = ways.withColumn("way", F.lit(1)).withColumn("seg", F.floor((F.col("n") - F.col("t")) / F.col("scale")))
    rows = (front.unionByName(back) if both_ways else front).filter(F.col("seg") < F.floor(F.col("n") / F.col("scale")))
    sse = F.regr_syy("y", "t") - ratio(F.regr_sxy("y", "t") * F.regr_sxy("y", "t"), F.regr_sxx("y", "t"))
    parts = rows.groupBy("series_id", "scale", "way", "seg").agg(sse.alias("sse"))
    return parts.groupBy("series_id", "scale").agg(F.sqrt(F.greatest(F.sum("sse") / (F.count("*") * F.col("scale")), F.lit(0.0))).alias("f"))


def dfa(df: DataFrame, scales: Sequence[int], both_ways: bool = True) -> DataFrame:
    """(series_id, hurst, r2, n_scales): slope of log fluctuation on log scale (Peng et al., 1994)."""
    f = dfa_fluctuation(df, scales, both_ways).filter("f > 0").select("series_id", F.ln("scale").alias("x"), F.ln("f").alias("y"))
    return f.groupBy("series_id").agg(F.regr_slope("y", "x").alias("hurst"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n_scales"))


def dft_power(df: DataFrame, fs: float = 1.0) -> DataFrame:
    """(series_id, k, freq, power): one-sided periodogram of each whole series by direct sums; for short series."""
    n = F.col("n").cast("double")
    rows = df.withColumn("n", F.count("*").over(Window.partitionBy("series_id")))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 2).cast("int"))))
    angle = 2.0 * math.pi * F.col("k") * (F.col("t") - 1) / n
    sums = rows.groupBy("series_id", "k", "n").agg(F.sum(F.col("value") * F.cos(angle)).alias("c"), F.sum(F.col("value") * F.sin(angle)).alias("s"))
    sides = F.when((F.col("k") == 0) | (F.col("k") * 2 == F.col("n")), 1.0).otherwise(2.0)
    return sums.select("series_id", "k", (F.col("k") * fs / n).alias("freq"), (sides * (F.col("c") ** 2 + F.col("s") ** 2) / (fs * n)).alias("power"))


def tapers(kind: str, n: int) -> np.ndarray:
    if kind == "none":
        return np.ones(n)
    a = {"hamming": 0.54, "hann": 0.5}[kind]
    return a - (1 - a) * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1))


def welch_array(x: np.ndarray, fs: float, taper: str, segment: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power) averaged over half-overlapping segments taken from both ends, padded to a power of two."""
    n = len(x) if not segment or segment > len(x) else segment
    hop = max(1, n // 2)
    starts = sorted({*range(0, len(x) - n + 1, hop), *range(len(x) - n, -1, -hop)})
    w = tapers(taper, n)
    size = 1 << max(0, (n - 1).bit_length())
    spectra = np.abs(np.fft.rfft(np.stack([x[s : s + n] * w for s in starts]), size)) ** 2 / (fs * n * np.mean(w**2))
    power = spectra.mean(axis=0)
    power[1 : -1 if size % 2 == 0 else None] *= 2
    return np.arange(len(power)) * fs / size, power


def _per_series(df: DataFrame, f, schema: str) -> DataFrame:
    """f(sorted values) -> frame, for each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values("t")["value"].fillna(0.0).to_numpy(dtype=float))
        out.insert(0, "series_id", pdf["series_id"].iloc[0])
        return out

    kind = df.schema["series_id"].dataType.simpleString()
    return df.select("series_id", "t", "value").groupBy("series_id").applyInPandas(run, f"series_id {kind}, {schema}")


def welch_psd(df: DataFrame, fs: float = 1.0, taper: str = "hann", segment: int | None = None, bandwidth: float | None = None) -> DataFrame:
    """(series_id, freq, power) by Welch's method; with ``bandwidth`` summed into bins whose lower edge is exclusive."""
    out = _per_series(df, lambda x: pd.DataFrame(dict(zip(("freq", "power"), welch_array(x, fs, taper, segment), strict=True))), "freq double, power double")
    if not bandwidth:
        return out
    bins = out.filter("freq > 0").withColumn("bin", F.ceil(F.round(F.col("freq") / bandwidth, 9)))
    return bins.groupBy("series_id", (F.col("bin") * bandwidth).alias("freq")).agg(F.sum("power").alias("power"))


def psd_hurst(df: DataFrame, fs: float, band: tuple[float, float], segment: int | None = None) -> DataFrame:
    """(series_id, slope, hurst, r2) from the log-log slope of the spectrum within a band; hurst = (1 - slope) / 2."""
    flat = detrended(df, "value", "t", ["series_id"]).select("series_id", "t", F.col("resid").alias("value"))
    psd = welch_psd(flat, fs, "hann", segment).filter(F.col("freq").between(*band) & (F.col("power") > 0))
    return _loglog(psd)


def dft_hurst(df: DataFrame, fs: float, band: tuple[float, float]) -> DataFrame:
    """``psd_hurst`` from the plain periodogram, without a grouped map."""
    flat = detrended(df, "value", "t", ["series_id"]).select("series_id", "t", F.col("resid").alias("value"))
    return _loglog(dft_power(flat, fs).filter(F.col("freq").between(*band) & (F.col("power") > 0)))


def _loglog(psd: DataFrame) -> DataFrame:
    x = psd.select("series_id", F.ln("freq").alias("x"), F.ln("power").alias("y"))
    fit = x.groupBy("series_id").agg(F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"))
    return fit.select("series_id", "slope", ((1 - F.col("slope")) / 2).alias("hurst"), "r2")


#: Low-pass decomposition filters (Daubechies, Ten Lectures on Wavelets, 1992).  Fixed values.
SCALING = {
    "haar": [0.7071067811865476, 0.7071067811865476],
    "db2": [0.48296291314469025, 0.836516303737469, 0.22414386804185735, -0.12940952255092145],
    "db3": [0.3326705529509569, 0.8068915093133388, 0.4598775021193313, -0.13501102001039084, -0.08544127388224149, 0.035226291882100656],
    "db4": [0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278],
}


def filters(wavelet: str) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal low-pass and high-pass filters."""
    low = np.array(SCALING[wavelet])
    return low, low[::-1] * (-1.0) ** np.arange(len(low))


def dwt_array(x: np.ndarray, wavelet: str) -> tuple[np.ndarray, np.ndarray]:
    """Approximation and detail with periodic extension; a series of odd length repeats its last value."""
    if len(x) % 2:
        x = np.append(x, x[-1])
    low, high = filters(wavelet)
    at = (2 * np.arange(len(x) // 2)[:, None] + np.arange(len(low))[None, :]) % len(x)
    return x[at] @ low, x[at] @ high


def idwt_array(a: np.ndarray, d: np.ndarray, wavelet: str, n: int) -> np.ndarray:
    """The series of length n whose ``dwt_array`` is (a, d)."""
    low, high = filters(wavelet)
    size = 2 * len(a)
    out = np.zeros(size)
    at = (2 * np.arange(len(a))[:, None] + np.arange(len(low))[None, :]) % size
    np.add.at(out, at, a[:, None] * low + d[:, None] * high)
    return out[:n]


def wavedec(df: DataFrame, levels: int, wavelet: str = "haar") -> DataFrame:
    """(series_id, level, kind 'a' or 'd', k from 0, coef): details of levels 1..levels and the last approximation."""

    def run(x: np.ndarray) -> pd.DataFrame:
        rows, a = [], x
        for level in range(1, levels + 1):
            if len(a) < 2:
                break
            a, d = dwt_array(a, wavelet)
            rows += [(level, "d", k, v) for k, v in enumerate(d)]
            last = level
        rows += [(last, "a", k, v) for k, v in enumerate(a)] if len(x) > 1 else [(0, "a", 0, float(v)) for v in x]
        return pd.DataFrame(rows, columns=["level", "kind", "k", "coef"])

    return _per_series(df, run, "level int, kind string, k int, coef double")


def waverec(coefs: DataFrame, sizes: DataFrame, wavelet: str = "haar", level: int = 0) -> DataFrame:
    """(series_id, t, value): the approximation at ``level``, 0 for the series itself; ``sizes`` has (series_id, n)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, top = int(pdf["n"].iloc[0]), int(pdf["level"].max())
        lengths = [n]
        for _ in range(top):
            lengths.append((lengths[-1] + 1) // 2)
        by = {key: g.sort_values("k")["coef"].to_numpy() for key, g in pdf.groupby(["level", "kind"])}
        a = by[top, "a"]
        for j in range(top, level, -1):
            a = idwt_array(a, by[j, "d"], wavelet, lengths[j - 1])
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "t": np.arange(1, len(a) + 1), "value": a})

    kind = coefs.schema["series_id"].dataType.simpleString()
    return coefs.join(sizes, "series_id").groupBy("series_id").applyInPandas(run, f"series_id {kind}, t int, value double")


def appcoef(coefs: DataFrame, sizes: DataFrame, level: int, wavelet: str = "haar") -> DataFrame:
    """The approximation at ``level`` by repeated inverse transforms."""
    return waverec(coefs, sizes, wavelet, level)


def detcoef(coefs: DataFrame, levels: Sequence[int]) -> DataFrame:
    return coefs.filter((F.col("kind") == "d") & F.col("level").isin(*levels))


def haar(df: DataFrame, levels: int = 1) -> DataFrame:
    """``wavedec`` by the Haar wavelet in window functions, over pairs of neighbours; an odd last value pairs with itself."""
    step, out = df.select("series_id", F.col("t").alias("k"), F.col("value").alias("coef")), []
    w = Window.partitionBy("series_id").orderBy("k")
    for level in range(1, levels + 1):
        pairs = step.withColumn("mate", F.coalesce(F.lead("coef").over(w), F.col("coef"))).filter("k % 2 = 1")
        pairs = pairs.select("series_id", F.floor((F.col("k") + 1) / 2).cast("int").alias("k"), ((F.col("coef") + F.col("mate")) / math.sqrt(2)).alias("a"), ((F.col("coef") - F.col("mate")) / math.sqrt(2)).alias("d"))
        out.append(pairs.select("series_id", F.lit(level).alias("level"), F.lit("d").alias("kind"), (F.col("k") - 1).alias("k"), F.col("d").alias("coef")))
        step = pairs.select("series_id", "k", F.col("a").alias("coef"))
    out.append(step.select("series_id", F.lit(levels).alias("level"), F.lit("a").alias("kind"), (F.col("k") - 1).alias("k"), "coef"))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def convolve(df: DataFrame, taps: Sequence[float], shape: str = "full") -> DataFrame:
    """(series_id, t, value): convolution with short filter taps; 'full', 'same' (central part) or 'valid'."""
    m = len(taps)
    pieces = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(c)).alias("c")) for j, c in enumerate(taps)])).alias("x")
    spread = df.withColumn("n", F.count("*").over(Window.partitionBy("series_id"))).select("series_id", "n", "t", "value", pieces)
    full = spread.groupBy("series_id", "n", (F.col("t") + F.col("x.j")).alias("t")).agg(F.sum(F.col("value") * F.col("x.c")).alias("value"))
    lo, size = {"full": (0, F.col("n") + m - 1), "same": (m // 2, F.col("n")), "valid": (m - 1, F.col("n") - m + 1)}[shape]
    return full.withColumn("t", F.col("t") - lo).filter((F.col("t") >= 1) & (F.col("t") <= size)).select("series_id", "t", "value")


def keep_part(df: DataFrame, size: int, side: str = "central") -> DataFrame:
    """A part of each series of at most ``size`` values: its 'central', 'left' or 'right' one, with t from 1 again."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    skip = {"central": F.floor((n - size) / 2), "left": F.lit(0), "right": n - size}[side]
    rows = df.withColumn("skip", F.greatest(skip, F.lit(0))).withColumn("t", F.col("t") - F.col("skip"))
    return rows.filter(F.col("t").between(1, size)).drop("skip")


def upsample_convolve(df: DataFrame, taps: Sequence[float], size: int) -> DataFrame:
    """Zeros between the values, convolved with the taps, central part of ``size``."""
    pairs = F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("value").alias("v")), F.struct(F.lit(1).alias("o"), F.lit(0.0).alias("v")))).alias("x")
    spread = df.select("series_id", "t", pairs).select("series_id", (2 * F.col("t") - 1 + F.col("x.o")).alias("t"), F.col("x.v").alias("value"))
    n = F.max("t").over(Window.partitionBy("series_id"))
    return keep_part(convolve(spread.withColumn("last", n).filter("t < last").drop("last"), taps, "full"), size)


def msd(df: DataFrame, window: int, symmetric: bool = False, robust: bool = False) -> DataFrame:
    """(t, msd): squared distance of each sample from the centre of a sliding window, summed over variables.

    ``df`` has (var_id, t, value).  The window is the ``window`` samples before or, if symmetric, on both sides without
    the sample itself; the centre is their mean or median.  The first and last sample have distance 0.
    """
    base = Window.partitionBy("var_id").orderBy("t")
    value = F.col("value")
    if robust:
        seen = F.collect_list("value").over(base.rowsBetween(-window, -1))
        if symmetric:
            seen = F.concat(seen, F.collect_list("value").over(base.rowsBetween(1, window)))
        s = F.array_sort(seen)
        half = F.size(s) / 2
        centre = F.when(F.size(s) > 0, (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(half).cast("int"))) / 2)
    elif symmetric:
        w = base.rowsBetween(-window, window)
        centre = ratio(F.sum(value).over(w) - value, F.count(value).over(w) - 1)
    else:
        centre = F.avg(value).over(base.rowsBetween(-window, -1))
    edge = (F.row_number().over(base) == 1) | F.lead("t").over(base).isNull()
    rows = df.select("t", F.when(edge, 0.0).otherwise((value - centre) ** 2).alias("d"))
    return rows.groupBy("t").agg(F.sum("d").alias("msd"))


def lag_pairs(df: DataFrame, lag: int = 1) -> DataFrame:
    """(series_id, t, value, ahead): each value with the one ``lag`` steps later."""
    return df.withColumn("ahead", F.lead("value", lag).over(Window.partitionBy("series_id").orderBy("t"))).filter("ahead IS NOT NULL")
