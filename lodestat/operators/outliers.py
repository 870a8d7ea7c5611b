"""Outlier detection over long (var_id, sample_id, value) frames."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.stats import finite, held, medians, ratio
from . import linalg
from .resample import hash_int


def gamma_threshold(df: DataFrame, var: str, sample: str, value: str, alpha: float = 0.05, combine: str = "intersect") -> DataFrame:
    """(sample, p, outlier): upper-tail p of each sample under a gamma fitted to each variable, combined over variables.

    Values are clamped above zero and scaled by the variable's maximum.  'intersect' takes the greatest p, 'union' the least.
    """
    v = F.greatest(finite(value), F.lit(2.220446049250313e-16))
    rows = df.select(F.col(var).alias("var"), F.col(sample).alias("sample"), v.alias("v")).withColumn("v", F.col("v") / F.max("v").over(Window.partitionBy("var")))
    fit = rows.groupBy("var").agg(F.avg("v").alias("m"), F.avg(F.ln("v")).alias("ml"))

    @F.pandas_udf("double")
    def shape(m: pd.Series, ml: pd.Series) -> pd.Series:
        return pd.Series([dist.gamma_shape(a, b) for a, b in zip(m, ml, strict=True)])

    fit = fit.withColumn("k", shape("m", "ml")).withColumn("scale", ratio(F.col("m"), F.col("k")))
    scored = rows.join(fit, "var").withColumn("p", dist.gamma_tail(F.col("v"), F.col("k"), F.col("scale")))
    out = scored.groupBy("sample").agg((F.max("p") if combine == "intersect" else F.min("p")).alias("p"))
    return out.select(F.col("sample").alias(sample), "p", (F.col("p") < alpha).alias("outlier"))


def _t_ppf(p: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """``dist.t_ppf`` of arrays, for p of at least 1/2."""
    lo, hi = np.zeros(len(p)), np.ones(len(p))
    while len(p) and (short := dist.t_cdf(hi, dof) < p).any() and hi.max() < 1e300:
        hi = np.where(short, 2 * hi, hi)
    for _ in range(70):
        mid = (lo + hi) / 2
        under = dist.t_cdf(mid, dof) < p
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return (lo + hi) / 2


def gen_esd(df: DataFrame, var: str, sample: str, value: str, alpha: float = 0.05, share: float = 0.2) -> DataFrame:
    """(var, step, sample, r, lam, raw, outlier): generalised extreme Studentised deviates (Rosner, 1983).

    ``raw`` marks steps whose r exceeds lam; ``outlier`` marks all steps up to the last such one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = pdf["v"].to_numpy(float), pdf["sample"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        n, rows = len(x), []
        # What is left is a range of the ordered values: each step takes its lower or upper end, of equal values the least id first.
        low, high = np.argsort(x, kind="stable"), np.argsort(-x, kind="stable")
        z = x[low] - x.mean()
        s1, s2 = np.concatenate([[0.0], np.cumsum(z)]), np.concatenate([[0.0], np.cumsum(z * z)])
        steps = np.arange(1, int(math.floor(share * n + 0.5)) + 1)
        t = _t_ppf(1 - alpha / (2 * (n - steps + 1)), n - steps - 1.0)
        lam = (n - steps) * t / np.sqrt((n - steps - 1 + t * t) * (n - steps + 1))
        a, b = 0, n
        for i in steps.tolist():
            m = b - a
            if m <= 2 or z[a] == z[b - 1]:
                break
            mean = (s1[b] - s1[a]) / m
            sd = math.sqrt(max(s2[b] - s2[a] - m * mean * mean, 0.0) / (m - 1))
            if sd == 0:
                break
            down, up = mean - z[a], z[b - 1] - mean
            first, last = low[a], high[n - b]
            lower = first < last if abs(down - up) <= 1e-12 * (down + up) else down > up
            rows.append((i, ids[first if lower else last], max(down, up) / sd, lam[i - 1]))
            a, b = (a + 1, b) if lower else (a, b - 1)
        out = pd.DataFrame(rows, columns=["step", "sample", "r", "lam"])
        out.insert(0, "var", pdf["var"].iloc[0])
        out["raw"] = out["r"] > out["lam"]
        last = out.loc[out["raw"], "step"].max() if len(out) and out["raw"].any() else 0
        out["outlier"] = out["step"] <= last
        return out

    rows = df.select(F.col(var).alias("var"), F.col(sample).alias("sample"), finite(value).alias("v")).dropna(subset=["v"])
    kinds = [rows.schema[c].dataType.simpleString() for c in ("var", "sample")]
    out = rows.groupBy("var").applyInPandas(run, f"var {kinds[0]}, step int, sample {kinds[1]}, r double, lam double, raw boolean, outlier boolean")
    return out.withColumnsRenamed({"var": var, "sample": sample})


def expected_depth(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n leaves, rounded up."""
    return math.ceil(2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n) if n > 2 else 1.0


def isolation_forest(df: DataFrame, var: str, sample: str, value: str, trees: int = 100, depth: int = 8, threshold: float = 0.6, seed: int = 1) -> DataFrame:
    """(sample, height, score, outlier) by isolation trees with one random variable a level (after Liu et al., 2008).

    In every branch the cut is uniform between the branch's least and greatest value; a sample's height is the level at
    which it is first alone.  Cuts come from hashes of (tree, branch), so all trees grow at once, level by level.
    """
    names = [r[0] for r in df.select(var).distinct().orderBy(var).collect()]  # variables
    wide = df.groupBy(F.col(sample).alias("sample")).pivot(var, names).agg(F.first(finite(value)))
    wide = wide.toDF("sample", *[f"x{i}" for i in range(len(names))]).na.fill(0.0)
    n = wide.count()
    rows = wide.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).withColumns({"branch": F.lit(1).cast("bigint"), "height": F.lit(None).cast("int")})
    for level in range(1, depth + 1):
        which = hash_int("tree", F.lit(level), F.lit(seed)) % len(names)
        x = F.element_at(F.array(*[F.col(f"x{i}") for i in range(len(names))]), (which + 1).cast("int"))
        w = Window.partitionBy("tree", "branch")
        rows = rows.withColumn("x", x).withColumns({"lo": F.min("x").over(w), "hi": F.max("x").over(w)})
        cut = F.col("lo") + (F.col("hi") - F.col("lo")) * hash_int("tree", "branch", F.lit(level), F.lit(-seed)) / 4294967296.0
        rows = rows.withColumn("branch", F.col("branch") * 2 + (F.col("x") > cut).cast("int"))
        alone = F.count("*").over(Window.partitionBy("tree", "branch")) == 1
        rows = rows.withColumn("height", F.coalesce("height", F.when(alone, level))).drop("x", "lo", "hi")
    out = rows.groupBy("sample").agg(F.avg(F.coalesce("height", F.lit(depth))).alias("height"))
    out = out.withColumn("score", F.pow(F.lit(2.0), -F.col("height") / expected_depth(n)))
    return out.select(F.col("sample").alias(sample), "height", "score", (F.col("score") >= threshold).alias("outlier"))


def huber_location(df: DataFrame, by: Sequence[str], value: str, k: float = 1.5, rounds: int = 5) -> DataFrame:
    """(by..., location, scale): Huber's M-estimate after a fixed number of rounds from the median; scale 1.49 * MAD."""
    alpha = 2 * float(dist.normal_cdf(np.array([k]))[0]) - 1
    rows = df.select(*by, finite(value).alias("v")).dropna(subset=["v"])
    keys = list(by)
    at = held(medians(rows, keys, "v").withColumnRenamed("median", "m"))
    spread = medians(rows.join(at, keys).select(*keys, F.abs(F.col("v") - F.col("m")).alias("d")), keys, "d")
    at = held(at.join(spread.select(*keys, (1.49 * F.col("median")).alias("s")), keys))
    for _ in range(rounds):  # a pass each, against a row a group
        z = ratio(F.col("v") - F.col("m"), F.col("s"))
        step = rows.join(at, keys).groupBy(*keys).agg(F.max("m").alias("m0"), F.max("s").alias("s"), F.sum(F.least(F.greatest(z, F.lit(-k)), F.lit(k))).alias("sz"), F.count("*").alias("n"))
        at = held(step.select(*keys, (F.col("m0") + F.coalesce(F.col("s") * F.col("sz") / (F.col("n") * alpha), F.lit(0.0))).alias("m"), "s"))
    return at.select(*keys, F.col("m").alias("location"), F.col("s").alias("scale"))


def pca_outliers(df: DataFrame, id_col: str, array: str, kmax: int) -> DataFrame:
    """(id, k, mahalanobis, leverage, orthogonal) of each vector in the space of the first k components, k = 1..kmax."""
    n, mean, m = linalg.array_moments(df, array)
    val, vec = linalg.pca(m, kmax)

    def run(batches):
        for pdf in batches:
            keep = [v is not None and np.isfinite(np.asarray(v, dtype=float)).all() for v in pdf["x"]]
            pdf = pdf[keep]
            if not len(pdf):
                continue
            x = np.array([np.asarray(v, dtype=float) for v in pdf["x"]]) - mean
            score = x @ vec
            for k in range(1, len(val) + 1):
                h = (score[:, :k] ** 2 / np.maximum(val[:k], 1e-300)).sum(axis=1)
                yield pd.DataFrame({"id": pdf["id"], "k": k, "mahalanobis": np.sqrt(h * (n - 1)), "leverage": h, "orthogonal": np.sqrt(np.maximum((x * x).sum(axis=1) - (score[:, :k] ** 2).sum(axis=1), 0))})

    rows = df.select(F.col(id_col).alias("id"), F.col(array).alias("x"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, k int, mahalanobis double, leverage double, orthogonal double").withColumnRenamed("id", id_col)


def pca_kurtosis_filter(df: DataFrame, id_col: str, array: str, bound: float = 5.0, share: float = 0.5) -> DataFrame:
    """(id, dropped_at): samples dropped, in rounds, while the first component's scores have kurtosis of ``bound`` or more.

    Each round centres what is left and drops the sample that deviates most from the median score; at most ``share`` go.
    Components are fitted on the cluster; only scores of the first one, one number a sample, decide.
    """
    spark = df.sparkSession
    left, gone = df.select(id_col, array), []
    n = left.count()
    while len(gone) < share * n:
        _, mean, m = linalg.array_moments(left, array)
        _, vec = linalg.pca(m, 1)
        terms = F.aggregate(F.zip_with(F.col(array), F.array(*[F.struct(F.lit(float(a)).alias("w"), F.lit(float(b)).alias("m")) for a, b in zip(vec[:, 0], mean, strict=True)]), lambda x, y: (x.cast("double") - y["m"]) * y["w"]), F.lit(0.0), lambda a, b: a + b)
        scored = left.select(id_col, terms.alias("s"))
        stat = scored.agg((F.kurtosis("s") + 3).alias("k"), F.median("s").alias("m")).first()
        if stat.k is None or not stat.k >= bound:
            break
        worst = scored.orderBy(F.abs(F.col("s") - F.lit(stat.m)).desc(), id_col).limit(1).first()[0]
        gone.append(worst)
        left = left.filter(F.col(id_col) != F.lit(worst))
    return spark.createDataFrame([(x, i) for i, x in enumerate(gone, 1)], f"{id_col} {df.schema[id_col].dataType.simpleString()}, dropped_at int")
