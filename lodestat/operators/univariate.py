"""Univariate tests and regressions, each over many variables at once where a grouping is given."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.stats import finite, ratio, tied_rank, with_totals
from . import linalg


def fdr(df: DataFrame, p: str, by: Sequence[str] = (), q: float = 0.05, dependent: bool = False, compat: bool = False) -> DataFrame:
    """``df`` with ``crit``, the critical p of its family, and ``mask``: 1 rejected, 0 not, -1 where p is missing.

    Benjamini-Hochberg, or Benjamini-Yekutieli if ``dependent``: the greatest rank whose p is at most rank * q / (n * c).
    With ``compat`` the critical rank is instead the number of ranks that pass.
    """
    keys = list(by) or [F.lit(0)]
    all_ = Window.partitionBy(*keys)
    rows = df.withColumn("_p", finite(p))
    good = F.col("_p").isNotNull()
    n = F.sum(good.cast("int")).over(all_)
    c = F.ln(F.col("_n").cast("double")) + 0.5772156649015329 + 1 / F.col("_n") if dependent else F.lit(1.0)
    rows = rows.withColumns({"_n": n, "_r": F.when(good, F.row_number().over(all_.orderBy(F.col("_p").asc_nulls_last())))})
    passing = good & (F.col("_p") <= F.col("_r") * q / (F.col("_n") * c))
    rows = rows.withColumn("_pass", passing)
    rank = F.sum(F.col("_pass").cast("int")).over(all_) if compat else F.max(F.when(F.col("_pass"), F.col("_r"))).over(all_)
    rows = rows.withColumn("_top", rank)
    crit = F.max(F.when(F.col("_r") == F.col("_top"), F.col("_p"))).over(all_)
    rows = rows.withColumn("crit", crit)
    mask = F.when(~good, -1).when(F.col("_p") <= F.col("crit"), 1).otherwise(0)
    return rows.withColumn("mask", mask).drop("_p", "_n", "_r", "_pass", "_top")


def fdr_one_family(df: DataFrame, p: str, q: float = 0.05, dependent: bool = False) -> DataFrame:
    """``fdr`` of one family of any size, without sorting it.

    The critical rank is the greatest k with k = #(p <= k * q / (n * c)); from k = n down, counting again gets there in a
    few passes, each a sum over the cluster.
    """
    rows = df.withColumn("_p", finite(p))
    n = k = rows.filter("_p IS NOT NULL").count()
    c = math.log(n) + 0.5772156649015329 + 1 / n if dependent and n else 1.0
    crit = None
    while k:
        r = rows.filter(F.col("_p") <= k * q / (n * c)).agg(F.count("*").alias("k"), F.max("_p").alias("top")).first()
        if r.k == k:
            crit = r.top
            break
        k = r.k
    limit = F.lit(crit).cast("double")
    mask = F.when(F.col("_p").isNull(), -1).when(F.col("_p") <= limit, 1).otherwise(0)
    return rows.withColumns({"crit": limit, "mask": mask}).drop("_p")


def fdr_from(df: DataFrame, stat: str, kind: str, dof: str | None = None, tails: int = 2, **options: object) -> DataFrame:
    """``fdr`` of p values, t statistics (with ``dof``) or z statistics."""
    if kind == "p":
        p = F.col(stat)
    else:
        p = dist.t_two_sided(finite(stat), F.col(dof)) if kind == "t" else dist.normal_two_sided(finite(stat))
        if tails == 1:
            p = F.when(F.col(stat) > 0, p / 2).otherwise(1 - p / 2)
    return fdr(df.withColumn("p", p), "p", **options)  # type: ignore[arg-type]


def friedman_ranks(df: DataFrame, treatment: str, block: str, value: str) -> DataFrame:
    """(treatment, mean_rank, n_blocks, n_treatments) over blocks that have every treatment once."""
    count = df.select(treatment).distinct().count()
    whole = Window.partitionBy(block)
    rows = df.filter(finite(value).isNotNull()).withColumn("_c", F.count("*").over(whole)).filter(F.col("_c") == count)
    ranked = rows.withColumn("_r", tied_rank(value, [block]))
    return ranked.groupBy(treatment).agg(F.avg("_r").alias("mean_rank"), F.count("*").alias("n_blocks"), F.lit(count).cast("bigint").alias("n_treatments"))


def friedman(df: DataFrame, treatment: str, block: str, value: str, alpha: float = 0.05) -> DataFrame:
    """One row: q, dof, p and the critical difference of mean ranks."""
    r = friedman_ranks(df, treatment, block, value)
    s, n = F.col("n_treatments"), F.col("n_blocks")
    q = r.groupBy(n, s).agg(F.sum((F.col("mean_rank") - (s + 1) / 2) ** 2).alias("ss"))
    out = q.select(n, s, (12 * n / (s * (s + 1)) * F.col("ss")).alias("q"))

    @F.pandas_udf("double")
    def cd(blocks: pd.Series, treats: pd.Series) -> pd.Series:
        return pd.Series([dist.t_ppf(1 - alpha / (k * (k - 1)), 1e6) * math.sqrt(k * (k + 1) / (6 * b)) for b, k in zip(blocks, treats, strict=True)])

    return out.select(n, s, "q", dist.chi2_tail(F.col("q"), s - 1).alias("p"), cd(n, s).alias("critical_difference"))


def quade(df: DataFrame, treatment: str, block: str, value: str) -> DataFrame:
    """One row: Quade's W, its degrees of freedom and p; blocks are weighted by the rank of their range."""
    count = df.select(treatment).distinct().count()
    whole = Window.partitionBy(block)
    rows = df.filter(finite(value).isNotNull()).withColumns({"_c": F.count("*").over(whole), "_range": F.max(value).over(whole) - F.min(value).over(whole)}).filter(F.col("_c") == count)
    ranges = rows.groupBy(block).agg(F.max("_range").alias("_range")).withColumn("_one", F.lit(0)).withColumn("_q", tied_rank("_range", ["_one"])).select(block, "_q")
    s = rows.withColumn("_r", tied_rank(value, [block])).join(ranges, block).withColumn("_s", F.col("_q") * (F.col("_r") - (count + 1) / 2))
    a = s.groupBy(treatment).agg(F.sum("_s").alias("sj"), F.sum(F.col("_s") ** 2).alias("ss"), F.count("*").alias("b"))
    tot = a.agg(F.sum("ss").alias("a"), (F.sum(F.col("sj") ** 2) / F.max("b")).alias("b_stat"), F.max("b").alias("n_blocks"))
    w = ratio((F.col("n_blocks") - 1) * F.col("b_stat"), F.col("a") - F.col("b_stat"))
    out = tot.select("n_blocks", F.lit(count - 1).cast("bigint").alias("d1"), ((F.col("n_blocks") - 1) * (count - 1)).alias("d2"), w.alias("w"))
    return out.withColumn("p", dist.f_tail(F.col("w"), F.col("d1"), F.col("d2")))


def anova_rm(df: DataFrame, value: str, time: str, subject: str, group: str | None = None) -> DataFrame:
    """Mixed analysis of variance with time within subjects and an optional group between: (effect, ss, df, ms, f, p).

    Every subject has one value at each time.
    """
    rows = df.select(F.col(subject).alias("s"), F.col(time).alias("t"), (F.col(group) if group else F.lit(0)).alias("g"), finite(value).alias("y"))
    means = with_totals(rows, {"m": F.avg("y")}).withColumns({
        "mg": F.avg("y").over(Window.partitionBy("g")), "mt": F.avg("y").over(Window.partitionBy("t")),
        "mgt": F.avg("y").over(Window.partitionBy("g", "t")), "ms": F.avg("y").over(Window.partitionBy("s"))})
    sums = means.agg(
        F.sum(F.expr("pow(mg - m, 2)")).alias("G"), F.sum(F.expr("pow(ms - mg, 2)")).alias("S(G)"), F.sum(F.expr("pow(mt - m, 2)")).alias("T"),
        F.sum(F.expr("pow(mgt - mg - mt + m, 2)")).alias("GxT"), F.sum(F.expr("pow(y - mgt - ms + mg, 2)")).alias("R"),
        F.count_distinct("g").alias("ng"), F.count_distinct("t").alias("nt"), F.count_distinct("s").alias("ns"))
    degrees = {"G": "ng - 1", "S(G)": "ns - ng", "T": "nt - 1", "GxT": "(ng - 1) * (nt - 1)", "R": "(ns - ng) * (nt - 1)"}
    parts = F.explode(F.array(*[F.struct(F.lit(e).alias("effect"), F.col(f"`{e}`").alias("ss"), F.expr(d).cast("double").alias("df")) for e, d in degrees.items()])).alias("x")
    msr = ratio(F.col("R"), F.expr(degrees["R"]).cast("double"))
    mss = ratio(F.col("`S(G)`"), F.expr(degrees["S(G)"]).cast("double"))
    out = sums.select(msr.alias("msr"), mss.alias("mss"), F.expr(degrees["R"]).cast("double").alias("dfr"), F.expr(degrees["S(G)"]).cast("double").alias("dfs"), parts)
    out = out.select(F.col("x.effect").alias("effect"), F.col("x.ss").alias("ss"), F.col("x.df").alias("df"), ratio(F.col("x.ss"), F.col("x.df")).alias("ms"), "msr", "mss", "dfr", "dfs")
    f = F.when(F.col("effect") == "G", ratio(F.col("ms"), F.col("mss"))).when(F.col("effect").isin("T", "GxT"), ratio(F.col("ms"), F.col("msr")))
    below = F.when(F.col("effect") == "G", F.col("dfs")).otherwise(F.col("dfr"))
    out = out.withColumn("f", f).withColumn("p", dist.f_tail(F.col("f"), F.col("df"), below))
    return (out if group else out.filter(F.col("effect").isin("S(G)", "T", "R"))).select("effect", "ss", "df", "ms", "f", "p")


def gaussian_info(df: DataFrame, a: str, b: str, d: str) -> DataFrame:
    """One row of Gaussian information measures of three variables, in nats, from their correlations."""
    rows = df.select(finite(a).alias("a"), finite(b).alias("b"), finite(d).alias("d")).dropna()
    r = rows.agg(F.corr("a", "b").alias("ab"), F.corr("a", "d").alias("ad"), F.corr("b", "d").alias("bd"))
    det = "(1 - ab * ab - ad * ad - bd * bd + 2 * ab * ad * bd)"
    return r.select(
        "ab", "ad", "bd", *[F.expr(f"-0.5 * ln(1 - {x} * {x})").alias(f"mi_{x}") for x in ("ab", "ad", "bd")],
        F.expr(f"-0.5 * ln({det} / ((1 - ad * ad) * (1 - bd * bd)))").alias("cmi_ab_d"),
        F.expr(f"-0.5 * ln(1 - ab * ab) + 0.5 * ln({det} / ((1 - ad * ad) * (1 - bd * bd)))").alias("interaction"),
        F.expr(f"-0.5 * ln({det})").alias("total_correlation"),
        F.expr(f"1.5 * ln(2 * pi() * exp(1.0)) + 0.5 * ln({det})").alias("joint_entropy"))


def f_map(df: DataFrame, y: str, x: str, by: Sequence[str], compat: bool = False) -> DataFrame:
    """(by..., n, r2, f, p): F of the simple regression of y on x in each group; null where nothing is left over."""
    r = df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_r2(y, x).alias("r2"))
    dof = F.col("n") if compat else F.col("n") - 2
    r = r.withColumn("f", ratio(F.col("r2") * dof, 1 - F.col("r2")))
    return r.withColumn("p", dist.f_tail(F.col("f"), F.lit(1.0), dof))


def f_map_many(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., n, r2, f, p) of the regression of y on several regressors, from each group's cross-products."""
    g = linalg.moments(df, [y, *xs], by)
    k = len(xs)

    def fit(m: np.ndarray, mean: np.ndarray, n: int) -> tuple[float, float]:
        b = np.linalg.lstsq(m[1:, 1:], m[1:, 0], rcond=None)[0]
        r2 = float(b @ m[1:, 0] / m[0, 0]) if m[0, 0] > 0 else math.nan
        return r2, r2 / (1 - r2) * (n - k - 1) / k if r2 < 1 else math.nan

    out = linalg.map_moments(g, by, fit, ["r2", "f"])
    return out.withColumn("p", dist.f_tail(F.col("f"), F.lit(float(k)), F.col("n") - k - 1))


def cooks_distance(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``leverage``, ``cook`` and ``flagged`` (cook > 4 / n) for the line of y on x in each group."""
    fits = {"_n": F.regr_count(y, x), "_mx": F.avg(x), "_sxx": F.regr_sxx(y, x), "_b": F.regr_slope(y, x), "_a": F.regr_intercept(y, x), "_syy": F.regr_syy(y, x), "_sxy": F.regr_sxy(y, x)}
    rows = df.withColumns({n: f.over(Window.partitionBy(*by)) for n, f in fits.items()}) if by else with_totals(df, fits)
    h = 1 / F.col("_n") + ratio((F.col(x) - F.col("_mx")) ** 2, F.col("_sxx"))
    mse = ratio(F.col("_syy") - ratio(F.col("_sxy") ** 2, F.col("_sxx")), F.col("_n") - 2)
    e = F.col(y) - F.col("_a") - F.col("_b") * F.col(x)
    rows = rows.withColumn("leverage", h).withColumn("cook", ratio(e * e * F.col("leverage"), 2 * mse * (1 - F.col("leverage")) ** 2))
    return rows.withColumn("flagged", F.col("cook") > 4 / F.col("_n")).drop("_n", "_mx", "_sxx", "_b", "_a", "_syy", "_sxy")


def cooks_distance_poly(df: DataFrame, x: str, y: str, order: int, by: str) -> DataFrame:
    """(by, x, y, cook, flagged) for a polynomial of any order, one grouped map a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.vander(pdf[x].to_numpy(float), order + 1)
        q, _ = np.linalg.qr(a)
        h = (q * q).sum(axis=1)
        e = pdf[y].to_numpy(float) - q @ (q.T @ pdf[y].to_numpy(float))
        mse = e @ e / max(len(e) - order - 1, 1)
        cook = e * e * h / ((order + 1) * mse * (1 - h) ** 2)
        return pd.DataFrame({by: pdf[by], x: pdf[x], y: pdf[y], "cook": cook, "flagged": cook > 4 / len(e)})

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, F.col(x).cast("double"), F.col(y).cast("double")).dropna().groupBy(by).applyInPandas(run, f"{by} {kind}, {x} double, {y} double, cook double, flagged boolean")


def regression(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """(term, b, se, t, p) of the least-squares regression with an intercept, from cross-products."""
    spark = df.sparkSession
    n, mean, m = linalg.collect_moments(df, [y, *xs])
    b = np.linalg.solve(m[1:, 1:], m[1:, 0])
    dof = n - len(xs) - 1
    s2 = (m[0, 0] - b @ m[1:, 0]) / dof
    inv = np.linalg.inv(m[1:, 1:])
    se = np.sqrt(s2 * np.array([1 / n + mean[1:] @ inv @ mean[1:], *np.diag(inv)]))
    est = np.array([mean[0] - b @ mean[1:], *b])
    p = 2 * dist.t_cdf(-np.abs(est / se), np.full(len(est), float(dof)))
    return spark.createDataFrame([(t, float(e), float(s), float(e / s), float(v)) for t, e, s, v in zip(["(intercept)", *xs], est, se, p, strict=True)], "term string, b double, se double, t double, p double")


def partial_corr(df: DataFrame, x: str, y: str, controls: Sequence[str]) -> DataFrame:
    """One row (r): correlation of x and y given the controls."""
    _, _, m = linalg.collect_moments(df, [x, y, *controls])
    inv = np.linalg.inv(m)
    return df.sparkSession.createDataFrame([(float(-inv[0, 1] / math.sqrt(inv[0, 0] * inv[1, 1])),)], "r double")


def sensitivity(df: DataFrame, y: str, fixed: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """(term, mean, sd): unit-norm coefficients of the fixed regressors over every subset of the optional ones."""
    _, _, m = linalg.collect_moments(df, [y, *fixed, *optional], centered=False)
    d = np.sqrt(np.diag(m))
    m = m / np.outer(d, d)
    k, rows = len(fixed), []
    for size in range(len(optional) + 1):
        for extra in itertools.combinations(range(k + 1, k + 1 + len(optional)), size):
            at = [*range(1, k + 1), *extra]
            rows.append(np.linalg.solve(m[np.ix_(at, at)], m[at, 0])[:k])
    a = np.array(rows)
    return df.sparkSession.createDataFrame([(t, float(a[:, i].mean()), float(a[:, i].std(ddof=1)) if len(a) > 1 else None) for i, t in enumerate(fixed)], "term string, mean double, sd double")


def variance_partition(df: DataFrame, y: str, xs: Sequence[str], corrected: bool = True) -> DataFrame:
    """(term, beta, r, pratt, relative_weight, averaged_beta, inclusion) of standardised predictors.

    Relative weights follow Johnson (2000); averages are over all subsets by Akaike weights, corrected for small samples if asked.
    """
    n, _, m = linalg.collect_moments(df, [y, *xs])
    d = np.sqrt(np.diag(m))
    c = m / np.outer(d, d)
    rxx, rxy, k = c[1:, 1:], c[1:, 0], len(xs)
    beta = np.linalg.solve(rxx, rxy)
    val, vec = np.linalg.eigh(rxx)
    root = vec @ np.diag(np.sqrt(np.maximum(val, 0))) @ vec.T
    weight = (root**2) @ (np.linalg.solve(root, rxy) ** 2)
    scores, betas, used = [], [], []
    for mask in range(1 << k):
        at = [i for i in range(k) if mask >> i & 1]
        b = np.linalg.solve(rxx[np.ix_(at, at)], rxy[at]) if at else np.zeros(0)
        rss = m[0, 0] * (1 - (b @ rxy[at] if at else 0.0))
        p = len(at) + 2
        scores.append(n * math.log(rss / n) + 2 * p + (2 * p * (p + 1) / (n - p - 1) if corrected else 0))
        full = np.zeros(k)
        full[at] = b
        betas.append(full)
        used.append([mask >> i & 1 for i in range(k)])
    w = np.exp(-0.5 * (np.array(scores) - min(scores)))
    w /= w.sum()
    avg, inc = w @ np.array(betas), w @ np.array(used)
    rows = [(t, float(beta[i]), float(rxy[i]), float(beta[i] * rxy[i]), float(weight[i]), float(avg[i]), float(inc[i])) for i, t in enumerate(xs)]
    return df.sparkSession.createDataFrame(rows, "term string, beta double, r double, pratt double, relative_weight double, averaged_beta double, inclusion double")


def random_intercept(df: DataFrame, y: str, xs: Sequence[str], subject: str) -> DataFrame:
    """(term, b, se) of the linear mixed model with a random intercept for each subject, by REML; variance rows follow.

    Subjects are reduced to their sums first, so that the fit itself sees one small row of cross-products a subject.
    """
    names = [y, *xs]
    p = len(xs) + 1
    rows = df.select(F.col(subject).alias("s"), *[finite(c).alias(f"v{i}") for i, c in enumerate(names)]).dropna()
    sums = rows.groupBy("s").agg(F.count("*").alias("n"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(p)])
    total = rows.agg(F.count("*").alias("n"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(p)], *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    shapes = sums.groupBy("n").agg(F.count("*").alias("c"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"b{i}_{j}") for i in range(p) for j in range(i, p)], *[F.sum(f"s{i}").alias(f"t{i}") for i in range(p)]).collect()  # one row for each subject size
    order = [1, *range(2, p), 0]

    def cross(get, one: float, first) -> np.ndarray:  # rows: intercept, xs, y
        m = np.zeros((p + 1, p + 1))
        m[0, 0] = one
        for a, i in enumerate(order, 1):
            m[0, a] = m[a, 0] = first(i)
            for b, j in enumerate(order, 1):
                m[a, b] = get(min(i, j), max(i, j))
        return m

    order = [*range(1, p), 0]
    whole = cross(lambda i, j: total[f"q{i}_{j}"], total["n"], lambda i: total[f"s{i}"])
    between = [(r.n, r.c, cross(lambda i, j, r=r: r[f"b{i}_{j}"], r.n * r.n * r.c, lambda i, r=r: r.n * r[f"t{i}"])) for r in shapes]
    n = total["n"]

    def profile(theta: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        m, logdet = whole.copy(), 0.0
        for size, count, b in between:
            m -= theta / (1 + size * theta) * b
            logdet += count * math.log1p(size * theta)
        a, c = m[:-1, :-1], m[:-1, -1]
        b = np.linalg.solve(a, c)
        rss = max(m[-1, -1] - b @ c, 1e-300)
        return (n - p) * math.log(rss / (n - p)) + logdet + np.linalg.slogdet(a)[1], b, a, rss / (n - p)

    grid = [0.0, *np.exp(np.linspace(-8, 6, 57))]
    best = min(range(len(grid)), key=lambda i: profile(grid[i])[0])
    lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    g = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if profile(a)[0] < profile(b)[0] else (a, hi)
    theta = (lo + hi) / 2
    _, b, a, s2 = profile(theta)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(a)))
    rows_ = [(t, float(x), float(s)) for t, x, s in zip(["(intercept)", *xs], b, se, strict=True)]
    return df.sparkSession.createDataFrame([*rows_, ("var(subject)", float(theta * s2), None), ("var(residual)", float(s2), None)], "term string, b double, se double")


def change_from_baseline(df: DataFrame, subject: str, time: str, value: str, group: str) -> DataFrame:
    """(time, n0, n1, difference): mean change from a subject's first time, of group 1 less group 0."""
    w = Window.partitionBy(subject).orderBy(time)
    rows = df.withColumn("_d", F.col(value) - F.first_value(value).over(w)).withColumn("_k", F.row_number().over(w)).filter("_k > 1")
    mean = lambda g: F.avg(F.when(F.col(group) == g, F.col("_d")))
    size = lambda g: F.count(F.when(F.col(group) == g, F.col("_d")))
    return rows.groupBy(time).agg(size(0).alias("n0"), size(1).alias("n1"), (mean(1) - mean(0)).alias("difference"))
