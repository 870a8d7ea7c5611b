"""Models refitted on resamples: mixed models, adjusted differences, partial correlations, PLS split halves, three-way factors.

Replicates of table models are groups of one grouped map, or sums over blocks of subjects and how often each was drawn.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import finite
from .imputation import pls_fit
from .linalg import procrustes_match
from .multivariate import lda_directions, npls, rspm_array
from .resample import AT_ONCE, _over_draws, group_draws, indexed, resampled_sums


def _least(value: Callable[[float], float]) -> float:
    """The variance ratio of the least ``value``, over a grid, then by golden section."""
    grid = [0.0, *np.exp(np.linspace(-6, 5, 23))]
    at = [value(x) for x in grid]
    best = min(range(len(grid)), key=lambda i: at[i])
    lo, hi, g = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)], (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, d) if value(c) < value(d) else (c, hi)
    return (lo + hi) / 2


def fit_random_intercept(y: np.ndarray, x: np.ndarray, subject: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(coefficients, subject variance, residual variance) by REML over a grid of variance ratios, then golden section."""
    _, code = np.unique(subject, return_inverse=True)
    size = np.bincount(code)
    a = np.column_stack([x, y])
    sums = np.zeros((len(size), a.shape[1]))
    np.add.at(sums, code, a)
    whole, n, p = a.T @ a, len(y), x.shape[1]

    def profile(theta: float) -> tuple[float, np.ndarray, float]:
        m = whole - (sums * (theta / (1 + size * theta))[:, None]).T @ sums
        b = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
        rss = max(m[-1, -1] - b @ m[:-1, -1], 1e-300)
        return (n - p) * math.log(rss / (n - p)) + np.log1p(size * theta).sum() + np.linalg.slogdet(m[:-1, :-1])[1], b, rss / (n - p)

    theta = _least(lambda x: profile(x)[0])
    _, b, s2 = profile(theta)
    return b, theta * s2, s2


def subject_draws(df: DataFrame, subject: str, reps: int, seed: int = 1) -> DataFrame:
    """(rep, clone, ...): the rows of drawn subjects; every clone of a subject is a subject of its own."""
    ids = indexed(df.select(subject).distinct(), [subject]).withColumn("_g", F.lit(0))
    drawn = group_draws(ids, ["_g"], reps, seed).join(ids, ["_g", "i"]).select("rep", subject, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return drawn.join(df, subject).withColumn("clone", F.concat_ws(":", F.col(subject).cast("string"), F.col("copy").cast("string"))).drop("copy")


def mixed_bootstrap(df: DataFrame, y: str, xs: Sequence[str], subject: str, reps: int = 1000, seed: int = 1, worst: float = 500.0) -> DataFrame:
    """(rep, term, stat): fixed effects of the random-intercept model on resampled subjects.

    Replicates whose design has a condition number above ``worst`` are left out.
    """
    names = ["(intercept)", *xs]
    rows = df.select(F.col(subject).alias("s"), finite(y).alias("y"), *[finite(c).alias(f"x{i}") for i, c in enumerate(xs)]).dropna()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), *[pdf[f"x{i}"] for i in range(len(xs))]])
        if np.linalg.cond(x) > worst:
            return pd.DataFrame({"rep": [], "term": [], "stat": []})
        b, _, _ = fit_random_intercept(pdf["y"].to_numpy(), x, pdf["clone"].to_numpy())
        return pd.DataFrame({"rep": int(pdf["rep"].iloc[0]), "term": names, "stat": b})

    return subject_draws(rows, "s", reps, seed).groupBy("rep").applyInPandas(run, "rep int, term string, stat double")


def _sum_arrays(df: DataFrame) -> DataFrame:
    """(rep, v): sums of the binary arrays of doubles ``v`` of (rep, blk, v) by replicate, some blocks at a time and always in the same order."""

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        return pdf.iloc[:1].assign(v=[np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()])

    kind = "rep int, few int, blk int, v binary"
    some = df.select("rep", F.pmod(F.xxhash64("blk"), F.lit(16)).cast("int").alias("few"), "blk", "v").groupBy("rep", "few").applyInPandas(added, kind)
    return some.groupBy("rep").applyInPandas(added, kind).select("rep", "v")


def _time_intercepts(v: np.ndarray, t: int) -> tuple[np.ndarray, float, float]:
    """``fit_random_intercept`` with a mean for each of ``t`` times, from sums: Y and Y'Y by time, then of each number n of present cells
    of a subject (0 to t) the subjects and the upper triangle of products of [O S], presence and the sum of a subject's cells.
    """
    p = t + 1
    i, j = np.triu_indices(p)
    whole, classes = np.zeros((p, p)), v[2 * t :].reshape(p, 1 + len(i))
    size, products = np.arange(p, dtype=float), np.zeros((p, p, p))
    products[:, i, j] = products[:, j, i] = classes[:, 1:]
    seen = np.zeros(t)
    for n in range(1, p):
        seen += np.diagonal(products[n])[:t]  # presence is 0 or 1
    whole[:t, :t], whole[:t, t], whole[t, :t], whole[t, t] = np.diag(seen), v[:t], v[:t], v[t : 2 * t].sum()
    rows, used = seen.sum(), np.flatnonzero(seen > 0)
    at = np.append(used, t)
    whole, products = whole[np.ix_(at, at)], products[:, at][:, :, at]

    def profile(theta: float) -> tuple[float, np.ndarray, float]:
        m = whole - np.einsum("n,nij->ij", theta / (1 + size * theta), products)
        b = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
        rss = max(m[-1, -1] - b @ m[:-1, -1], 1e-300)
        free = max(rows - len(used), 1.0)
        return free * math.log(rss / free) + classes[:, 0] @ np.log1p(size * theta) + np.linalg.slogdet(m[:-1, :-1])[1], b, rss / free

    theta = _least(lambda x: profile(x)[0])
    _, b, s2 = profile(theta)
    out = np.full(t, np.nan)
    out[used] = b
    return out, theta * s2, s2


def mixed_bootstrap_impute(df: DataFrame, y: str, time: str, subject: str, reps: int = 1000, seed: int = 1, fills: int = 10) -> DataFrame:
    """(rep, time, mean, change): time means and changes from the first time on resampled subjects.

    Missing cells of a subject-by-time table are the mean of ``fills`` draws from the model with a mean for each time and a
    random intercept, given the subject's other values.  Replicates are sums over blocks of subjects and how often each was drawn; the residuals of
    a subject's copies are drawn as one.  The driver holds the fits: times + 2 numbers a replicate.
    """
    rows = df.select(F.col(subject).alias("s"), F.col(time).cast("double").alias("t"), finite(y).alias("y")).filter("s IS NOT NULL")
    times = sorted(r.t for r in rows.select("t").distinct().collect() if r.t is not None)  # the time points of the design
    t = len(times)
    upper = np.triu_indices(t + 1)
    cells = [F.avg(F.when(F.col("t") == F.lit(x), F.col("y"))) for x in times]
    wide = rows.groupBy("s").agg(F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in cells]).alias("x"))
    ids = indexed(wide, ["s"]).withColumn("_g", F.lit(0)).persist()

    def cells_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), t)
        return np.nan_to_num(x), np.isfinite(x)

    def sums(pdf: pd.DataFrame, drawn: np.ndarray, numbers: np.ndarray, _: tuple) -> dict[str, object]:
        x, seen = cells_of(pdf)
        w, n = drawn.astype(float), seen.sum(axis=1)
        o = np.column_stack([seen, x.sum(axis=1)])
        products = o[:, upper[0]] * o[:, upper[1]]
        out = np.zeros((len(w), t + 1, 1 + products.shape[1]))
        for k in np.unique(n):
            own = n == k
            out[:, k] = np.column_stack([w[:, own].sum(axis=1), w[:, own] @ products[own]])
        return {"rep": numbers, "blk": int(pdf["i"].min()), "v": [v.tobytes() for v in np.column_stack([w @ x, w @ (x * x), out.reshape(len(w), -1)])]}

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        b, vs, vr = _time_intercepts(np.frombuffer(pdf["v"].iloc[0]), t)
        return pd.DataFrame({"rep": [int(pdf["rep"].iloc[0])], "v": [np.append(b, [vs, vr]).tobytes()]})

    whole = _sum_arrays(_over_draws(ids, ["_g"], reps, seed, sums, ["i", "x"], "blk int, v binary"))
    fits = {r.rep: np.frombuffer(bytes(r.v)) for r in whole.groupBy("rep").applyInPandas(fitted, "rep int, v binary").collect()}  # times + 2 numbers a replicate

    def filled(pdf: pd.DataFrame, drawn: np.ndarray, numbers: np.ndarray, _: tuple) -> dict[str, object]:
        x, seen = cells_of(pdf)
        n, out = seen.sum(axis=1), []
        for rep, w in zip(numbers, drawn.astype(float), strict=True):
            b, (vs, vr) = fits[int(rep)][:t], fits[int(rep)][t:]
            shrunk = (x - np.where(seen, b, 0.0)).sum(axis=1) * vs / (n * vs + vr) if vr > 0 or vs > 0 else np.zeros(len(x))
            noise = np.random.default_rng([seed, int(rep), int(pdf["i"].min())]).normal(size=x.shape) * np.sqrt(w[:, None] * vr / fills)
            full = np.where(seen, w[:, None] * x, w[:, None] * (b + shrunk[:, None]) + noise)
            out.append(np.append(full.sum(axis=0), w.sum()).tobytes())
        return {"rep": numbers, "blk": int(pdf["i"].min()), "v": out}

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.frombuffer(pdf["v"].iloc[0])
        mean = v[:t] / v[t]
        return pd.DataFrame({"rep": int(pdf["rep"].iloc[0]), "time": times, "mean": mean, "change": mean - mean[0]})

    total = _sum_arrays(_over_draws(ids, ["_g"], reps, seed, filled, ["i", "x"], "blk int, v binary"))
    return total.groupBy("rep").applyInPandas(means, "rep int, time double, mean double, change double")


def table_bootstrap(df: DataFrame, columns: Sequence[str], order: Sequence[str], stat, names: Sequence[str], reps: int = 2000, seed: int = 1, strata: str | None = None) -> DataFrame:
    """(rep, term, stat) of ``stat(cross)`` on resampled rows of some numeric columns, resampled within ``strata`` if given.

    ``cross`` has a replicate's centred cross-products of the columns; they are summed up over draws, so no replicate is in one place.
    """
    names_v = [f"v{i}" for i in range(len(columns))]
    rows = df.select(*[finite(c).alias(v) for c, v in zip(columns, names_v, strict=True)], (F.col(strata) if strata else F.lit(0)).alias("g"), *[F.col(o).alias(f"o{k}") for k, o in enumerate(order)]).dropna().persist()
    about = rows.agg(*[F.avg(v) for v in names_v]).first()
    shifted = rows.select("g", *[f"o{k}" for k in range(len(order))], *[(F.col(v) - F.lit(m if m is not None else 0.0)).alias(v) for v, m in zip(names_v, about, strict=True)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    placed = indexed(shifted, [f"o{k}" for k in range(len(order))], ["g"]).select("g", "i", *names_v, *[(F.col(names_v[i]) * F.col(names_v[j])).alias(f"c{i}_{j}") for i, j in pairs])
    products = [f"c{i}_{j}" for i, j in pairs]
    sums = resampled_sums(placed, ["g"], [*names_v, *products], reps, seed).groupBy("rep").agg(F.sum("n").alias("n"), F.array(*[F.sum(v) for v in names_v]).alias("s"), F.array(*[F.sum(c) for c in products]).alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rep, n, s, c in zip(pdf["rep"], pdf["n"], pdf["s"], pdf["c"], strict=True):
                cross = np.zeros((len(columns), len(columns)))
                for (i, j), v in zip(pairs, c, strict=True):
                    cross[i, j] = cross[j, i] = v - s[i] * s[j] / n
                yield pd.DataFrame({"rep": int(rep), "term": list(names), "stat": np.asarray(stat(cross), dtype=float)})

    return sums.mapInPandas(run, "rep int, term string, stat double")


def _coef(cross: np.ndarray) -> np.ndarray:
    """Coefficients of the first column on the others; columns without rank get the least norm in units of their spread."""
    size = np.sqrt(np.maximum(np.diagonal(cross)[1:], 0.0))
    size = np.where(size > 0, size, 1.0)
    return np.linalg.lstsq(cross[1:, 1:] / np.outer(size, size), cross[1:, 0] / size, rcond=None)[0] / size


def reg_boot(df: DataFrame, y: str, xs: Sequence[str], order: Sequence[str], tried: str | None = None, reps: int = 2000, seed: int = 1) -> DataFrame:
    """(rep, term, stat): multiple-regression coefficients, or their changes when ``tried`` is added."""
    k = len(xs)
    stat = (lambda m: _coef(m)[:k] - _coef(m[: k + 1, : k + 1])) if tried else _coef
    return table_bootstrap(df, [y, *xs, *([tried] if tried else [])], order, stat, xs, reps, seed)


def _partial(cross: np.ndarray) -> float:
    b = np.column_stack([_coef(cross[np.ix_([i, *range(2, len(cross))], [i, *range(2, len(cross))])]) for i in (0, 1)]) if len(cross) > 2 else np.zeros((0, 2))
    r = cross[:2, :2] - cross[:2, 2:] @ b
    spread = r[0, 0] * r[1, 1]
    return float(r[0, 1] / math.sqrt(spread)) if spread > 0 else math.nan


#: Rows of a bucket, about, whose draws are made in one place.
BUCKET = 4096


def _drawn_sums(rows: DataFrame, order: Sequence[str], d: int, reps: int, seed: int) -> np.ndarray:
    """Replicates x (number of rows, sums of the ``d`` values, sums of their products, upper triangle by rows) of ``rows`` (order..., v), drawn with replacement.

    Rows are dealt to buckets by hash. The counts of buckets come down a tree of seeded binomials, for all replicates at once, and the draws within a bucket are made
    where its rows are, so no draws travel, and other partitions give the same. The driver holds a number a bucket and the sums.
    """
    i, j = np.triu_indices(d)
    total, seed = rows.count(), seed % 2**32
    buckets = max(1, -(-total // BUCKET))
    dealt = rows.withColumn("blk", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = np.zeros(buckets, dtype=np.int64)
    for r in dealt.groupBy("blk").agg(F.count("*").alias("n")).collect():  # a row for each BUCKET rows
        sizes[r.blk] = r.n
    upto = np.concatenate([[0], np.cumsum(sizes)])

    def counts(bucket: int) -> np.ndarray:
        lo, hi, left = 0, buckets, np.full(reps, total)
        while hi - lo > 1:
            mid, size = (lo + hi) // 2, int(upto[hi] - upto[lo])
            first = np.random.default_rng([seed, lo, hi, 0]).binomial(left, (upto[mid] - upto[lo]) / size if size else 0.0)
            lo, hi, left = (lo, mid, first) if bucket < mid else (mid, hi, left - first)
        return left

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, bucket = pdf.sort_values(list(order)), int(pdf["blk"].iloc[0])
        values, n = np.array(pdf["v"].tolist(), dtype=float), len(pdf)
        a, times = np.column_stack([np.ones(n), values, values[:, i] * values[:, j]]), counts(bucket)
        out = []
        for lo in range(0, reps, AT_ONCE):
            some = times[lo : lo + AT_ONCE]
            at = np.random.default_rng([seed, bucket, buckets, lo, 1]).integers(0, n, some.sum()) + np.repeat(np.arange(len(some)) * n, some)
            out.append(np.bincount(at, minlength=len(some) * n).reshape(-1, n).astype(float) @ a)
        return pd.DataFrame({"rep": [0], "blk": [bucket], "v": [np.concatenate(out).tobytes()]})

    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    parts = dealt.repartition(min(tasks, buckets), "blk").groupBy("blk").applyInPandas(drawn, "rep int, blk int, v binary")
    found = _sum_arrays(parts).collect()  # one array of sums
    return np.frombuffer(bytes(found[0].v)).reshape(reps, -1) if found else np.zeros((0, 1 + d + len(i)))


def pcorr_boot(df: DataFrame, y: str, x: str, controls: Sequence[str], order: Sequence[str], tried: str | None = None, reps: int = 2000, seed: int = 1) -> DataFrame:
    """(rep, term, stat): partial correlation of y and x given controls, or its change when ``tried`` is added to them."""
    columns, k = [y, x, *controls, *([tried] if tried else [])], 2 + len(controls)
    d, names, keys = len(columns), [f"v{i}" for i in range(len(columns))], [f"o{i}" for i in range(len(order))]
    rows = df.select(*[F.col(o).alias(key) for o, key in zip(order, keys, strict=True)], *[finite(c).alias(v) for c, v in zip(columns, names, strict=True)]).dropna().persist()
    about = rows.agg(*[F.avg(v) for v in names]).first()
    shifted = rows.select(*keys, F.array(*[F.col(v) - F.lit(m if m is not None else 0.0) for v, m in zip(names, about, strict=True)]).alias("v"))
    i, j = np.triu_indices(d)
    out = []
    for rep, v in enumerate(_drawn_sums(shifted, keys, d, reps, seed), 1):
        cross = np.zeros((d, d))
        cross[i, j] = cross[j, i] = v[1 + d :] - v[1 + i] * v[1 + j] / v[0]
        stat = _partial(cross) - _partial(cross[:k, :k]) if tried else _partial(cross)
        out.append((rep, "partial", stat if math.isfinite(stat) else None))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "rep int, term string, stat double")


def adjusted_diff(df: DataFrame, y: str, label: str, covariates: Sequence[str], order: Sequence[str], reps: int = 2000, seed: int = 1) -> DataFrame:
    """(rep, term, stat): class difference adjusted for covariates, each class resampled apart."""
    return table_bootstrap(df.withColumn("_l", F.col(label).cast("double")), [y, "_l", *covariates], order, lambda m: _coef(m)[:1], ["difference"], reps, seed, strata=label)


def pls_splithalf(x: np.ndarray, y: np.ndarray, ks: Sequence[int], splits: int = 50, seed: int = 1) -> pd.DataFrame:
    """(k, r, p, d): PLS of y on the first k principal components of x over random halves.

    r is the reproducibility of the first salience map, p the correlation of its scores with y on the other half; medians.
    """
    x, y = x - x.mean(axis=0), (y - y.mean(axis=0)).reshape(len(y), -1)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    rng, rows = np.random.default_rng(seed), []
    plans = [rng.permutation(len(x)) for _ in range(splits)]
    for k in ks:
        t, out = x @ vt[:k].T, []
        ref = np.linalg.svd(t.T @ y, full_matrices=False)[0][:, :1]
        for order in plans:
            halves = (order[: len(order) // 2], order[len(order) // 2 :])
            w = []
            for h in halves:
                u = np.linalg.svd((t[h] - t[h].mean(axis=0)).T @ (y[h] - y[h].mean(axis=0)), full_matrices=False)[0][:, :1]
                w.append(u[:, 0] * (1 if u[:, 0] @ ref[:, 0] >= 0 else -1))
            r, _ = rspm_array(vt[:k].T @ w[0], vt[:k].T @ w[1])
            p = np.mean([abs(np.corrcoef(t[o] @ v, y[o] @ np.linalg.lstsq(y[h], t[h] @ v, rcond=None)[0])[0, 1]) for v, h, o in zip(w, halves, halves[::-1], strict=True)])
            out.append((r, p))
        r, p = np.nanmedian(out, axis=0)
        rows.append((int(k), float(r), float(p), math.hypot(1 - r, 1 - p)))
    return pd.DataFrame(rows, columns=["k", "r", "p", "d"])


def pls_predict(x: np.ndarray, y: np.ndarray, k: int = 2, splits: int = 50, seed: int = 1) -> pd.DataFrame:
    """(split, r_test, r2_test, accuracy) of PLS trained on nine tenths; accuracy where y is 0/1."""
    rng, rows, binary = np.random.default_rng(seed), [], set(np.unique(y)) <= {0, 1}
    for s in range(splits):
        order = rng.permutation(len(y))
        test, train = order[: max(2, len(y) // 10)], order[max(2, len(y) // 10) :]
        f = pls_fit(x[train], y[train].reshape(-1, 1).astype(float), k)
        z = np.array([f(v)[0] for v in x[test]])
        tss = float(((y[test] - y[train].mean()) ** 2).sum())
        r = float(np.corrcoef(z, y[test])[0, 1]) if len(test) > 2 and z.std() > 0 and y[test].std() > 0 else math.nan
        rows.append((s, r, 1 - float(((y[test] - z) ** 2).sum()) / tss if tss > 0 else math.nan, float(((z > 0.5) == (y[test] == 1)).mean()) if binary else math.nan))
    return pd.DataFrame(rows, columns=["split", "r_test", "r2_test", "accuracy"])


def npls_bootstrap(x: np.ndarray, y: np.ndarray, factors: int, subject: np.ndarray, boots: int = 500, seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bootstrap ratios of mode 1, of mode 2) of each tri-linear factor, resampling subjects with all their rows."""
    full, members, rng = npls(x, y, factors), np.unique(subject), np.random.default_rng(seed)
    draws = []
    for _ in range(boots):
        rows = np.concatenate([np.flatnonzero(subject == s) for s in rng.choice(members, len(members))])
        if y[rows].std() > 0:
            got = npls(x[rows], y[rows], factors)
            index, _ = procrustes_match(np.array([np.outer(a, b).ravel() for a, b, _ in full]).T, np.array([np.outer(a, b).ravel() for a, b, _ in got]).T)
            draws.append([(got[i][0] * np.sign(got[i][0] @ full[f][0] or 1), got[i][1] * np.sign(got[i][1] @ full[f][1] or 1)) for f, i in enumerate(index)])
    return [tuple(full[f][m] / np.maximum(np.std([d[f][m] for d in draws], axis=0, ddof=1), 1e-300) for m in (0, 1)) for f in range(factors)]


def matfac3(x: np.ndarray, rank: int, lam: float = 1e-3, rounds: int = 200, tries: int = 3, seed: int = 1, tol: float = 1e-8) -> tuple[np.ndarray, list[np.ndarray]]:
    """(filled, factors of the three modes) of an incomplete three-way array by regularised alternating least squares about additive means."""
    seen = np.isfinite(x)
    mu = np.nanmean(x)
    effects = [np.nan_to_num(np.nanmean(x - mu, axis=tuple(m for m in range(3) if m != k), keepdims=True)) for k in range(3)]
    base = mu + sum(effects)
    if rank == 0:
        return np.where(seen, x, base), []
    r, best = np.where(seen, x - base, 0.0), None
    for t in range(tries):
        rng = np.random.default_rng(seed + t)
        f, old = [rng.normal(size=(n, rank)) for n in x.shape], math.inf
        for _ in range(rounds):
            for m in range(3):
                a, b = [f[k] for k in range(3) if k != m]
                kr = np.einsum("ir,jr->ijr", a, b).reshape(-1, rank)
                rows, mask = np.moveaxis(r, m, 0).reshape(x.shape[m], -1), np.moveaxis(seen, m, 0).reshape(x.shape[m], -1)
                f[m] = np.array([np.linalg.solve(kr[w].T @ kr[w] + lam * np.eye(rank), kr[w].T @ v[w]) for v, w in zip(rows, mask, strict=True)])
            err = float(((r - np.einsum("ir,jr,kr->ijk", *f))[seen] ** 2).sum())
            if old - err < tol * max(err, 1e-12):
                break
            old = err
        if best is None or err < best[0]:
            best = err, f
    return np.where(seen, x, base + np.einsum("ir,jr,kr->ijk", *best[1])), best[1]


def group_lda_map(voxels: DataFrame, mask: DataFrame, onsets: DataFrame, share: float = 0.5, splits: int = 50, seed: int = 1) -> DataFrame:
    """(x, y, z, value): the discriminant map of two task classes of a group of subjects, mean z score over split halves of subjects.

    ``voxels`` has (subject, x, y, z, t, value), ``mask`` (x, y, z), ``onsets`` (subject, t, label) with labels -1, 0, 1, where 0 is left
    out. Voxels outside the mask and times without a label never leave the scan's tasks; each subject's mean is removed.
    """
    spark = voxels.sparkSession
    rows = voxels.join(mask.select("x", "y", "z").distinct(), ["x", "y", "z"], "left_semi").join(F.broadcast(onsets.filter("label <> 0")), ["subject", "t"])
    rows = rows.select("subject", "t", "label", "x", "y", "z", finite("value").alias("value"))
    pdf = rows.toPandas()  # masked voxels of labelled times, the model's own input
    wide = pdf.pivot_table(index=["subject", "t", "label"], columns=["x", "y", "z"], values="value").fillna(0.0)
    subject, y = wide.index.get_level_values("subject").to_numpy(), (wide.index.get_level_values("label").to_numpy() == 1).astype(int)
    x = wide.to_numpy(float)
    for s in np.unique(subject):
        x[subject == s] -= x[subject == s].mean(axis=0)
    kmax = max(1, min(int(share * len(x) / 2), x.shape[1], len(x) // 2 - 2))
    ref, rng, members = lda_directions(x, y, kmax), np.random.default_rng(seed), np.unique(subject)
    total, count = np.zeros((kmax, x.shape[1])), np.zeros(kmax)
    for _ in range(splits):
        order = rng.permutation(members)
        maps = [lda_directions(x[at], y[at], kmax) for half in (order[: len(order) // 2], order[len(order) // 2 :]) if len(np.unique(y[at := np.isin(subject, half)])) == 2]
        if len(maps) == 2:
            for k in range(min(len(ref), *map(len, maps))):
                r, z = rspm_array(*[m[k] * (1 if m[k] @ ref[k] >= 0 else -1) for m in maps])
                total[k] += z
                count[k] += r > -1
    k = int(np.argmax(count))
    return spark.createDataFrame([(int(a), int(b), int(c), float(v)) for (a, b, c), v in zip(wide.columns, total[k] / max(count[k], 1), strict=True)], "x int, y int, z int, value double")
