"""Two-class classifiers along regularisation paths, and split-half pipelines around them.

A fit takes (x, y) with y in {0, 1} and gives maps: one weight vector, offset and setting a row.  Cross-validation runs as one
grouped map for each replicate of a split plan; class moments and scoring are plain DataFrame operators.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .multivariate import rspm_array

Path = list[tuple[float, np.ndarray, float]]  # (setting, weights, offset); class 1 where x @ weights > offset


def gnb(train: DataFrame, test: DataFrame, label: str, linear: bool = False) -> DataFrame:
    """(sample_id, label, predicted) by Gaussian naive Bayes over (sample_id, label, var_id, value) frames.

    ``linear`` takes the nearer class mean by squared error, a tie counting for class 1; otherwise the class spreads count too.
    """
    w = train.groupBy("var_id").agg(*[f(F.when(F.col(label) == c, F.col("value"))).alias(f"{n}{c}") for n, f in (("m", F.avg), ("s", F.stddev_samp)) for c in (0, 1)])
    x = test.join(F.broadcast(w), "var_id")  # one row a variable
    if linear:
        d = F.sum((F.col("value") - F.col("m0")) ** 2 - (F.col("value") - F.col("m1")) ** 2)
        return x.groupBy("sample_id", label).agg((d >= 0).cast("int").alias("predicted"))
    part = lambda c: -F.ln(F.col(f"s{c}")) - (F.col("value") - F.col(f"m{c}")) ** 2 / (2 * F.col(f"s{c}") ** 2)
    return x.groupBy("sample_id", label).agg((F.sum(part(1) - part(0)) > 0).cast("int").alias("predicted"))


def accuracy(df: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def discriminant_pair(train: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """One row of a closed-form two-variable linear discriminant: w_a, w_b and the midpoint."""
    g = train.groupBy(F.col(label).alias("l")).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.covar_samp(a, b).alias("c"))
    pick = lambda c, l: F.max(F.when(F.col("l") == l, F.col(c)))
    m = g.agg(*[pick(c, l).alias(f"{c}{l}") for c in ("ma", "mb", "va", "vb", "c") for l in (0, 1)])
    va, vb, c = F.col("va0") + F.col("va1"), F.col("vb0") + F.col("vb1"), F.col("c0") + F.col("c1")
    da, db = F.col("ma1") - F.col("ma0"), F.col("mb1") - F.col("mb0")
    det = va * vb - c * c
    m = m.withColumns({"w_a": ratio(vb * da - c * db, det), "w_b": ratio(va * db - c * da, det)})
    return m.select("w_a", "w_b", ((F.col("w_a") * (F.col("ma0") + F.col("ma1")) + F.col("w_b") * (F.col("mb0") + F.col("mb1"))) / 2).alias("mid"))


def apply_pair(df: DataFrame, model: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with ``predicted`` by a ``discriminant_pair``."""
    return df.crossJoin(F.broadcast(model)).withColumn("predicted", (F.col("w_a") * F.col(a) + F.col("w_b") * F.col(b) > F.col("mid")).cast("int")).drop("w_a", "w_b", "mid")  # one row


def quadratic_pair(train: DataFrame, test: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """``test`` with ``predicted`` by closed-form two-variable Gaussian classes (distance plus log-determinant)."""
    g = train.groupBy(F.col(label).alias("l")).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.covar_samp(a, b).alias("c"))
    pick = lambda c, l: F.max(F.when(F.col("l") == l, F.col(c)))
    names = [f"{c}{l}" for c in ("ma", "mb", "va", "vb", "c") for l in (0, 1)]
    m = g.agg(*[pick(n[:-1], int(n[-1])).alias(n) for n in names])

    def score(l: int):
        va, vb, c = F.col(f"va{l}"), F.col(f"vb{l}"), F.col(f"c{l}")
        det = va * vb - c * c
        p, q = F.col(a) - F.col(f"ma{l}"), F.col(b) - F.col(f"mb{l}")
        return (vb * p * p - 2 * c * p * q + va * q * q) / det + F.ln(det)

    return test.crossJoin(F.broadcast(m)).withColumn("predicted", (score(1) < score(0)).cast("int")).drop(*names)  # one row


def project(df: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, score): values times weights by variable."""
    return df.join(weights, "var_id").groupBy("sample_id").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))


def logistic(z):
    return 1 / (1 + F.exp(-z))


# Fits along a path.


def _means(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[y == 1].mean(axis=0), x[y == 0].mean(axis=0)


def _mid(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    a, b = _means(x, y)
    return float(w @ (a + b) / 2)


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return sum((p := x[y == c] - x[y == c].mean(axis=0)).T @ p for c in (0, 1))


def ld_ridge(x: np.ndarray, y: np.ndarray, count: int = 10, lmax: float = 2.0) -> Path:
    """Ridge Fisher discriminants; lambda on a log scale between the inverse of and lmax times the trace."""
    s = _within(x, y)
    top = lmax * max(float(np.trace(s)), 1.0)
    a, b = _means(x, y)
    out = []
    for lam in np.exp(np.linspace(-math.log(top), math.log(top), count)):
        w = np.linalg.solve(s + lam * np.eye(len(s)), a - b)
        out.append((float(lam), w, _mid(x, y, w)))
    return out


def ld_plain(x: np.ndarray, y: np.ndarray, count: int = 10) -> Path:
    """Unregularised discriminants in the first k principal components, k = 1..count."""
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    out = []
    for k in range(1, min(count, int((s > 1e-10 * s[0]).sum())) + 1):
        t = c @ vt[:k].T
        a, b = _means(t, y)
        w = vt[:k].T @ np.linalg.lstsq(_within(t, y), a - b, rcond=None)[0]
        out.append((float(k), w, _mid(x, y, w)))
    return out


def lars(x: np.ndarray, y: np.ndarray, steps: int, ridge: float = 0.0) -> list[np.ndarray]:
    """Coefficients after each of the first steps of least-angle regression with the lasso change (Efron et al., 2004).

    ``ridge`` makes it the elastic net by rows added to the data (Zou and Hastie, 2005).
    """
    if ridge:
        x, y = np.vstack([x, math.sqrt(ridge) * np.eye(x.shape[1])]) / math.sqrt(1 + ridge), np.concatenate([y, np.zeros(x.shape[1])])
    n, d = x.shape
    beta, active, out = np.zeros(d), [], []
    barred = np.zeros(d, dtype=bool)
    while len(out) < steps and len(active) < min(n - 1 + (ridge > 0) * d, d):
        c = x.T @ (y - x @ beta)
        c_off = np.where(barred | np.isin(np.arange(d), active), 0.0, np.abs(c))
        if not active or c_off.max() > 0:
            top = np.abs(c[active]).max() if active else c_off.max()
            if not active or not dropped:
                active.append(int(c_off.argmax()))
                top = max(top, c_off.max())
        else:
            break
        dropped = False
        sign = np.sign(c[active])
        a = x[:, active] * sign
        g = a.T @ a
        try:
            inv = np.linalg.solve(g, np.ones(len(active)))
        except np.linalg.LinAlgError:
            break
        aa = 1 / math.sqrt(max(inv.sum(), 1e-300))
        w = aa * inv * sign
        u = x[:, active] @ w
        corr, big = x.T @ u, np.abs(c[active]).max()
        gamma = big / aa
        rest = np.setdiff1d(np.arange(d), active)
        for j in rest:
            for num, den in ((big - c[j], aa - corr[j]), (big + c[j], aa + corr[j])):
                if den > 1e-12 and 1e-12 < num / den < gamma:
                    gamma = num / den
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = -beta[active] / w
        cross = np.where(cross > 1e-12, cross, np.inf)
        if cross.min() < gamma:
            gamma, dropped = cross.min(), True
        beta[active] += gamma * w
        if dropped:
            k = int(cross.argmin())
            beta[active[k]] = 0.0
            active.pop(k)
        out.append(beta.copy())
    return out


def ld_lars(x: np.ndarray, y: np.ndarray, count: int = 10, ridge: float = 0.0) -> Path:
    """LARS (or elastic-net) fits of -1/+1 targets after each step."""
    c = x - x.mean(axis=0)
    t = np.where(y == 1, 1.0, -1.0)
    return [(float(i), w, _mid(x, y, w)) for i, w in enumerate(lars(c, t - t.mean(), count, ridge), 1)]


def lr_ridge(x: np.ndarray, y: np.ndarray, count: int = 10, rounds: int = 30) -> Path:
    """Ridge logistic regressions by reweighted least squares, lambda from exp(-10) to exp(10); the offset is free."""
    a = np.column_stack([x - x.mean(axis=0), np.ones(len(x))])
    out = []
    for lam in np.exp(np.linspace(10, -10, count)):
        b, old = np.zeros(a.shape[1]), None
        pen = np.diag([lam] * x.shape[1] + [1e-9])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-9)
            b = np.linalg.solve(a.T @ (a * w[:, None]) + pen, a.T @ (w * (a @ b) + y - p))
            now = float(np.log(w).sum())
            if old is not None and abs(now - old) < 0.05 * abs(old):
                break
            old = now
        out.append((float(lam), b[:-1], float(b[:-1] @ x.mean(axis=0) - b[-1])))
    return out


def lr_lasso(x: np.ndarray, y: np.ndarray, count: int = 10, rounds: int = 30) -> Path:
    """Logistic regressions whose weighted least-squares step is a LARS fit of so many variables."""
    c = x - x.mean(axis=0)
    out = []
    for k in range(1, count + 1):
        b, b0, old = np.zeros(x.shape[1]), 0.0, None
        for _ in range(rounds):
            z = np.clip(c @ b + b0, -30, 30)
            p = 1 / (1 + np.exp(-z))
            w = np.maximum(p * (1 - p), 1e-9)
            t = z + (y - p) / w
            b0 = float((w * (t - c @ b)).sum() / w.sum())
            r = np.sqrt(w)
            path = lars(c * r[:, None], r * (t - b0), k)
            if not path:
                break
            b = path[-1]
            now = float(np.log(w).sum())
            if old is not None and abs(now - old) < 0.05 * abs(old):
                break
            old = now
        out.append((float(k), b, float(b @ x.mean(axis=0) - b0)))
    return out


def lr_plain(x: np.ndarray, y: np.ndarray, count: int = 10) -> Path:
    """Logistic regressions in the first k principal components, with a small ridge for separable classes."""
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    out = []
    for k in range(1, min(count, int((s > 1e-10 * s[0]).sum())) + 1):
        t = np.column_stack([c @ vt[:k].T, np.ones(len(x))])
        b = np.zeros(k + 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(t @ b, -30, 30)))
            h = t.T @ (t * np.maximum(p * (1 - p), 1e-9)[:, None])
            step = np.linalg.solve(h + 0.01 * np.diag(h).min() * np.eye(k + 1), t.T @ (y - p))
            b = b + step
            if np.abs(step).max() < 1e-6 * max(np.abs(b).max(), 1):
                break
        w = vt[:k].T @ b[:-1]
        out.append((float(k), w, float(w @ x.mean(axis=0) - b[-1])))
    return out


def svm_linear(x: np.ndarray, y: np.ndarray, costs: Sequence[float], rounds: int = 200) -> Path:
    """Linear support-vector machines by dual coordinate descent (Hsieh et al., 2008); the offset is one more variable."""
    mean = x.mean(axis=0)
    a = np.column_stack([x - mean, np.ones(len(x))])
    t, q = np.where(y == 1, 1.0, -1.0), (a * a).sum(axis=1)
    out, rng = [], np.random.default_rng(0)
    for cost in costs:
        alpha, w = np.zeros(len(x)), np.zeros(a.shape[1])
        for _ in range(rounds):
            most = 0.0
            for i in rng.permutation(len(x)):
                g = t[i] * (a[i] @ w) - 1
                new = min(max(alpha[i] - g / max(q[i], 1e-12), 0.0), cost)
                if new != alpha[i]:
                    w += (new - alpha[i]) * t[i] * a[i]
                    most = max(most, abs(new - alpha[i]))
                    alpha[i] = new
            if most < 1e-4 * cost:
                break
        out.append((float(cost), w[:-1].copy(), float(w[:-1] @ mean - w[-1])))
    return out


def graphical_lasso(s: np.ndarray, lam: float, rounds: int = 50) -> np.ndarray:
    """Sparse inverse covariance by block coordinate descent (Friedman et al., 2008)."""
    d = len(s)
    w = s + lam * np.eye(d)
    betas = np.zeros((d, d))
    for _ in range(rounds):
        old = w.copy()
        for j in range(d):
            rest = np.arange(d) != j
            v, target, b = w[np.ix_(rest, rest)], s[rest, j], betas[rest, j]
            for _ in range(100):
                most = 0.0
                for k in range(d - 1):
                    r = target[k] - v[k] @ b + v[k, k] * b[k]
                    new = math.copysign(max(abs(r) - lam, 0.0), r) / v[k, k]
                    most, b[k] = max(most, abs(new - b[k])), new
                if most < 1e-6:
                    break
            betas[rest, j] = b
            w[rest, j] = w[j, rest] = v @ b
        if np.abs(w - old).max() < 1e-5 * np.abs(s).max():
            break
    out = np.zeros((d, d))
    for j in range(d):
        rest = np.arange(d) != j
        out[j, j] = 1 / (w[j, j] - w[rest, j] @ betas[rest, j])
        out[rest, j] = -betas[rest, j] * out[j, j]
    out = np.where(np.abs(out) < 1e-4, 0.0, out)
    return (out + out.T) / 2


def qd_models(x: np.ndarray, y: np.ndarray, kind: str = "L2", count: int = 5, first: int = 10) -> list[tuple[float, dict]]:
    """Quadratic discriminants: inverse covariance and log-determinant of both classes along a path.

    'L2' adds lambda to trace-normalised covariances, 'L1' is the graphical lasso on the variables that LARS
    takes first, 'NR' uses the first k variables.
    """
    cols = np.arange(x.shape[1])
    if kind == "L1":
        path = lars(x - x.mean(axis=0), np.where(y == 1, 1.0, -1.0) - np.where(y == 1, 1.0, -1.0).mean(), first)
        cols = np.flatnonzero(path[-1]) if path else cols[:first]
    out = []
    for k in range(1, count + 1):
        use = cols[:k] if kind == "NR" else cols
        model: dict = {"cols": use}
        lam = {"NR": 0.0, "L2": math.exp(-6 + 8 * (k - 1) / max(count - 1, 1)), "L1": math.exp(-5 + 4 * (k - 1) / max(count - 1, 1))}[kind]
        for c in (0, 1):
            z = x[y == c][:, use]
            s = np.atleast_2d(np.cov(z, rowvar=False))
            size = max(float(np.trace(s)) / len(s), 1e-12)
            inv = graphical_lasso(s / size, lam) / size if kind == "L1" else np.linalg.pinv(s + lam * size * np.eye(len(s)))
            model[c] = (z.mean(axis=0), inv, -float(np.linalg.slogdet(inv)[1]))
        out.append((float(k) if kind == "NR" else lam, model))
    return out


def qd_scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Difference of log densities, class 1 less class 0."""
    def part(c: int) -> np.ndarray:
        m, inv, logdet = model[c]
        z = x[:, model["cols"]] - m
        return -0.5 * (np.einsum("ij,jk,ik->i", z, inv, z) + logdet)

    return part(1) - part(0)


def qd_map(model: dict, x: np.ndarray) -> np.ndarray:
    """Mean gradient of the discriminant over the samples, in input space."""
    out = np.zeros(x.shape[1])
    z = x[:, model["cols"]]
    out[model["cols"]] = (-(z - model[1][0]) @ model[1][1] + (z - model[0][0]) @ model[0][1]).mean(axis=0)
    return out


def fast_ica(x: np.ndarray, k: int, rounds: int = 200, seed: int = 1) -> np.ndarray:
    """k unmixing directions (rows) of samples x variables, symmetric FastICA with tanh (Hyvarinen, 1999)."""
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    k = min(k, int((s > 1e-10 * s[0]).sum()))
    white = u[:, :k] * math.sqrt(len(x))
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        g = np.tanh(white @ w.T)
        new = g.T @ white / len(x) - (1 - g * g).mean(axis=0)[:, None] * w
        p, _, q = np.linalg.svd(new)
        new = p @ q
        done = np.max(np.abs(np.abs((new * w).sum(axis=1)) - 1)) < 1e-6
        w = new
        if done:
            break
    return w @ (vt[:k] / s[:k, None] * math.sqrt(len(x)))


#: Fits by name: family and regularisation.
FITS: dict[str, Callable[[np.ndarray, np.ndarray], Path]] = {
    "ld_l1": ld_lars,
    "ld_l2": ld_ridge,
    "ld_pc": ld_plain,
    "ld_en": lambda x, y: ld_lars(x, y, 10, 1.0),
    "lr_l1": lambda x, y: lr_lasso(x, y, 5),
    "lr_l2": lr_ridge,
    "lr_pc": lr_plain,
    "svm_l2": lambda x, y: svm_linear(x, y, 10.0 ** np.linspace(-3, 1, 5)),
}


def with_components(fit: Callable[[np.ndarray, np.ndarray], Path], k: int) -> Callable[[np.ndarray, np.ndarray], Path]:
    """``fit`` on independent components, with maps brought back to input space."""

    def run(x: np.ndarray, y: np.ndarray) -> Path:
        basis, mean = fast_ica(x, k), x.mean(axis=0)
        return [(s, basis.T @ w, float(c + basis.T @ w @ mean)) for s, w, c in fit((x - mean) @ basis.T, y)]

    return run


def _hits(w: np.ndarray, c: float, x: np.ndarray, y: np.ndarray, posterior: bool) -> float:
    z = x @ w - c
    if posterior:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return float(np.where(y == 1, p, 1 - p).mean())
    return float(((z > 0) == (y == 1)).mean())


def split_half(x: np.ndarray, y: np.ndarray, half: np.ndarray, fit: Callable[[np.ndarray, np.ndarray], Path], posterior: bool = False) -> pd.DataFrame:
    """(setting, r, p, g, d) of a path: map reproducibility across halves 1 and 2, accuracy from one half to the other, accuracy on
    held-out rows (half 3, null without any) and distance from perfection.  Maps get the sign of the class difference.
    """
    one, two, out = half == 1, half == 2, half == 3
    paths = [fit(x[h], y[h]) for h in (one, two)]
    diff = x[one | two]
    a, b = _means(diff, y[one | two])
    rows = []
    for (s, w1, c1), (_, w2, c2) in zip(*paths, strict=False):
        signs = [1.0 if w @ (a - b) >= 0 else -1.0 for w in (w1, w2)]
        r, _ = rspm_array(w1 * signs[0], w2 * signs[1])
        p = (_hits(w1, c1, x[two], y[two], posterior) * two.sum() + _hits(w2, c2, x[one], y[one], posterior) * one.sum()) / (one.sum() + two.sum())
        g = (_hits(w1, c1, x[out], y[out], posterior) + _hits(w2, c2, x[out], y[out], posterior)) / 2 if out.any() else math.nan
        rows.append((s, r, p, g, math.hypot(1 - r, 1 - p)))
    return pd.DataFrame(rows, columns=["setting", "r", "p", "g", "d"])


def split_half_path(df: DataFrame, plan: DataFrame, id_col: str, array: str, label: str, method: str | Callable[[np.ndarray, np.ndarray], Path], posterior: bool = False) -> DataFrame:
    """(rep, step, setting, r, p, g, d) of every replicate of a plan (rep, id, half); replicates run side by side."""
    fit = FITS[method] if isinstance(method, str) else method

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = split_half(np.array(pdf["x"].tolist(), dtype=float), pdf["y"].to_numpy(), pdf["half"].to_numpy(), fit, posterior)
        out.insert(0, "step", np.arange(1, len(out) + 1))
        out.insert(0, "rep", pdf["rep"].iloc[0])
        return out

    rows = df.select(id_col, F.col(array).alias("x"), F.col(label).cast("int").alias("y")).join(plan.select("rep", id_col, "half"), id_col)
    return rows.select("rep", "half", "x", "y").groupBy("rep").applyInPandas(run, "rep int, step int, setting double, r double, p double, g double, d double")


def nested_cv(x: np.ndarray, y: np.ndarray, fit: Callable[[np.ndarray, np.ndarray], Path], outer: int = 5, inner: int = 5, seed: int = 1) -> pd.DataFrame:
    """(fold, setting, accuracy): settings tuned by inner folds of each outer training set, tested on its outer fold."""
    rng, rows = np.random.default_rng(seed), []

    def folds(labels: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(labels), dtype=int)
        for c in (0, 1):
            at = rng.permutation(np.flatnonzero(labels == c))
            out[at] = np.arange(len(at)) % k
        return out

    top = folds(y, outer)
    for f in range(outer):
        tx, ty = x[top != f], y[top != f]
        inside, score = folds(ty, inner), None
        for g in range(inner):
            acc = np.array([_hits(w, c, tx[inside == g], ty[inside == g], False) for _, w, c in fit(tx[inside != g], ty[inside != g])])
            score = acc if score is None else score[: len(acc)] + acc[: len(score)]
        path = fit(tx, ty)
        best = int(score[: len(path)].argmax())
        rows.append((f, path[best][0], _hits(path[best][1], path[best][2], x[top == f], y[top == f], False)))
    return pd.DataFrame(rows, columns=["fold", "setting", "accuracy"])
