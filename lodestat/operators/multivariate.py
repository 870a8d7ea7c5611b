"""Multivariate association and discrimination: table similarity, CCA, LDA, PCR and PLS.

Inputs are long frames or array columns; cross-products and per-subject factorings run on the cluster, and
what is solved densely on the driver is no larger than variables by variables or subjects by subjects.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, with_totals

from .linalg import array_moments, pca, procrustes_match


def rv_coef(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row (rv) of two (sample_id, var_id, value) tables of the same samples: tr(Sxy Syx) / sqrt(tr Sxx^2 tr Syy^2)."""

    def cov(a: DataFrame, b: DataFrame) -> DataFrame:
        a = a.select("sample_id", F.col("var_id").alias("i"), F.col("value").alias("a"))
        b = b.select("sample_id", F.col("var_id").alias("j"), F.col("value").alias("b"))
        c = a.join(b, "sample_id").groupBy("i", "j").agg(F.covar_samp("a", "b").alias("c"))
        return c.agg(F.sum(F.col("c") * F.col("c")).alias("s"))

    parts = [cov(p, q).withColumnRenamed("s", n) for n, p, q in (("xy", x, y), ("xx", x, x), ("yy", y, y))]
    row = parts[0].crossJoin(F.broadcast(parts[1])).crossJoin(F.broadcast(parts[2]))  # one row each
    return row.select(ratio(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("rv"))


def rc_coef(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row (rc) of two tables of the same samples and variables: tr(X'Y) / sqrt(tr X'X tr Y'Y) of centred columns."""
    w = Window.partitionBy("var_id")
    a = x.select("sample_id", "var_id", (F.col("value") - F.avg("value").over(w)).alias("a"))
    b = y.select("sample_id", "var_id", (F.col("value") - F.avg("value").over(w)).alias("b"))
    s = a.join(b, ["sample_id", "var_id"]).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return s.select(ratio(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))).alias("rc"))


def rspm(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, z, r): reproducible map of two maps: their mean standard score, over the spread of their difference."""
    rows = with_totals(df.select(key, F.col(a).alias("a"), F.col(b).alias("b")), {"ma": F.avg("a"), "mb": F.avg("b"), "sa": F.stddev_samp("a"), "sb": F.stddev_samp("b"), "r": F.corr("a", "b")})
    za, zb = ratio(F.col("a") - F.col("ma"), F.col("sa")), ratio(F.col("b") - F.col("mb"), F.col("sb"))
    level = (ratio(F.col("ma"), F.col("sa")) + ratio(F.col("mb"), F.col("sb"))) / math.sqrt(2)
    rows = rows.select(key, ((za + zb) / math.sqrt(2) + level).alias("signal"), ((za - zb) / math.sqrt(2)).alias("noise"), "r")
    return with_totals(rows, {"spread": F.stddev_samp("noise")}).select(key, ratio(F.col("signal"), F.col("spread")).alias("z"), "r")


def rspm_array(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """(r, z) of two maps held in memory; the map is zero where either has no spread."""
    sa, sb = a.std(ddof=1), b.std(ddof=1)
    if not sa > 0 or not sb > 0:
        return -1.0, np.zeros(len(a))
    za, zb = (a - a.mean()) / sa, (b - b.mean()) / sb
    noise = ((za - zb) / math.sqrt(2)).std(ddof=1)
    signal = (za + zb + a.mean() / sa + b.mean() / sb) / math.sqrt(2)
    return float(np.corrcoef(a, b)[0, 1]), signal / noise if noise > 0 else np.zeros(len(a))


def rp_optimum(df: DataFrame, by: Sequence[str], r: str = "r", p: str = "p", setting: str = "k") -> DataFrame:
    """(by..., setting, d): the setting with the least distance from perfect reproducibility and prediction."""
    d = F.sqrt((1 - F.col(r)) ** 2 + (1 - F.col(p)) ** 2)
    rows = df.withColumn("d", d)
    return rows.groupBy(*by).agg(F.min_by(setting, F.struct("d", setting)).alias(setting), F.min("d").alias("d"))


def double_centered(df: DataFrame, by: str = "subject", i: str = "i", j: str = "j", value: str = "value", factor: float = 1.0) -> DataFrame:
    """``df`` with ``centered``: each square matrix less its row and column means plus its grand mean, times ``factor``."""
    c = F.col(value) - F.avg(value).over(Window.partitionBy(by, i)) - F.avg(value).over(Window.partitionBy(by, j)) + F.avg(value).over(Window.partitionBy(by))
    return df.withColumn("centered", factor * c)


def rv_matrix(df: DataFrame, by: str = "subject", i: str = "i", j: str = "j", value: str = "centered") -> DataFrame:
    """(a, b, rv) between every two subjects' matrices."""
    x = df.select(F.col(by).alias("a"), i, j, F.col(value).alias("va"))
    y = df.select(F.col(by).alias("b"), i, j, F.col(value).alias("vb"))
    cross = x.join(y, [i, j]).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("s"))
    norm = df.groupBy(by).agg(F.sum(F.col(value) * F.col(value)).alias("n"))
    out = cross.join(norm.select(F.col(by).alias("a"), F.col("n").alias("na")), "a").join(norm.select(F.col(by).alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", ratio(F.col("s"), F.sqrt(F.col("na") * F.col("nb"))).alias("rv"))


def distatis(stack: np.ndarray, distances: bool = False, boots: int = 200, seed: int = 1, squared: bool = True) -> dict:
    """Three-way scaling of subjects x K x K matrices: weights, compromise scores, explained shares, bootstrap scores.

    Distances are (squared and) double-centred with factor -1/2, similarities with 1; each is scaled by its first singular value.
    """
    n, k, _ = stack.shape
    e = np.eye(k) - 1 / k
    s = np.array([(-0.5 if distances else 1.0) * e @ (m**2 if distances and squared else m) @ e for m in stack])
    s = s / np.maximum([np.linalg.norm(m, 2) for m in s], 1e-300)[:, None, None]
    flat = s.reshape(n, -1)
    norm = np.linalg.norm(flat, axis=1)
    rv = flat @ flat.T / np.outer(norm, norm)
    _, first = pca(rv, 1)
    weight = np.abs(first[:, 0]) / np.abs(first[:, 0]).sum()
    val, vec = pca(np.tensordot(weight, s, 1))
    val = np.maximum(val, 0)
    axes = vec / np.where(val > 1e-12, np.sqrt(val), np.inf)
    rng, scores = np.random.default_rng(seed), []
    for _ in range(boots):
        pick = rng.integers(0, n, n)
        scores.append((weight[pick, None, None] * s[pick]).sum(axis=0) / weight[pick].sum() @ axes)
    return {"rv": rv, "weights": weight, "scores": vec * np.sqrt(val), "share": val / max(val.sum(), 1e-300), "boots": np.array(scores)}


def ellipse(x: np.ndarray, y: np.ndarray, scale: float = 2.0) -> dict:
    """Centre, half axes and angle of the principal-axis ellipse of a cloud."""
    val, vec = pca(np.cov(x, y))
    return {"x": float(x.mean()), "y": float(y.mean()), "major": scale * math.sqrt(max(val[0], 0)), "minor": scale * math.sqrt(max(val[1], 0)), "angle": math.atan2(vec[1, 0], vec[0, 0])}


def svd_nobias(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, spread of left-out projections, right): variances of each column's projection on axes fitted without it."""
    u, _, vt = np.linalg.svd(x, full_matrices=False)
    proj = np.zeros((x.shape[1], u.shape[1]))
    for j in range(x.shape[1]):
        v, _, _ = np.linalg.svd(np.delete(x, j, axis=1), full_matrices=False)
        v = v[:, : u.shape[1]]
        flip = np.sign((v * u[:, : v.shape[1]]).sum(axis=0))
        proj[j, : v.shape[1]] = flip * (v.T @ x[:, j])
    return u, proj.var(axis=0, ddof=1), vt.T


def _left_out(df: DataFrame, array: str, extra: Sequence[str], run: Callable[..., dict[str, np.ndarray]], names: Sequence[str]) -> list:
    """Sums of what ``run`` gives for each chunk of rows (arrays, extra columns): (name, k, value) rows, k from 0."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            whole = pdf[[v is not None and bool(np.isfinite(np.asarray(v, dtype=float)).all()) for v in pdf["x"]]].dropna()
            for lo in range(0, len(whole), 256):
                part = whole.iloc[lo : lo + 256]
                x = np.array([np.asarray(v, dtype=float) for v in part["x"]])
                for name, v in run(x, *(part[c].to_numpy(float) for c in extra)).items():
                    total[name] = total.get(name, 0.0) + v
        yield pd.DataFrame([(name, i, float(v)) for name in names for i, v in enumerate(np.atleast_1d(total.get(name, [])))], columns=["name", "k", "v"])

    rows = df.select(F.col(array).alias("x"), *extra).mapInPandas(sums, "name string, k int, v double")
    return rows.groupBy("name", "k").agg(F.sum("v").alias("v")).orderBy("name", "k").collect()  # a few numbers a variable


def svd_nobias_rows(df: DataFrame, array: str) -> np.ndarray:
    """The spread of ``svd_nobias`` with the rows of ``df`` as its columns: each row is left out of the cross-products once."""
    n, mean, m = array_moments(df, array)
    gram = m + n * np.outer(mean, mean)
    u = np.linalg.eigh(gram)[1][:, ::-1]
    center = u.T @ mean  # projections are summed about a point near their mean

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        v = np.linalg.eigh(gram - x[:, :, None] * x[:, None, :])[1][:, :, ::-1]
        flip = np.sign(np.einsum("rij,ij->rj", v, u))
        p = flip * np.einsum("rij,ri->rj", v, x) - center
        return {"s": p.sum(axis=0), "q": (p * p).sum(axis=0)}

    found = _left_out(df, array, [], run, ["s", "q"])
    total, square = (np.array([r.v for r in found if r["name"] == name]) for name in ("s", "q"))
    return (square - total**2 / n) / (n - 1)


def tensor_rank_one(z: np.ndarray, rounds: int = 200, tol: float = 1e-8) -> tuple[float, list[np.ndarray]]:
    """Best rank-one approximation of a tensor by alternating power steps."""
    modes = [np.linalg.svd(np.moveaxis(z, m, 0).reshape(z.shape[m], -1), full_matrices=False)[0][:, 0] for m in range(z.ndim)]
    old = 0.0
    for _ in range(rounds):
        for m in range(z.ndim):
            t = z
            for other in reversed(range(z.ndim)):
                if other != m:
                    t = np.tensordot(t, modes[other], axes=(other, 0))
            size = float(np.linalg.norm(t))
            modes[m] = t / size if size > 0 else t
        if abs(size - old) < tol * max(size, 1e-300):
            break
        old = size
    return size, modes


def tensor_products(x: DataFrame, y: DataFrame) -> DataFrame:
    """(grp, i1, i2, j, z): sums over subjects of a grouped tensor times a grouped table, entry by entry."""
    return x.withColumnRenamed("value", "a").join(y.withColumnRenamed("value", "b"), ["grp", "subj"]).groupBy("grp", "i1", "i2", "j").agg(F.sum(F.col("a") * F.col("b")).alias("z"))


def gcca(blocks: list[np.ndarray], k_subject: int, k_group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean variates, eigenvalues, mean correlation between subjects) of generalised CCA over samples x variables blocks."""
    scores = []
    for x in blocks:
        x = x - x.mean(axis=0)
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        scores.append(u[:, : min(k_subject, int((s > 1e-10 * s[0]).sum()))])
    total = sum(u @ u.T for u in scores) - np.eye(len(scores[0])) * 0
    val, vec = pca(total, k_group)
    each = np.array([u @ (u.T @ vec) for u in scores])
    each /= np.maximum(np.linalg.norm(each, axis=1, keepdims=True), 1e-300)
    s = len(each)
    corr = np.array([np.mean([np.corrcoef(each[a, :, c], each[b, :, c])[0, 1] for a in range(s) for b in range(a)]) for c in range(vec.shape[1])]) if s > 1 else np.ones(vec.shape[1])
    return vec, (val - 1) / max(s - 1, 1), corr


def gcca_resample(blocks: list[np.ndarray], k_subject: int, k_group: int, splits: int = 20, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(mean reproducibility, mean z map) of the components over split halves of the subjects."""
    full, _, _ = gcca(blocks, k_subject, k_group)
    rng, rs, zs = np.random.default_rng(seed), [], []
    for _ in range(splits):
        order = rng.permutation(len(blocks))
        halves = []
        for pick in (order[: len(order) // 2], order[len(order) // 2 :]):
            u, _, _ = gcca([blocks[i] for i in pick], k_subject, k_group)
            index, flip = procrustes_match(full, u)
            halves.append(u[:, index] * flip)
        pairs = [rspm_array(halves[0][:, c], halves[1][:, c]) for c in range(full.shape[1])]
        rs.append([r for r, _ in pairs])
        zs.append(np.array([z for _, z in pairs]).T)
    return np.mean(rs, axis=0), np.mean(zs, axis=0)


def lda_directions(x: np.ndarray, y: np.ndarray, kmax: int) -> np.ndarray:
    """Two-class linear discriminants in the first k principal components, k = 1..kmax, of unit pooled spread, in input space."""
    c = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    vt = vt[:kmax]
    t = c @ vt.T
    out = []
    for k in range(1, len(vt) + 1):
        a, b = t[y == 1, :k], t[y != 1, :k]
        within = ((a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) + (b - b.mean(axis=0)).T @ (b - b.mean(axis=0))) / max(len(t) - 2, 1)
        w = np.linalg.lstsq(within, a.mean(axis=0) - b.mean(axis=0), rcond=None)[0]
        size = math.sqrt(max(float(w @ within @ w), 1e-300))
        out.append(vt[:k].T @ (w / size))
    return np.array(out)


def posterior(score: np.ndarray, m1: float, m0: float, p1: float = 0.5) -> np.ndarray:
    """Probability of class 1 of scores with unit spread about the class means; 0.5 where undefined."""
    with np.errstate(over="ignore", invalid="ignore"):
        z = math.log(p1 / (1 - p1)) - 0.5 * ((score - m1) ** 2 - (score - m0) ** 2)
        p = 1 / (1 + np.exp(-z))
    return np.where(np.isfinite(p), p, 0.5)


def lda_splithalf(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, share: float = 0.5) -> pd.DataFrame:
    """(k, r, p, d) of discriminants of two splits: map reproducibility and mean posterior of the true class across halves."""
    kmax = max(1, min(int(share * min(len(x1), len(x2))), x1.shape[1], min(len(x1), len(x2)) - 2))
    w = [lda_directions(x, y, kmax) for x, y in ((x1, y1), (x2, y2))]
    ref = lda_directions(np.vstack([x1, x2]), np.concatenate([y1, y2]), kmax)
    rows = []
    for k in range(min(map(len, [*w, ref]))):
        maps = [v[k] * (1 if v[k] @ ref[k] >= 0 else -1) for v in w]
        r, _ = rspm_array(maps[0], maps[1])
        hits = []
        for (x, y), (tx, ty), m in (((x1, y1), (x2, y2), w[0][k]), ((x2, y2), (x1, y1), w[1][k])):
            s = (x - x.mean(axis=0)) @ m
            post = posterior((tx - x.mean(axis=0)) @ m, s[y == 1].mean(), s[y != 1].mean(), float(np.mean(y == 1)))
            hits.append(np.where(ty == 1, post, 1 - post))
        p = float(np.concatenate(hits).mean())
        rows.append((k + 1, r, p, math.hypot(1 - r, 1 - p)))
    return pd.DataFrame(rows, columns=["k", "r", "p", "d"])


def split_halves(df: DataFrame, plan: DataFrame, id_col: str, array: str, label: str, share: float = 0.5) -> DataFrame:
    """(rep, k, r, p, d): ``lda_splithalf`` of each replicate of a ``split_plan``; a replicate is one task's group.

    ``label`` is 1 or another number; rows labelled 0 in a -1/0/1 design are censored before the call.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, half = np.array(pdf["x"].tolist(), dtype=float), pdf["y"].to_numpy(), pdf["half"].to_numpy()
        out = lda_splithalf(x[half == 1], y[half == 1], x[half == 2], y[half == 2], share)
        out.insert(0, "rep", pdf["rep"].iloc[0])
        return out

    rows = df.select(id_col, F.col(array).alias("x"), F.col(label).cast("int").alias("y")).join(plan.select("rep", id_col, "half"), id_col)
    return rows.select("rep", "half", "x", "y").groupBy("rep").applyInPandas(run, "rep int, k int, r double, p double, d double")


def pcr(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of principal-component regression."""
    mx, my = x.mean(axis=0), y.mean()
    u, s, vt = np.linalg.svd(x - mx, full_matrices=False)
    k = min(k, int((s > 1e-10 * s[0]).sum()))
    b = vt[:k].T @ ((u[:, :k].T @ (y - my)) / s[:k])
    return b, float(my - mx @ b)


def pcr_r2(df: DataFrame, plan: DataFrame, id_col: str, array: str, y: str, ks: Sequence[int]) -> DataFrame:
    """(rep, k, press, tss, r2) on the test part (half 2) of each split, trained on half 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, t, half = np.array(pdf["x"].tolist(), dtype=float), pdf["y"].to_numpy(float), pdf["half"].to_numpy()
        rows = []
        for k in ks:
            b, a = pcr(x[half == 1], t[half == 1], k)
            press, tss = float(((t[half == 2] - x[half == 2] @ b - a) ** 2).sum()), float(((t[half == 2] - t[half == 1].mean()) ** 2).sum())
            rows.append((int(pdf["rep"].iloc[0]), int(k), press, tss, 1 - press / tss if tss > 0 else np.nan))
        return pd.DataFrame(rows, columns=["rep", "k", "press", "tss", "r2"])

    rows = df.select(id_col, F.col(array).alias("x"), F.col(y).cast("double").alias("y")).join(plan.select("rep", id_col, "half"), id_col)
    return rows.select("rep", "half", "x", "y").groupBy("rep").applyInPandas(run, "rep int, k int, press double, tss double, r2 double")


def pcr_loo(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """Share of the squared deviations that leave-one-out principal-component regression leaves."""
    press = tss = 0.0
    for i in range(len(y)):
        keep = np.arange(len(y)) != i
        b, a = pcr(x[keep], y[keep], k)
        press += (y[i] - x[i] @ b - a) ** 2
        tss += (y[i] - y[keep].mean()) ** 2
    return press / tss


def pcr_loo_rows(df: DataFrame, array: str, y: str, ks: Sequence[int]) -> list[float]:
    """``pcr_loo`` of all rows for each k: a row is left out by taking it from the cross-products of the whole table."""
    n, mean, m = array_moments(df.select(F.concat(F.array(F.col(y).cast("double")), array).alias("x")), "x")
    my, mx, cov, cross = mean[0], mean[1:], m[1:, 1:], m[1:, 0]
    share = n / (n - 1)

    def run(x: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        x, v = x - mx, v - my
        val, vec = np.linalg.eigh(cov - share * x[:, :, None] * x[:, None, :])
        val, vec = val[:, ::-1], vec[:, :, ::-1]
        slope = np.einsum("rij,ri->rj", vec, cross - share * v[:, None] * x)
        slope = np.where(val > 1e-14 * val[:, :1], slope / np.where(val > 0, val, 1.0), 0.0)
        fit = np.cumsum(slope * np.einsum("rij,ri->rj", vec, share * x), axis=1)
        return {"press": ((share * v[:, None] - fit) ** 2).sum(axis=0), "tss": np.array([((share * v) ** 2).sum()])}

    found = _left_out(df, array, [y], run, ["press", "tss"])
    press = [r.v for r in found if r["name"] == "press"]
    tss = next(r.v for r in found if r["name"] == "tss")
    return [press[min(k, len(press)) - 1] / tss for k in ks]


def plsc(x: np.ndarray, y: np.ndarray, condition: np.ndarray, subject: np.ndarray, factors: int = 2, perms: int = 200, boots: int = 200, seed: int = 1) -> dict:
    """Behavioural PLS correlation: salience of X and Y over conditions, with permutation and bootstrap evidence.

    Columns are correlated within each condition; subjects are resampled whole.  ``fraction`` is l / sum(l), ``var_frac``
    l^2 / sum(l^2).
    """
    conditions = np.unique(condition)

    def cross(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = []
        for g in conditions:
            p, q = a[c == g], b[c == g]
            p, q = p - p.mean(axis=0), q - q.mean(axis=0)
            p, q = (v / np.maximum(np.linalg.norm(v, axis=0), 1e-300) for v in (p, q))
            out.append(q.T @ p)
        return np.vstack(out)

    u, s, vt = np.linalg.svd(cross(x, y, condition), full_matrices=False)
    f = min(factors, len(s))
    rng = np.random.default_rng(seed)
    above = np.zeros(f)
    for _ in range(perms):
        order = np.concatenate([rng.permutation(np.flatnonzero(condition == g)) for g in conditions])
        place = np.concatenate([np.flatnonzero(condition == g) for g in conditions])
        shuffled = y.copy()
        shuffled[place] = y[order]
        above += np.linalg.svd(cross(x, shuffled, condition), compute_uv=False)[:f] >= s[:f]
    members, draws = np.unique(subject), []
    for _ in range(boots):
        pick = rng.choice(members, len(members))
        rows = np.concatenate([np.flatnonzero(subject == p) for p in pick])
        if any((condition[rows] == g).sum() < 3 for g in conditions):
            continue
        _, _, bv = np.linalg.svd(cross(x[rows], y[rows], condition[rows]), full_matrices=False)
        index, flip = procrustes_match(vt[:f].T, bv.T)
        draws.append(bv.T[:, index] * flip)
    d = np.array(draws)
    return {"x_salience": vt[:f].T, "y_salience": u[:, :f], "singular": s[:f], "fraction": s[:f] / s.sum(), "var_frac": s[:f] ** 2 / (s**2).sum(), "p": (above + 1) / (perms + 1), "bsr": vt[:f].T / np.maximum(d.std(axis=0, ddof=1), 1e-300), "x_scores": x @ vt[:f].T}


def plsc_task(x: np.ndarray, condition: np.ndarray, subject: np.ndarray, **options) -> dict:
    """Task PLS: salience of X with condition membership, columns standardised over all rows."""
    z = (x - x.mean(axis=0)) / np.where((s := x.std(axis=0, ddof=1)) > 0, s, 1)
    g = (condition[:, None] == np.unique(condition)[None, :]).astype(float)
    return plsc(z, g / g.sum(axis=0), np.zeros(len(x)), subject, **options)


def plsc_matrix(x: DataFrame, y: DataFrame, condition: str) -> DataFrame:
    """(condition, i, j, r): the correlation matrices that behavioural PLS factors, on the cluster."""
    a = x.select(condition, "sample_id", F.col("var_id").alias("i"), F.col("value").alias("a"))
    b = y.select(condition, "sample_id", F.col("var_id").alias("j"), F.col("value").alias("b"))
    return a.join(b, [condition, "sample_id"]).groupBy(condition, "i", "j").agg(F.corr("a", "b").alias("r"))


def npls(x: np.ndarray, y: np.ndarray, factors: int = 1) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Tri-linear PLS (Bro, 1996): (weights of mode 1, of mode 2, covariance) of samples x I x J on y, deflating y."""
    x, y = x - x.mean(axis=0), y - y.mean()
    out, scores, rest = [], [], y.astype(float)
    for _ in range(factors):
        z = np.tensordot(rest, x, axes=(0, 0))
        u, s, vt = np.linalg.svd(z)
        w1, w2 = u[:, 0], vt[0]
        scores.append(np.einsum("sij,i,j->s", x, w1, w2))
        t = np.array(scores).T
        rest = y - t @ np.linalg.lstsq(t, y, rcond=None)[0]
        out.append((w1, w2, float(s[0])))
    return out


def rcaa(a: np.ndarray, b: np.ndarray, kmax: int = 5, lag: int = 1, keep: float = 0.05) -> list[dict]:
    """Canonical autocorrelation components that two voxels x time runs reproduce, most reproducible first.

    In each run's first k components, directions of greatest correlation with their own past; the most alike pair of
    maps across runs is taken out of both, until no pair is left.
    """
    from ..functions.dist import chi2_sf

    runs, out = [a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)], []

    def candidates(x: np.ndarray) -> np.ndarray:
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        maps = []
        for k in range(1, min(kmax, int((s > 1e-8 * s[0]).sum())) + 1):
            t = (vt[:k].T * s[:k])
            p, f = t[:-lag], t[lag:]
            qp, rp = np.linalg.qr(p - p.mean(axis=0))
            qf, _ = np.linalg.qr(f - f.mean(axis=0))
            left, c, _ = np.linalg.svd(qp.T @ qf)
            c = np.minimum(c, 1 - 1e-12)
            for i in range(len(c)):
                stat = -(len(p) - 1 - (2 * k + 1) / 2) * np.log(1 - c[i:] ** 2).sum()
                if float(chi2_sf(np.array([stat]), np.array([float((k - i) ** 2)]))[0]) < keep:
                    maps.append(u[:, :k] @ np.linalg.lstsq(rp, left[:, i], rcond=None)[0])
        return np.array(maps)

    for _ in range(kmax):
        ma, mb = (candidates(x) for x in runs)
        if not len(ma) or not len(mb):
            break
        c = np.abs(np.corrcoef(ma, mb)[: len(ma), len(ma) :])
        i, j = np.unravel_index(np.nanargmax(c), c.shape)
        va, vb = ma[i], mb[j] * np.sign(np.corrcoef(ma[i], mb[j])[0, 1])
        r, z = rspm_array(va, vb)
        out.append({"r": r, "map": z})
        for n, v in enumerate((va, vb)):
            t = v @ runs[n]
            runs[n] = runs[n] - np.outer(runs[n] @ t, t) / max(float(t @ t), 1e-300)
    return sorted(out, key=lambda x: -x["r"])


