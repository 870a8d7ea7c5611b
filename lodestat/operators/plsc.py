"""PLS correlation of whole tables: cross-products of all permutations and bootstraps in one pass each.

What a replicate needs are sums by condition: counts, sums and sums of squares of both sides, and their cross-products.  Subjects are resampled by the
draw counts of ``mixed.Resampler``, so a task gives replicates x (X columns x Y columns) numbers, and the driver factors
small tables only.  Permutations shuffle Y against X within a condition and a bucket of subjects, which are dealt by hash: under the null
hypothesis rows are exchangeable there as they are in the whole.  Up to one bucket of subjects that is the full permutation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linalg import procrustes_match
from .mixed import Resampler


def subject_rows(df: DataFrame, subject: str, x: str, y: str, p: int, q: int, condition: Column | None, conditions: Sequence[object]) -> DataFrame:
    """(subject, v): for each condition whether the subject has it, then its Y and X, means where it has several rows.

    Rows with a missing or non-finite value in either array are left out.
    """
    whole = lambda c, n: F.col(c).isNotNull() & (F.size(c) == n) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.filter(whole(x, p) & whole(y, q)).select(F.col(subject).alias("subject"), F.concat(F.array(F.lit(1.0)), F.col(y), F.col(x)).alias("a"), (condition if condition is not None else F.lit(0)).alias("c"))
    n = 1 + p + q
    one = rows.select("subject", "c", F.posexplode("a").alias("i", "v")).groupBy("subject", "c", "i").agg(F.avg("v").alias("v")) if _repeated(rows) else None
    if one is not None:
        rows = one.groupBy("subject", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("a"))
    empty = F.array_repeat(F.lit(0.0), n)
    each = [F.coalesce(F.first(F.when(F.col("c") == F.lit(c), F.col("a")), ignorenulls=True), empty) for c in conditions]
    return rows.groupBy("subject").agg(F.concat(*each).alias("v"))


def _repeated(rows: DataFrame) -> bool:
    return not rows.groupBy("subject", "c").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _parts(v: np.ndarray, p: int, q: int, shift: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(present, Y, X) by condition, less the shift."""
    out = []
    for block in np.split(v, v.shape[1] // (1 + p + q), axis=1):
        here = block[:, :1]
        out.append((here[:, 0], (block[:, 1 : 1 + q] - shift[:q]) * here, (block[:, 1 + q :] - shift[q:]) * here))
    return out


def _sums_kernel(p: int, q: int, shift: np.ndarray) -> Callable:
    def run(v: np.ndarray, w: np.ndarray, *_: object) -> np.ndarray:
        out = []
        for here, y, x in _parts(v, p, q, shift):
            out += [(w @ here)[:, None], w @ y, w @ x, w @ (y * y), w @ (x * x), w @ (y[:, :, None] * x[:, None, :]).reshape(len(v), -1)]
        return np.concatenate(out, axis=1)

    return run


def _shuffle_kernel(p: int, q: int, shift: np.ndarray) -> Callable:
    def run(v: np.ndarray, w: np.ndarray, reps: np.ndarray, rng: Callable) -> np.ndarray:
        parts = _parts(v, p, q, shift)
        out = np.empty((len(w), len(parts), q * p))
        for r in range(len(w)):
            g = rng(r)
            for c, (here, y, x) in enumerate(parts):
                at = np.flatnonzero(here)
                out[r, c] = (y[g.permutation(at)].T @ x[at]).ravel()
        return out.reshape(len(w), -1)

    return run


def correlations(sums: np.ndarray, p: int, q: int, products: np.ndarray | None = None) -> np.ndarray:
    """(replicates, conditions * q, p) stacked correlations; columns without spread have zeros."""
    reps, size = len(sums), 1 + 2 * (p + q) + p * q
    s = sums.reshape(reps, -1, size)
    n, sy, sx, yy, xx, yx = np.split(s, np.cumsum([1, q, p, q, p]), axis=2)
    yx = (yx if products is None else products.reshape(len(products), s.shape[1], q * p)).reshape(-1, s.shape[1], q, p)
    n = np.maximum(n, 1.0)
    cross = yx - sy[..., :, None] * sx[..., None, :] / n[..., None]
    spread = [np.sqrt(np.maximum(b - a * a / n, 0.0)) for a, b in ((sy, yy), (sx, xx))]
    both = spread[0][..., :, None] * spread[1][..., None, :]
    return np.where(both > 1e-12, cross / np.where(both > 0, both, 1.0), 0.0).reshape(-1, s.shape[1] * q, p)


def analyse(df: DataFrame, subject: str, x: str, y: str, p: int, q: int, condition: str | None = None, factors: int = 2, perms: int = 1000, boots: int = 1000, seed: int = 1) -> dict:
    """Behavioural PLS of array columns ``x`` (p values) and ``y`` (q values), correlated within each condition.

    Gives ``x_salience`` (p x factors), ``y_salience``, ``singular``, ``fraction``, ``var_frac``, ``p`` by permutation and ``bsr``, saliences over their
    standard deviation over bootstraps matched to them by Procrustes.  Bootstraps in which a condition has fewer than three subjects do not count.
    Without rows the saliences are zeros.
    """
    conditions = [0] if condition is None else sorted(r[0] for r in df.select(condition).distinct().collect() if r[0] is not None)  # conditions of the design
    rows = subject_rows(df, subject, x, y, p, q, None if condition is None else F.col(condition), conditions)
    first = df.agg(*[F.avg(F.col(y)[i]) for i in range(q)], *[F.avg(F.col(x)[i]) for i in range(p)]).first()
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in first])
    with Resampler(rows, seed) as sampler:
        if not sampler.total:
            f = min(factors, q * max(len(conditions), 1), p)
            return {"x_salience": np.zeros((p, f)), "y_salience": np.zeros((q * len(conditions), f)), "singular": np.zeros(f), "fraction": np.zeros(f), "var_frac": np.zeros(f), "p": np.ones(f), "bsr": np.zeros((p, f)), "conditions": conditions}
        whole = sampler.sums(_sums_kernel(p, q, shift), None)
        drawn = sampler.sums(_sums_kernel(p, q, shift), [(r, 0) for r in range(boots)])
        mixed = sampler.sums(_shuffle_kernel(p, q, shift), [(r, 1) for r in range(perms)])
    u, s, vt = np.linalg.svd(correlations(whole, p, q)[0], full_matrices=False)
    f = min(factors, len(s))
    null = np.linalg.svd(correlations(np.repeat(whole, perms, axis=0), p, q, mixed), compute_uv=False)[:, :f] if perms else np.zeros((0, f))
    count = drawn.reshape(boots, len(conditions), -1)[:, :, 0] if boots else np.zeros((0, 1))
    draws = []
    for m in correlations(drawn, p, q)[(count >= 3).all(axis=1)] if boots else []:
        bv = np.linalg.svd(m, full_matrices=False)[2]
        index, flip = procrustes_match(vt[:f].T, bv.T)
        draws.append(bv.T[:, index] * flip)
    spread = np.array(draws).std(axis=0, ddof=1) if len(draws) > 1 else np.full((p, f), np.inf)
    return {
        "x_salience": vt[:f].T, "y_salience": u[:, :f], "singular": s[:f], "fraction": s[:f] / max(s.sum(), 1e-300), "var_frac": s[:f] ** 2 / max((s**2).sum(), 1e-300),
        "p": ((null >= s[:f] * (1 - 1e-12)).sum(axis=0) + 1) / (perms + 1), "bsr": vt[:f].T / np.maximum(spread, 1e-300), "conditions": conditions,
    }


def analyse_task(df: DataFrame, subject: str, x: str, p: int, condition: str, **options) -> dict:
    """Task PLS: the same with condition membership as Y, over all rows."""
    groups = sorted(r[0] for r in df.select(condition).distinct().collect() if r[0] is not None)
    member = df.filter(F.col(condition).isNotNull()).withColumn("_y", F.array(*[(F.col(condition) == F.lit(g)).cast("double") for g in groups]))
    return analyse(member, subject, x, "_y", p, len(groups), None, **options) | {"groups": groups}


# Tri-linear PLS from cross-products


def trilinear(xx: np.ndarray, xy: np.ndarray, shape: tuple[int, int], factors: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(weights of mode 1, of mode 2, covariance) of samples x I x J on y, deflating y, from centred X'X and X'y.

    A factor's scores are X times the outer product of its weights, so what is left of y has the products X'y - X'X W b.
    """
    out, w = [], np.zeros((len(xy), 0))
    rest = xy
    for _ in range(factors):
        u, s, vt = np.linalg.svd(rest.reshape(shape))
        out.append((u[:, 0], vt[0], float(s[0])))
        w = np.column_stack([w, np.outer(u[:, 0], vt[0]).ravel()])
        b = np.linalg.lstsq(w.T @ xx @ w, w.T @ xy, rcond=None)[0]
        rest = xy - xx @ w @ b
    return out


def _square_kernel(p: int, shift: np.ndarray) -> Callable:
    def run(v: np.ndarray, w: np.ndarray, *_: object) -> np.ndarray:
        (here, y, x), = _parts(v, p, 1, shift)
        return np.concatenate([(w @ here)[:, None], w @ y, w @ x, w @ (y * x), w @ (x[:, :, None] * x[:, None, :]).reshape(len(v), -1)], axis=1)

    return run


def _centred(s: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    n, sy, sx, yx, xx = max(s[0], 1.0), s[1], s[2 : 2 + p], s[2 + p : 2 + 2 * p], s[2 + 2 * p :].reshape(p, p)
    return xx - np.outer(sx, sx) / n, yx - sy * sx / n


def analyse_trilinear(df: DataFrame, subject: str, x: str, y: str, shape: tuple[int, int], factors: int = 1, boots: int = 500, seed: int = 1) -> list[dict]:
    """For each factor ``first``, ``second`` (weights of both modes), ``covariance`` and ``first_bsr``, ``second_bsr`` over resampled subjects.

    ``x`` holds I * J values by rows, ``y`` is an array of one.
    """
    p = shape[0] * shape[1]
    first = df.agg(F.avg(F.col(y)[0]), *[F.avg(F.col(x)[i]) for i in range(p)]).first()
    shift = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in first])
    with Resampler(subject_rows(df, subject, x, y, p, 1, None, [0]), seed) as sampler:
        if not sampler.total:
            return []
        whole = trilinear(*_centred(sampler.sums(_square_kernel(p, shift), None)[0], p), shape, factors)
        drawn = sampler.sums(_square_kernel(p, shift), [(r, 0) for r in range(boots)]) if boots else np.zeros((0, 2 + 2 * p + p * p))
    samples: list[list[list[np.ndarray]]] = [[[], []] for _ in whole]
    for s in drawn:
        for k, (a, b, _) in enumerate(trilinear(*_centred(s, p), shape, factors)):
            flip = [1.0 if v @ w >= 0 else -1.0 for v, w in zip((a, b), whole[k], strict=False)]
            samples[k][0].append(a * flip[0])
            samples[k][1].append(b * flip[1])
    out = []
    for (a, b, c), (sa, sb) in zip(whole, samples, strict=True):
        bsr = [w / np.maximum(np.std(s, axis=0, ddof=1), 1e-300) if len(s) > 1 else np.zeros(len(w)) for w, s in ((a, sa), (b, sb))]
        out.append({"first": a, "second": b, "covariance": c, "first_bsr": bsr[0], "second_bsr": bsr[1]})
    return out
