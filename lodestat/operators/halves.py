"""Split halves of two-class data by class moments: discriminants of every replicate from one pass, their accuracies from a second.

Which half a row is in is a bit of a hash of its id, a bit for each replicate, and held-out rows are the same in all replicates.  The first
pass adds up counts, sums and cross-products by (replicate, half, class); the second half is what remains of the class.  Linear and
quadratic discriminants, their regularisation paths and maps need these moments alone, tables of variables by variables.  The second pass scores
each row by the models of both halves.  No task holds a replicate's rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import graphical_lasso, lars
from .linalg import signed
from .multivariate import rspm_array

#: Held-out rows are those whose hash is 0 modulo this; rows of one product.
HELD_OUT, BLOCK = 5, 4096


@dataclass
class Moments:
    """Count, mean and centred cross-products of one class."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    @staticmethod
    def of(sums: np.ndarray, d: int, shift: np.ndarray) -> Moments:
        n, s, q = sums[0], sums[1 : d + 1], sums[d + 1 :].reshape(d, d)
        mean = s / n if n else np.full(d, np.nan)
        return Moments(float(n), mean + shift, q - np.outer(s, s) / n if n else q)

    @staticmethod
    def rows(x: np.ndarray) -> Moments:
        c = x - x.mean(axis=0)
        return Moments(float(len(x)), x.mean(axis=0), c.T @ c)


Pair = tuple[Moments, Moments]


def pooled(m: Pair) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, mean, centred cross-products) of both classes together."""
    n = m[0].n + m[1].n
    gap = m[1].mean - m[0].mean
    return n, (m[0].n * m[0].mean + m[1].n * m[1].mean) / n, m[0].cross + m[1].cross + m[0].n * m[1].n / n * np.outer(gap, gap)


# Fits: paths of (setting, model); a model is ("linear", w, c) or ("quadratic", by class: (columns, mean, inverse, log-determinant)).


def linear_ridge(m: Pair, count: int = 10, lmax: float = 2.0) -> list:
    s = m[0].cross + m[1].cross
    top = lmax * max(float(np.trace(s)), 1.0)
    out = []
    for lam in np.exp(np.linspace(-math.log(top), math.log(top), count)):
        w = np.linalg.solve(s + lam * np.eye(len(s)), m[1].mean - m[0].mean)
        out.append((float(lam), ("linear", w, float(w @ (m[0].mean + m[1].mean) / 2))))
    return out


def linear_components(m: Pair, count: int = 10) -> list:
    """In the first k principal components of both classes, k = 1..count."""
    _, _, total = pooled(m)
    val, vec = np.linalg.eigh(total)
    val, vec = val[::-1], signed(vec[:, ::-1])
    within, gap, out = m[0].cross + m[1].cross, m[1].mean - m[0].mean, []
    for k in range(1, min(count, int((val > 1e-20 * val[0]).sum())) + 1):
        v = vec[:, :k]
        w = v @ np.linalg.lstsq(v.T @ within @ v, v.T @ gap, rcond=None)[0]
        out.append((float(k), ("linear", w, float(w @ (m[0].mean + m[1].mean) / 2))))
    return out


def least_angle(m: Pair, steps: int) -> list[np.ndarray]:
    """Coefficients of least-angle regression of the class on the variables, from their cross-products.

    Rows that have the same cross-products, a square root of them, stand for the data.
    """
    n, _, total = pooled(m)
    xy = 2 * m[0].n * m[1].n / n * (m[1].mean - m[0].mean)  # of the class as +1 and -1, less its mean
    val, vec = np.linalg.eigh(total)
    keep = val > 1e-12 * max(val[-1], 1e-300)
    root = (vec[:, keep] * np.sqrt(val[keep])).T
    y = np.zeros(len(vec) + 1)
    y[: keep.sum()] = (vec[:, keep].T @ xy) / np.sqrt(val[keep])
    rows = np.zeros((len(vec) + 1, len(vec)))
    rows[: keep.sum()] = root
    return lars(rows, y, steps)


def quadratic(m: Pair, kind: str = "L2", count: int = 5, first: int = 10) -> list:
    """'L2' adds lambda to trace-normalised covariances, 'L1' is the graphical lasso on the variables that least-angle regression takes first, 'NR' uses the first k."""
    cols = np.arange(len(m[0].mean))
    if kind == "L1":
        path = least_angle(m, first)
        cols = np.flatnonzero(path[-1]) if path else cols[:first]
    out = []
    for k in range(1, count + 1):
        use = cols[:k] if kind == "NR" else cols
        lam = {"NR": 0.0, "L2": math.exp(-6 + 8 * (k - 1) / max(count - 1, 1)), "L1": math.exp(-5 + 4 * (k - 1) / max(count - 1, 1))}[kind]
        parts = []
        for one in m:
            s = one.cross[np.ix_(use, use)] / max(one.n - 1, 1)
            size = max(float(np.trace(s)) / len(s), 1e-12)
            inv = graphical_lasso(s / size, lam) / size if kind == "L1" else np.linalg.pinv(s + lam * size * np.eye(len(s)))
            parts.append((use, one.mean[use], inv, -float(np.linalg.slogdet(inv)[1])))
        out.append((float(k) if kind == "NR" else lam, ("quadratic", *parts)))
    return out


FITS: dict[str, Callable[[Pair], list]] = {
    "ld_l2": linear_ridge,
    "ld_pc": linear_components,
    "qd_l2": lambda m: quadratic(m, "L2"),
    "qd_l1": lambda m: quadratic(m, "L1"),
    "qd_nr": lambda m: quadratic(m, "NR"),
}


def scores(model: tuple, x: np.ndarray) -> np.ndarray:
    """Positive for class 1."""
    if model[0] == "linear":
        return x @ model[1] - model[2]
    part = []
    for use, mean, inv, logdet in model[1:]:
        z = x[:, use] - mean
        part.append(-0.5 * (((z @ inv) * z).sum(axis=1) + logdet))
    return part[1] - part[0]


def map_of(model: tuple, m: Pair) -> np.ndarray:
    """The mean gradient of the discriminant over the rows it was fitted on, in input space."""
    if model[0] == "linear":
        return model[1]
    out, mean = np.zeros(len(m[0].mean)), pooled(m)[1]
    (use, m0, i0, _), (_, m1, i1, _) = model[1:]
    out[use] = -(mean[use] - m1) @ i1 + (mean[use] - m0) @ i0
    return out


# Passes


def _source(df: DataFrame, id_col: str, array: str, label: str, reps: int, seed: int, held: bool) -> DataFrame:
    words = F.array(*[F.xxhash64(F.lit(seed), F.lit(k), F.col(id_col)) for k in range(-(-reps // 64))])
    out = F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), F.col(id_col)), F.lit(HELD_OUT)) == 0 if held else F.lit(False)
    return df.filter(F.col(array).isNotNull() & F.col(label).isin(0, 1)).select(F.col(array).alias("x"), F.col(label).cast("int").alias("y"), words.alias("bits"), out.alias("out"))


def _first(bits: np.ndarray, rep: int) -> np.ndarray:
    return (bits[:, rep // 64] >> np.int64(rep % 64)) & 1 == 1


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for pdf in batches:
        for lo in range(0, len(pdf), BLOCK):
            part = pdf.iloc[lo : lo + BLOCK]
            x = np.array([np.asarray(v, dtype=float) for v in part["x"]])
            good = np.isfinite(x).all(axis=1)
            bits = np.array([np.asarray(v, dtype=np.int64) for v in part["bits"]])
            yield x[good], part["y"].to_numpy()[good], bits[good], part["out"].to_numpy(dtype=bool)[good]


def _summed(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[np.ndarray]]) -> np.ndarray | None:
    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in run(batches):
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"v": [total.tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

    parts = df.mapInPandas(arrays, "v binary").groupBy(F.spark_partition_id() % 4).applyInPandas(added, "v binary").collect()  # four arrays
    return np.sum([np.frombuffer(bytes(r.v)) for r in parts], axis=0) if parts else None


def class_moments(source: DataFrame, d: int, reps: int) -> tuple[list[tuple[Pair, Pair]], Pair]:
    """((moments of both classes in the first and in the second half) by replicate, moments of all rows that are not held out)."""
    shift = np.array([v or 0.0 for v in source.agg(*[F.avg(F.col("x")[i]) for i in range(d)]).first()])
    size = 1 + d + d * d

    def products(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[float(len(x))], x.sum(axis=0), (x.T @ x).ravel()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for x, y, bits, out in _blocks(batches):
            x = x - shift
            parts = [products(x[(y == c) & ~out]) for c in (0, 1)]
            for rep in range(reps):
                here = _first(bits, rep) & ~out
                parts += [products(x[here & (y == c)]) for c in (0, 1)]
            yield np.concatenate(parts)

    found = _summed(source, run)
    total = (found if found is not None else np.zeros(2 * (reps + 1) * size)).reshape(reps + 1, 2, size)
    of = lambda s: (Moments.of(s[0], d, shift), Moments.of(s[1], d, shift))
    return [(of(total[r + 1]), of(total[0] - total[r + 1])) for r in range(reps)], of(total[0])


def split_half_paths(df: DataFrame, id_col: str, array: str, label: str, method: str | Callable[[Pair], list], d: int, reps: int = 10, seed: int = 1, held: bool = True, posterior: bool = False) -> tuple[DataFrame, DataFrame]:
    """((rep, step, setting, r, p, g, d), (step, setting, var_id, value)): split-half curves of all replicates, and reference maps.

    ``r`` is the correlation of the halves' maps, ``p`` the accuracy from one half to the other, ``g`` that on held-out rows (null without any) and ``d`` the
    distance from perfection; with ``posterior`` accuracies are mean probabilities of the true class.  Maps have the sign that agrees with the reference
    map, which is fitted on all rows that are not held out.  A replicate with fewer than three rows of a class in a half is left out.
    """
    fit = FITS[method] if isinstance(method, str) else method
    spark = df.sparkSession
    source = _source(df, id_col, array, label, reps, seed, held)
    halves, whole = class_moments(source, d, reps)
    curves, maps = "rep int, step int, setting double, r double, p double, g double, d double", "step int, setting double, var_id int, value double"
    if min(whole[0].n, whole[1].n) < 3:
        return spark.createDataFrame([], curves), spark.createDataFrame([], maps)
    reference = fit(whole)
    use = [r for r, h in enumerate(halves) if min(m.n for pair in h for m in pair) >= 3]
    paths = {r: [fit(pair) for pair in halves[r]] for r in use}
    steps = {r: min(len(reference), *map(len, paths[r])) for r in use}
    width = max([*steps.values(), 1])

    def hits(model: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = scores(model, x)
        if posterior:
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return np.where(y == 1, p, 1 - p)
        return ((z > 0) == (y == 1)).astype(float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for x, y, bits, out in _blocks(batches):
            total = np.zeros((len(use), width, 4))
            for i, r in enumerate(use):
                one = _first(bits, r) & ~out
                for k in range(steps[r]):
                    for path, other in zip(paths[r], (~one & ~out, one), strict=True):
                        model = path[k][1]
                        total[i, k] += hits(model, x[other], y[other]).sum(), other.sum(), hits(model, x[out], y[out]).sum(), out.sum()
            yield total.ravel()

    found = _summed(source, run)
    found = (found if found is not None else np.zeros(len(use) * width * 4)).reshape(len(use), width, 4)
    rows = []
    for i, r in enumerate(use):
        for k in range(steps[r]):
            ref = map_of(reference[k][1], whole)
            one, two = (map_of(path[k][1], pair) for path, pair in zip(paths[r], halves[r], strict=True))
            one, two = (m if m @ ref >= 0 else -m for m in (one, two))
            same, p = rspm_array(one, two)[0], found[i, k, 0] / found[i, k, 1]
            g = float(found[i, k, 2] / found[i, k, 3]) if found[i, k, 3] else None
            rows.append((r, k + 1, float(paths[r][0][k][0]), float(same), float(p), g, math.hypot(1 - same, 1 - p)))
    values = [(k + 1, float(s), i, float(v)) for k, (s, model) in enumerate(reference) for i, v in enumerate(map_of(model, whole))]
    return spark.createDataFrame(rows, curves), spark.createDataFrame(values, maps)
