"""Maximum likelihood of an incomplete multivariate normal (Meng and Rubin, 1993) from sums over patterns of missing cells.

Rows are reduced once to the count, sum and cross-products of their present columns by pattern, combined in each task before they are shuffled.
A round then needs one solve a pattern: conditional moments of its missing columns follow from its sums.  Where the table of patterns is
larger than ``LOCAL_BYTES`` each round is a pass over it, a task giving one array; else it is gone over on the driver.

Where there are fewer rows than columns, or columns without spread, the likelihood has no maximum: the covariance would become singular.  So
eigenvalues below ``FLOOR`` of the mean variance are raised to it after each round; a well-conditioned estimate is not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-8
LOCAL_BYTES = 32 << 20
#: Patterns that a task holds before it gives their sums out.
HELD = 4096
#: (present columns, rows, sums, cross-products) of a pattern, about a shift.
Pattern = tuple[np.ndarray, float, np.ndarray, np.ndarray]


def array_of(df: DataFrame, row: str, col: str, value: Column, columns: list[object]) -> DataFrame:
    """(row, x): one array a row, NaN where missing; columns in the order given."""
    cells = [F.max(F.when(F.col(col) == F.lit(c), value)).alias(f"c{i}") for i, c in enumerate(columns)]
    wide = df.groupBy(F.col(row).alias("row")).agg(*cells)
    return wide.select("row", F.array(*[F.coalesce(f"c{i}", F.lit(float("nan"))) for i in range(len(columns))]).alias("x"))


def _sums(x: np.ndarray) -> Iterator[tuple[bytes, float, np.ndarray, np.ndarray]]:
    """(mask, rows, sums, cross-products) by pattern of complete rows of present columns; rows without any are left out."""
    seen = np.isfinite(x)
    masks, at = np.unique(seen, axis=0, return_inverse=True)
    at = at.ravel()
    for k, mask in enumerate(masks):
        if mask.any():
            part = x[at == k][:, mask]
            yield mask.tobytes(), float(len(part)), part.sum(axis=0), part.T @ part


def pattern_table(rows: DataFrame, array: str, shift: np.ndarray) -> DataFrame:
    """(mask, n, s, q): sums by pattern of ``array`` less ``shift``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, list] = {}

        def given() -> pd.DataFrame:
            out = pd.DataFrame({"mask": list(held), "n": [v[0] for v in held.values()], "v": [np.concatenate([v[1], v[2].ravel()]).tobytes() for v in held.values()]})
            held.clear()
            return out

        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array([np.asarray(v, dtype=float) for v in pdf["x"]]) - shift
            for mask, n, s, q in _sums(x):
                if mask in held:
                    held[mask] = [a + b for a, b in zip(held[mask], (n, s, q), strict=True)]
                else:
                    held[mask] = [n, s, q]
            if len(held) > HELD:
                yield given()
        yield given()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"mask": [pdf["mask"].iloc[0]], "n": [pdf["n"].sum()], "v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

    schema = "mask binary, n double, v binary"
    return rows.select(F.col(array).alias("x")).mapInPandas(run, schema).groupBy("mask").applyInPandas(added, schema)


def _pattern(mask: bytes, n: float, v: bytes) -> Pattern:
    o = np.frombuffer(mask, dtype=bool)
    a, k = np.frombuffer(v), int(o.sum())
    return o, n, a[:k], a[k:].reshape(k, k)


def expected(patterns: Iterable[Pattern], mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Sums over patterns: expected deviations from ``mean``, their expected cross-products, rows, negative log-likelihood."""
    d = len(mean)
    total, products, rows, like = np.zeros(d), np.zeros((d, d)), 0.0, 0.0
    for o, n, s, q in patterns:
        m = ~o
        delta = mean[o]
        s0 = s - n * delta
        q0 = q - np.outer(s, delta) - np.outer(delta, s) + n * np.outer(delta, delta)
        coo = cov[np.ix_(o, o)]
        root = np.linalg.cholesky(coo)
        b = np.linalg.solve(coo, cov[np.ix_(o, m)]).T
        inner = np.linalg.solve(coo, q0)
        like += 0.5 * (n * (2 * np.log(np.diagonal(root)).sum() + o.sum() * math.log(2 * math.pi)) + np.trace(inner))
        rows += n
        total[o] += s0
        products[np.ix_(o, o)] += q0
        if m.any():
            total[m] += b @ s0
            cross = b @ q0
            products[np.ix_(m, o)] += cross
            products[np.ix_(o, m)] += cross.T
            products[np.ix_(m, m)] += cross @ b.T + n * (cov[np.ix_(m, m)] - b @ cov[np.ix_(o, m)])
    return np.concatenate([total, products.ravel(), [rows, like]])


def floored(cov: np.ndarray) -> np.ndarray:
    """Symmetric, with eigenvalues of at least FLOOR of the mean variance (of 1 where there is none)."""
    cov = (cov + cov.T) / 2
    least = FLOOR * (np.trace(cov) / len(cov) or 1.0)
    val, vec = np.linalg.eigh(cov)
    return cov if val[0] >= least else (vec * np.maximum(val, least)) @ vec.T


def _rounds(step, start: np.ndarray, d: int, rounds: int, tol: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """EM from the sums of ``start``: column counts, sums and cross-products of deviations with missing ones as 0."""
    count, s, q, n = start[:d], start[d : 2 * d], start[2 * d : -1].reshape(d, d), start[-1]
    mean = s / np.maximum(count, 1)
    # Present deviations from the column means: their sums are 0, so products need no further term where both are present.
    cov = floored(q / n)
    trace: list[float] = []
    for _ in range(rounds):
        out = step(mean, cov)
        total, products, like = out[:d], out[d:-2].reshape(d, d), float(out[-1])
        trace.append(like)
        delta = total / n
        mean = mean + delta
        cov = floored(products / n - np.outer(delta, delta))
        if len(trace) > 1 and abs(trace[-2] - trace[-1]) < tol * max(abs(trace[-1]), 1.0):
            break
    return mean, cov, trace


def _start(patterns: Iterable[Pattern], d: int) -> np.ndarray:
    """Column counts and sums, then cross-products of deviations from the column means where both are present, and rows."""
    patterns = list(patterns)
    count, s, rows = np.zeros(d), np.zeros(d), 0.0
    for o, n, t, _ in patterns:
        count[o] += n
        s[o] += t
        rows += n
    mean, q = s / np.maximum(count, 1), np.zeros((d, d))
    for o, n, t, p in patterns:
        m = mean[o]
        q[np.ix_(o, o)] += p - np.outer(t, m) - np.outer(m, t) + n * np.outer(m, m)
    return np.concatenate([count, s, q.ravel(), [rows]])


def ecm_array(x: np.ndarray, rounds: int = 50, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(mean, covariance, negative log-likelihoods) of a matrix with NaN for missing cells."""
    d = x.shape[1]
    shift = np.array([c[np.isfinite(c)].mean() if np.isfinite(c).any() else 0.0 for c in x.T])
    patterns = [(np.frombuffer(m, dtype=bool), n, s, q) for m, n, s, q in _sums(x - shift)]
    if not patterns:
        return np.full(d, np.nan), np.full((d, d), np.nan), []
    mean, cov, trace = _rounds(lambda a, b: expected(patterns, a, b), _start(patterns, d), d, rounds, tol)
    return mean + shift, cov, trace


def _passes(table: DataFrame, d: int):
    """One sum of arrays over the table of patterns, for a function of its patterns."""

    def over(fun) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for pdf in batches:
                if len(pdf):
                    part = fun([_pattern(*r) for r in pdf[["mask", "n", "v"]].itertuples(index=False)])
                    total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"v": [total.tobytes()]})

        return np.sum([np.frombuffer(bytes(r.v)) for r in table.mapInPandas(run, "v binary").collect()], axis=0)  # one array a task

    return over


def ecm_rows(rows: DataFrame, array: str, d: int, rounds: int = 50, tol: float = 1e-8, local_bytes: int = LOCAL_BYTES) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """``ecm_array`` of a table of arrays of ``d`` values."""
    means = rows.agg(*[F.avg(F.when(~F.isnan(F.col(array)[i]), F.col(array)[i])) for i in range(d)]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])
    table = pattern_table(rows, array, shift).persist()
    try:
        size = table.agg(F.coalesce(F.sum(F.octet_length("v") + F.octet_length("mask")), F.lit(0)).alias("b")).first().b
        if not size:
            return np.full(d, np.nan), np.full((d, d), np.nan), []
        if size <= local_bytes:
            patterns = [_pattern(bytes(r.mask), r.n, bytes(r.v)) for r in table.orderBy("mask").collect()]
            mean, cov, trace = _rounds(lambda a, b: expected(patterns, a, b), _start(patterns, d), d, rounds, tol)
        else:
            over = _passes(table, d)

            def counts(some: list[Pattern]) -> np.ndarray:
                out = np.zeros((2, d))
                for o, n, t, _ in some:
                    out[0, o] += n
                    out[1, o] += t
                return np.concatenate([out.ravel(), [sum(p[1] for p in some)]])

            first = over(counts)
            mean0 = first[d : 2 * d] / np.maximum(first[:d], 1)

            def products(some: list[Pattern]) -> np.ndarray:
                q = np.zeros((d, d))
                for o, n, t, p in some:
                    m = mean0[o]
                    q[np.ix_(o, o)] += p - np.outer(t, m) - np.outer(m, t) + n * np.outer(m, m)
                return q.ravel()

            start = np.concatenate([first[: 2 * d], over(products), first[-1:]])
            mean, cov, trace = _rounds(lambda a, b: over(lambda some: expected(some, a, b)), start, d, rounds, tol)
    finally:
        table.unpersist()
    return mean + shift, cov, trace


def objective(rows: DataFrame, array: str, mean: np.ndarray, cov: np.ndarray) -> float:
    """Negative log-likelihood of the present cells at a mean and covariance; rows without any count nothing."""
    table = pattern_table(rows, array, np.zeros(len(mean)))
    out = _passes(table, len(mean))(lambda some: expected(some, mean, cov))
    return float(out[-1]) if np.ndim(out) else 0.0
