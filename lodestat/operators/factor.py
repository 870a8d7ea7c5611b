"""Low-rank models of an incomplete table of arrays by row blocks: matrix factors and soft- or hard-thresholded singular values.

A table of n rows and d columns is never one matrix: the column factor (d x k) goes to all tasks, each row solves for its own factor from
its present cells, and a task gives sums of d times k (k + 1) numbers from which the next column factor follows.  Ridge penalties on both
factors of full rank minimise the same criterion as soft-thresholded singular values (Hastie et al., 2015); rank k with next to no penalty is
the hard-thresholded form, and factors about additive effects are matrix factorisation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a sum that are added apart from one another.
SLICES = 8


@dataclass
class ColumnModel:
    """Column means and spreads, the column factor, the penalty, and the squared error on present cells by round."""

    mean: np.ndarray
    spread: np.ndarray
    factor: np.ndarray
    penalty: float
    errors: list[float]


def column_moments(rows: DataFrame, array: str, d: int, standard: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample standard deviations of present cells, 0 and 1 where there are none or no spread."""
    cell = [F.when(~F.isnan(F.col(array)[i]), F.col(array)[i]) for i in range(d)]
    row = rows.agg(*[F.avg(c) for c in cell], *[F.stddev_samp(c) for c in cell]).first()
    mean = np.array([v if v is not None else 0.0 for v in row[:d]])
    sd = np.array([v if v else 1.0 for v in row[d:]])
    return mean, sd if standard else np.ones(d)


def summed(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> np.ndarray | None:
    """Sum of the arrays that ``run`` gives, one a task at most, as bytes ``v``; summed up in slices on the cluster, so the driver gets one array however many tasks."""

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for pdf in run(batches):
            parts = np.array_split(np.frombuffer(pdf["v"].iloc[0]), SLICES)
            yield pd.DataFrame({"slice": range(SLICES), "task": task, "v": [p.tobytes() for p in parts]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")  # reruns agree
        return pdf.iloc[:1].assign(v=[np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()])

    kind = "slice int, task int, v binary"
    parts = sorted((r.slice, bytes(r.v)) for r in rows.mapInPandas(slices, kind).groupBy("slice").applyInPandas(added, kind).collect())
    return np.concatenate([np.frombuffer(v) for _, v in parts]) if parts else None


def row_factors(x: np.ndarray, factor: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge solutions of each row's present cells on the column factor."""
    seen = np.isfinite(x)
    k = factor.shape[1]
    gram = (seen @ (factor[:, :, None] * factor[:, None, :]).reshape(len(factor), -1)).reshape(-1, k, k)
    return np.linalg.solve(gram + penalty * np.eye(k), (np.where(seen, x, 0.0) @ factor)[:, :, None])[:, :, 0]


def block_sums(x: np.ndarray, factor: np.ndarray, penalty: float) -> np.ndarray:
    """Of a block of rows: for each column the products of row factors and with its cells, then squared error and squared row factors."""
    u, seen = row_factors(x, factor, penalty), np.isfinite(x)
    y = np.where(seen, x, 0.0)
    k = factor.shape[1]
    uu = seen.T @ (u[:, :, None] * u[:, None, :]).reshape(len(u), k * k)
    return np.concatenate([uu.ravel(), (y.T @ u).ravel(), [(np.where(seen, y - u @ factor.T, 0.0) ** 2).sum(), (u * u).sum()]])


def next_factor(sums: np.ndarray, d: int, k: int, penalty: float) -> np.ndarray:
    uu, uy = sums[: d * k * k].reshape(d, k, k), sums[d * k * k : -2].reshape(d, k)
    return np.linalg.solve(uu + penalty * np.eye(k), uy[:, :, None])[:, :, 0]


def start_factor(d: int, k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(d, k))


def alternate(sums_of, factor: np.ndarray, penalty: float, rounds: int, tol: float) -> tuple[np.ndarray, list[float]]:
    """Alternating rounds until the penalised criterion falls by less than ``tol`` of itself."""
    d, k = factor.shape
    errors: list[float] = []
    before = math.inf
    for _ in range(rounds):
        sums = sums_of(factor, penalty)
        errors.append(float(sums[-2]))
        value = float(sums[-2] + penalty * (sums[-1] + (factor * factor).sum()))
        if before - value < tol * max(value, 1e-300):
            break
        before = value
        factor = next_factor(sums, d, k, penalty)
    return factor, errors


def fit_array(x: np.ndarray, rank: int, penalty: float, rounds: int = 100, tol: float = 1e-8, seed: int = 1, start: np.ndarray | None = None) -> tuple[np.ndarray, list[float]]:
    """The column factor of one matrix in memory."""
    return alternate(lambda f, p: block_sums(x, f, p), start_factor(x.shape[1], rank, seed) if start is None else start, penalty, rounds, tol)


def fit_rows(rows: DataFrame, array: str, d: int, rank: int, penalty: float, rounds: int = 100, tol: float = 1e-8, seed: int = 1, standard: bool = True, moments: tuple[np.ndarray, np.ndarray] | None = None, start: np.ndarray | None = None) -> ColumnModel:
    """The model of a table of arrays of ``d`` values, NaN where missing; one pass a round."""
    mean, spread = moments or column_moments(rows, array, d, standard)
    source = rows.select(F.col(array).alias("x"))

    def sums_of(factor: np.ndarray, penalty: float) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for pdf in batches:
                if len(pdf):
                    part = block_sums((np.array([np.asarray(v, dtype=float) for v in pdf["x"]]) - mean) / spread, factor, penalty)
                    total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"v": [total.tobytes()]})

        total = summed(source, run)  # one array of d * k * (k + 1) + 2 numbers
        return total if total is not None else np.zeros(d * rank * (rank + 1) + 2)

    factor, errors = alternate(sums_of, start_factor(d, rank, seed) if start is None else start, penalty, rounds, tol)
    return ColumnModel(mean, spread, factor, penalty, errors)


def filled(rows: DataFrame, array: str, model: ColumnModel, keep: list[str]) -> DataFrame:
    """``keep`` and ``filled``: the arrays with missing cells from the model; a row without any present cell gets the column means."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keep].copy()
            if len(pdf):
                x = (np.array([np.asarray(v, dtype=float) for v in pdf["_x"]]) - model.mean) / model.spread
                low = row_factors(x, model.factor, model.penalty) @ model.factor.T
                out["filled"] = list(np.where(np.isfinite(x), x, low) * model.spread + model.mean)
            else:
                out["filled"] = []
            yield out

    return rows.select(*keep, F.col(array).alias("_x")).mapInPandas(run, f"{kinds}, filled array<double>")


def penalty_path(rows: DataFrame, array: str, d: int, count: int = 20, share: float = 0.01) -> tuple[list[float], tuple[np.ndarray, np.ndarray]]:
    """Penalties from the largest singular value of the standardised table (missing cells 0) down to ``share`` of it, and the moments."""
    mean, spread = column_moments(rows, array, d)
    gram = _gram(rows, array, mean, spread)
    top = math.sqrt(max(float(np.linalg.eigvalsh(gram)[-1]), 0.0)) if gram is not None else 0.0
    return list(np.exp(np.linspace(math.log(max(top, 1e-12)), math.log(max(top, 1e-12) * share), count))), (mean, spread)


def _gram(rows: DataFrame, array: str, mean: np.ndarray, spread: np.ndarray) -> np.ndarray | None:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                z = np.nan_to_num((np.array([np.asarray(v, dtype=float) for v in pdf["x"]]) - mean) / spread)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pd.DataFrame({"v": [total.tobytes()]})

    total = summed(rows.select(F.col(array).alias("x")), run)  # one d x d array
    return total.reshape(len(mean), -1) if total is not None else None


def soft_path(rows: DataFrame, array: str, d: int, count: int = 20, rounds: int = 30, tol: float = 1e-6, rank: int | None = None) -> Iterator[ColumnModel]:
    """Models along the path of penalties, each from the factor before it."""
    path, moments = penalty_path(rows, array, d, count)
    factor = None
    for penalty in path:
        model = fit_rows(rows, array, d, rank or d, penalty, rounds, tol, moments=moments, start=factor)
        # A factor that the penalty has drawn to nothing can't grow again: keep a trace of the start.
        factor = model.factor + 1e-3 * start_factor(d, rank or d, 1)
        yield model
