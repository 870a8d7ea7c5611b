"""Generalised CCA of subjects' blocks of columns over common samples, from the cross-products between blocks.

Rows are samples; a row's array holds the variables of all subjects, one block after the other.  A subject's components are combinations of its
columns, so the sum of their projections has the eigenvalues of a table of components by components, and group variates are combinations of columns.
One pass gives the cross-products; the eigenproblems, the correlations between subjects and the reproducibility over halves of
subjects are solved on them; a second pass gives each row its variates.  Samples may be any number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import array_moments, signed


@dataclass
class Variates:
    """Combinations of columns (columns x components), eigenvalues as shares beyond one subject, mean correlations between subjects."""

    coef: np.ndarray
    value: np.ndarray
    correlation: np.ndarray


def components(cross: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Combinations of the columns ``at`` that give their first principal components over samples, of unit length."""
    val, vec = np.linalg.eigh(cross[np.ix_(at, at)])
    val, vec = val[::-1], vec[:, ::-1]
    k = min(most, int((val > 1e-20 * max(val[0], 1e-300)).sum())) if val[0] > 0 else 0
    out = np.zeros((len(cross), k))
    out[at] = vec[:, :k] / np.sqrt(val[:k])
    return out


def solve(cross: np.ndarray, blocks: Sequence[np.ndarray], k_subject: int, k_group: int) -> Variates:
    """Variates of the given blocks of columns from centred cross-products of all columns."""
    parts = [components(cross, at, k_subject) for at in blocks]
    a = np.concatenate(parts, axis=1)
    val, vec = np.linalg.eigh(a.T @ cross @ a)
    order = np.argsort(-val)[:k_group]
    order = order[val[order] > 1e-12]
    coef = signed(a @ (vec[:, order] / np.sqrt(val[order])))
    each = [p @ (p.T @ cross @ coef) for p in parts]  # each subject's part of the variates
    s = len(parts)
    corr = np.ones(coef.shape[1])
    if s > 1:
        for c in range(coef.shape[1]):
            m = np.stack([e[:, c] for e in each], axis=1)
            g = m.T @ cross @ m
            size = np.sqrt(np.maximum(np.diagonal(g), 1e-300))
            r = g / np.outer(size, size)
            corr[c] = r[np.tril_indices(s, -1)].mean()
    return Variates(coef, (val[order] - 1) / max(s - 1, 1), corr)


def _matched(cross: np.ndarray, reference: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Columns of ``other`` matched to those of ``reference``, largest correlation over samples first, and turned to agree."""
    size = [np.sqrt(np.maximum(np.einsum("ic,ij,jc->c", m, cross, m), 1e-300)) for m in (reference, other)]
    r = reference.T @ cross @ other / np.outer(*size)
    out, left = np.zeros_like(reference), np.abs(r)
    for _ in range(min(r.shape)):
        i, j = np.unravel_index(left.argmax(), left.shape)
        out[:, i] = other[:, j] * (-1.0 if r[i, j] < 0 else 1.0)
        left[i, :], left[:, j] = -1.0, -1.0
    return out


def halves_of(subjects: int, rng: np.random.Generator, strata: Sequence[object] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the subjects; with ``strata`` each of its groups is halved."""
    groups = np.zeros(subjects, dtype=int) if strata is None else np.unique([str(x) for x in strata], return_inverse=True)[1]
    one, two = [], []
    for g in np.unique(groups):
        order = rng.permutation(np.flatnonzero(groups == g))
        cut = len(order) // 2
        if len(order) % 2 and len(one) < len(two):  # odd groups take turns
            cut += 1
        one.extend(order[:cut])
        two.extend(order[cut:])
    return np.array(sorted(one), dtype=int), np.array(sorted(two), dtype=int)


def resample(n: int, cross: np.ndarray, blocks: Sequence[np.ndarray], k_subject: int, k_group: int, splits: int = 20, seed: int = 1, strata: Sequence[object] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean reproducibility, combinations that give the mean z map) of the components over split halves of subjects.

    Columns are centred, so a z map is a combination of the halves' variates by their spreads and correlation.
    """
    whole = solve(cross, blocks, k_subject, k_group).coef
    rng, rs, total = np.random.default_rng(seed), np.zeros(whole.shape[1]), np.zeros_like(whole)
    for _ in range(splits):
        pair = [_matched(cross, whole, solve(cross, [blocks[i] for i in half], k_subject, k_group).coef) for half in halves_of(len(blocks), rng, strata)]
        for c in range(whole.shape[1]):
            a, b = pair[0][:, c], pair[1][:, c]
            sa, sb = (math.sqrt(max(u @ cross @ u, 0.0) / max(n - 1, 1)) for u in (a, b))
            if not (sa > 0 and sb > 0):
                rs[c] += -1.0
                continue
            r = a @ cross @ b / (n - 1) / (sa * sb)
            rs[c] += r
            if r < 1 - 1e-12:
                total[:, c] += (a / sa + b / sb) / math.sqrt(2) / math.sqrt(1 - r)
    return rs / max(splits, 1), total / max(splits, 1)


def mapped(df: DataFrame, id_col: str, array: str, mean: np.ndarray, coef: np.ndarray) -> DataFrame:
    """(id, component, value): combinations of the centred columns for each row; a row with a missing value gives nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array([np.asarray(v, dtype=float) for v in pdf["x"]]) - mean
                good = np.isfinite(x).all(axis=1)
                out = x[good] @ coef
                yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy()[good], coef.shape[1]), "component": np.tile(np.arange(coef.shape[1], dtype=np.int32), good.sum()), "value": out.ravel()})

    rows = df.filter(F.col(array).isNotNull()).select(F.col(id_col).alias("id"), F.col(array).alias("x"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, component int, value double").withColumnRenamed("id", id_col)


def fit_rows(df: DataFrame, id_col: str, array: str, subjects: int, k_subject: int, k_group: int) -> tuple[DataFrame, Variates]:
    """((id, component, value), variates) of rows whose array has ``subjects`` blocks of equal width."""
    _, mean, cross = array_moments(df, array)
    found = solve(cross, np.split(np.arange(len(mean)), subjects), k_subject, k_group)
    return mapped(df, id_col, array, mean, found.coef), found


def resample_rows(df: DataFrame, id_col: str, array: str, subjects: int, k_subjects: Sequence[int], k_group: int, splits: int = 20, seed: int = 1, strata: Sequence[object] | None = None) -> list[tuple[int, np.ndarray, DataFrame]]:
    """For each number of components a subject: (number, reproducibility, (id, component, value): the mean z map), from one pass over the rows."""
    n, mean, cross = array_moments(df, array)
    blocks = np.split(np.arange(len(mean)), subjects)
    out = []
    for k in k_subjects:
        r, coef = resample(n, cross, blocks, k, k_group, splits, seed, strata)
        out.append((k, r, mapped(df, id_col, array, mean, coef)))
    return out
