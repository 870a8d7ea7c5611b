"""Cross-products on the cluster, small dense solves in NumPy."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import finite


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, s0.., q0_0..): count, sums and sums of products of the columns over complete rows."""
    k = len(columns)
    rows = df.select(*by, *[finite(c).alias(f"v{i}") for i, c in enumerate(columns)]).dropna(subset=[f"v{i}" for i in range(k)])
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(k)], *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)])


def unpack_moments(row, k: int, centered: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    n = int(row["n"])
    s = np.array([row[f"s{i}"] for i in range(k)], dtype=float)
    m = np.array([[row[f"q{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    return n, s / n, m - np.outer(s, s) / n if centered else m


def collect_moments(df: DataFrame, columns: Sequence[str], centered: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred cross-products) of all rows; what reaches the driver is one row."""
    # Shift by the first moments so that products of large values keep their digits.
    first = df.agg(*[F.avg(finite(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    if centered:
        shifted = df.select(*[(finite(c) - F.lit(first[f"m{i}"])).alias(f"c{i}") for i, c in enumerate(columns)])
        n, mean, m = unpack_moments(moments(shifted, shifted.columns).first(), len(columns))
        return n, mean + np.array([first[f"m{i}"] for i in range(len(columns))]), m
    return unpack_moments(moments(df, columns).first(), len(columns), False)


def map_moments(g: DataFrame, by: Sequence[str], fit: Callable[[np.ndarray, np.ndarray, int], tuple[float, ...]], names: Sequence[str]) -> DataFrame:
    """(by..., n, names...): ``fit`` of each group's (cross-products, means, n)."""
    k = sum(c.startswith("s") and c[1:].isdigit() for c in g.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                n, mean, m = unpack_moments(row, k)
                try:
                    rows.append(fit(m, mean, n))
                except np.linalg.LinAlgError:
                    rows.append((np.nan,) * len(names))
            out = pdf[[*by, "n"]].copy()
            for i, name in enumerate(names):
                out[name] = [float(r[i]) for r in rows]
            yield out

    schema = T.StructType([*[g.schema[c] for c in by], T.StructField("n", T.LongType()), *[T.StructField(x, T.DoubleType()) for x in names]])
    return g.mapInPandas(run, schema)


def gram(df: DataFrame, across: str = "sample_id", var: str = "var_id", value: str = "value") -> DataFrame:
    """(i, j, g): sums of products of every two variables over their common samples; for a few dozen variables."""
    a = df.select(F.col(across).alias("s"), F.col(var).alias("i"), F.col(value).alias("a"))
    b = df.select(F.col(across).alias("s"), F.col(var).alias("j"), F.col(value).alias("b"))
    return a.join(b, "s").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"))


def correlations(df: DataFrame, across: str = "sample_id", var: str = "var_id", value: str = "value") -> DataFrame:
    """(i, j, r): pairwise correlations of the variables over their common samples."""
    a = df.select(F.col(across).alias("s"), F.col(var).alias("i"), F.col(value).alias("a"))
    b = df.select(F.col(across).alias("s"), F.col(var).alias("j"), F.col(value).alias("b"))
    return a.join(b, "s").groupBy("i", "j").agg(F.corr("a", "b").alias("r"))


def array_moments(df: DataFrame, array: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, centred cross-products) of an array column: one partial matrix a task, summed up.

    This is the way for many dimensions, where a self-join would make d * d rows a sample.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            x = [np.asarray(v, dtype=float) for v in pdf["x"] if v is not None]
            x = np.array([v for v in x if np.isfinite(v).all()])
            if len(x):
                x = np.column_stack([np.ones(len(x)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    rows = df.select(F.col(array).alias("x")).mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # (d + 1) ** 2 rows
    d = int(round(len(rows) ** 0.5))
    m = np.array([r.v for r in rows]).reshape(d, d)
    n, s = int(m[0, 0]), m[0, 1:]
    return n, s / n, m[1:, 1:] - np.outer(s, s) / n


def signed(v: np.ndarray) -> np.ndarray:
    """Columns with the sign that makes their largest entry positive."""
    top = np.abs(v).argmax(axis=0)
    return v * np.where(v[top, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def pca(m: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of a symmetric matrix, greatest first, with fixed signs."""
    val, vec = np.linalg.eigh(m)
    order = np.argsort(-val)[: k or len(val)]
    return val[order], signed(vec[:, order])


def logdet(m: np.ndarray) -> float:
    """log |det m|; minus infinity where m is singular."""
    return float(np.linalg.slogdet(m)[1])


def procrustes_match(reference: np.ndarray, other: np.ndarray, by_corr: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(index, flip): the column of ``other`` and its sign for each column of ``reference``, matched greedily.

    ``by_corr`` takes the largest absolute correlations first.  Otherwise reference columns go by falling spread, and each takes the column with the
    least residual sum of squares, with either sign.
    """
    if by_corr:
        a, b = (m - m.mean(axis=0) for m in (reference, other))
        size = [np.where((n := np.linalg.norm(m, axis=0)) > 0, n, 1) for m in (a, b)]
        along = (a / size[0]).T @ (b / size[1])
        gain = np.abs(along)
    else:
        along = reference.T @ other
        gain = 2 * np.abs(along) - (reference**2).sum(axis=0)[:, None] - (other**2).sum(axis=0)[None, :]
    index, flip, left = np.full(len(gain), -1), np.ones(len(gain)), gain.copy()
    order = np.argsort(-reference.std(axis=0, ddof=1), kind="stable") if not by_corr else None
    for step in range(min(gain.shape)):
        i, j = np.unravel_index(left.argmax(), left.shape) if by_corr else (order[step], left[order[step]].argmax())
        index[i], flip[i] = j, -1.0 if along[i, j] < 0 else 1.0
        left[i, :], left[:, j] = -np.inf, -np.inf
    return index, flip
