"""Clustering: k-means over several subjects, mixtures by EM, and agreement of labelings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information over the geometric mean of the entropies, and these, in bits."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    cells = cells.crossJoin(F.broadcast(cells.agg(F.sum("n").alias("t")))).withColumn("p", F.col("n") / F.col("t"))  # one row
    pa, pb = (cells.groupBy(c).agg(F.sum("p").alias(f"p{c}")) for c in "ab")
    h = lambda f, c: f.agg((-F.sum(F.col(c) * F.log2(c))).alias(f"h{c}"))
    mi = cells.join(pa, "a").join(pb, "b").agg(F.sum(F.col("p") * F.log2(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"))
    row = mi.crossJoin(F.broadcast(h(pa, "pa"))).crossJoin(F.broadcast(h(pb, "pb")))  # one row each
    return row.select("mi", F.col("hpa").alias("h_a"), F.col("hpb").alias("h_b"), F.try_divide(F.col("mi"), F.sqrt(F.col("hpa") * F.col("hpb"))).alias("nmi"))


def _distance(array: Column, centre: np.ndarray) -> Column:
    point = F.array(*[F.lit(float(c)) for c in centre])
    return F.aggregate(F.zip_with(array, point, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)


def kmeans(df: DataFrame, id_col: str, array: str, centres: np.ndarray, rounds: int = 20, change: float = 0.05) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster from 0, distance) and the centres, by Lloyd's rounds from the given ones.

    Ends after ``rounds``, or when fewer than ``change`` of the labels move.  A cluster that empties takes the
    point farthest from its own centre.  Ties go to the first cluster.  Arrays of several subjects are laid end to end.
    """
    k = len(centres)
    x = F.transform(array, lambda v: v.cast("double"))
    rows = df.select(F.col(id_col).alias("id"), x.alias("x")).filter(F.col("x").isNotNull())
    centres, old, n = np.array(centres, dtype=float), None, None

    def labelled(c: np.ndarray) -> DataFrame:
        best = F.array_min(F.array(*[F.struct(_distance(F.col("x"), m).alias("d"), F.lit(i).alias("c")) for i, m in enumerate(c)]))
        return rows.withColumn("best", best).select("id", "x", F.col("best.c").alias("cluster"), F.col("best.d").alias("distance"))

    for r in range(rounds):
        now = labelled(centres)
        parts = now.select("cluster", "distance", F.posexplode("x").alias("p", "v")).groupBy("cluster", "p").agg(F.avg("v").alias("m")).collect()  # k * d rows
        new = np.full(centres.shape, np.nan)
        for row in parts:
            new[row.cluster, row.p] = row.m
        empty = np.flatnonzero(np.isnan(new[:, 0]))
        if len(empty):
            for i, row in zip(empty, now.orderBy(F.col("distance").desc(), "id").limit(len(empty)).collect(), strict=False):
                new[i] = row.x
        if np.isnan(new).any():
            new = np.where(np.isnan(new), centres, new)
        if r and np.allclose(new, centres):
            centres = new
            break
        if change and old is not None:
            moved = labelled(new).select("id", "cluster").join(now.select("id", F.col("cluster").alias("was")), "id").agg(F.avg((F.col("cluster") != F.col("was")).cast("double"))).first()[0]
            centres = new
            if moved < change:
                break
        old, centres = centres, new
    del n, k
    return labelled(centres).select(F.col("id").alias(id_col), "cluster", "distance"), centres


def seeds(df: DataFrame, id_col: str, array: str, k: int, seed: int = 1) -> np.ndarray:
    """k vectors chosen by a hash of their ids."""
    chosen = df.filter(F.col(array).isNotNull()).select(id_col, array).orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(k).collect()
    return np.array([r[1] for r in chosen], dtype=float)


def kmeans_best(df: DataFrame, id_col: str, array: str, k: int, starts: int = 10, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """``kmeans`` from several seed sets; the one with the least sum of squares."""
    best = None
    for s in range(starts):
        labels, centres = kmeans(df, id_col, array, seeds(df, id_col, array, k, seed + s))
        cost = labels.agg(F.sum("distance")).first()[0]
        if best is None or cost < best[0]:
            best = cost, labels, centres
    return best[1], best[2]


def gaussian_mixture(df: DataFrame, id_col: str, array: str, k: int, rounds: int = 100, tol: float = 1e-6, scaled: bool = False, shared: bool = False, prior: float = 0.0, seed: int = 1) -> tuple[DataFrame, dict]:
    """((id, cluster, responsibility), model) of a mixture of spherical Gaussians by EM from k-means.

    Types: plain; ``scaled`` lets each vector have its own non-negative scale (its best multiple of the cluster mean); ``shared``
    ties the variances.  ``prior`` is the inverse-gamma pseudo-count of the variances.  Each round is one pass over the
    vectors, whose partial sums (k rows of d + 3 numbers a task) are added up; the driver holds the model only.
    Stops at a relative change of the log-likelihood below ``tol``.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(array).alias("x")).filter(F.col("x").isNotNull())
    _, mean = kmeans(df, id_col, array, seeds(df, id_col, array, k, seed), rounds=5, change=0.0)
    k, d = mean.shape
    first = rows.agg(F.count("*")).first()[0]
    model = {"weight": np.full(k, 1 / k), "mean": mean, "var": np.full(k, max(float(np.var(mean)), 1e-3))}

    def expect(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        xx, mm, xm = (x * x).sum(axis=1)[:, None], (m["mean"] ** 2).sum(axis=1)[None, :], x @ m["mean"].T
        w = np.maximum(xm / np.maximum(mm, 1e-300), 0.0) if scaled else np.ones_like(xm)
        dist = np.maximum(xx - 2 * w * xm + w * w * mm, 0.0)
        log = np.log(m["weight"]) - 0.5 * d * np.log(2 * math.pi * m["var"]) - 0.5 * dist / m["var"]
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        return np.exp(log - total[:, None]), total, w

    trace: list[float] = []
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)  # k * (d + 2) numbers

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((k, d + 4))
            for pdf in batches:
                if len(pdf):
                    x = np.array([np.asarray(v, dtype=float) for v in pdf["x"]])
                    g, like, w = expect(x, sent.value)
                    total[:, 0] += g.sum(axis=0)
                    total[:, 1] += (g * (x * x).sum(axis=1)[:, None]).sum(axis=0)
                    total[:, 2] += (g * w * w).sum(axis=0)
                    total[0, 3] += like.sum()
                    total[:, 4:] += (g * w).T @ x
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

        out = rows.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # k * (d + 4) rows
        s = np.array([r.v for r in out]).reshape(k, d + 4)
        mass = np.maximum(s[:, 0], 1e-12)
        mean = s[:, 4:] / np.maximum(s[:, 2], 1e-12)[:, None]
        ss = np.maximum(s[:, 1] - s[:, 2] * (mean**2).sum(axis=1), 1e-12)
        var = np.full(k, ss.sum() / (mass.sum() * d)) if shared else (ss + 2 * prior) / (mass * d + 2 * prior)
        model = {"weight": mass / first, "mean": mean, "var": np.maximum(var, 1e-9)}
        trace.append(float(s[0, 3]))
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tol * abs(trace[-1]):
            break
    final = spark.sparkContext.broadcast(model)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                g, _, _ = expect(np.array([np.asarray(v, dtype=float) for v in pdf["x"]]), final.value)
                yield pd.DataFrame({"id": pdf["id"], "cluster": g.argmax(axis=1).astype("int32"), "responsibility": g.max(axis=1)})

    labels = rows.mapInPandas(assign, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, responsibility double").withColumnRenamed("id", id_col)
    return labels, model | {"loglik": trace}


def log_multigamma(a: float, p: int) -> float:
    return p * (p - 1) / 4 * math.log(math.pi) + sum(math.lgamma(a - j / 2) for j in range(p))


def covariance_generalization(x1: np.ndarray, x2: np.ndarray, labels1: np.ndarray, labels2: np.ndarray, noise: float = 1.0) -> tuple[float, float]:
    """(predictive log-likelihood of half 2 under half 1's cluster covariance, agreement of the labelings).

    The covariance is a cluster part of low rank plus noise; determinant and inverse follow from their small forms.
    """
    def indicator(l: np.ndarray) -> np.ndarray:
        return (l[:, None] == np.unique(l)[None, :]).astype(float)

    u = indicator(labels1)
    m = np.linalg.lstsq(u, x1, rcond=None)[0]
    c = m @ m.T / x1.shape[1] + 1e-9 * np.eye(u.shape[1])
    s2 = noise * max(float(np.mean((x1 - u @ m) ** 2)), 1e-12)
    inner = np.linalg.inv(c) + u.T @ u / s2
    logdet = len(u) * math.log(s2) + np.linalg.slogdet(c)[1] + np.linalg.slogdet(inner)[1]
    ux = u.T @ x2 / s2
    quad = float((x2 * x2).sum() / s2 - (ux * np.linalg.solve(inner, ux)).sum())
    like = -0.5 * (x2.shape[1] * (logdet + len(u) * math.log(2 * math.pi)) + quad)
    a, b = indicator(labels1).T @ indicator(labels2) / len(labels1), 0
    pa, pb = a.sum(axis=1), a.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        mi = np.nansum(a * np.log2(a / np.outer(pa, pb)))
    h = math.sqrt(float(-(pa * np.log2(pa)).sum() * -(pb * np.log2(pb)).sum()))
    return like, mi / h if h > b else 1.0
