"""Parcels of voxels that share time courses over subjects, with subject maps: a mixture fitted by EM over (voxel x time x subject) rows.

A voxel of parcel k has, in subject s, the course w * mu_ks plus noise of a variance of its own.  Kinds of model, each freer than the one
before: ``plain`` (w is 1), ``scaled`` (a scale w >= 0 for each voxel and parcel), ``shared`` (mu_s = P_s H with orthonormal P_s: all subjects have the
covariance H'H) and ``network`` (mu_s = P_s H diag(c_s): parcels are scaled by subject).

Scale and variances of a voxel are maxima of its own likelihood given the courses, so they are found again in each pass and no state is kept by
voxel.  What the courses need are sums over voxels, subjects x parcels x (times + 1) numbers a task; P_s comes from an orthogonal
Procrustes step for each subject.  Each step raises the likelihood, a round is one pass, and the driver holds the model alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import kmeans_best, seeds

KINDS = ("plain", "scaled", "shared", "network")
#: Alternations of scale and variances of a voxel in one pass; weight of the prior on variances.
INNER, PRIOR = 6, 1e-6


@dataclass
class Parcels:
    """Weights (k), courses (subject, k, time), and for shared kinds bases (subject, time, k), H (k, k) and scales (subject, k)."""

    kind: str
    weight: np.ndarray
    course: np.ndarray
    basis: np.ndarray | None = None
    common: np.ndarray | None = None
    scale: np.ndarray | None = None
    loglik: list[float] = field(default_factory=list)


def profile(x: np.ndarray, course: np.ndarray, scaled: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scales (v, k), variances (v, k, s), log-likelihoods (v, k)) of voxels x (v, s, t), each at its maximum."""
    t = x.shape[2]
    xx, mm = (x * x).sum(axis=2)[:, None, :], (course * course).sum(axis=2).T[None]
    xm = np.einsum("vst,skt->vks", x, course)
    w = np.ones(xm.shape[:2])
    spread = np.maximum(np.broadcast_to(xx / t, xm.shape), 1e-12)
    for _ in range(INNER if scaled else 1):
        if scaled:
            w = np.maximum((xm / spread).sum(axis=2) / np.maximum((mm / spread).sum(axis=2), 1e-300), 0.0)
        apart = np.maximum(xx - 2 * w[..., None] * xm + (w * w)[..., None] * mm, 0.0)
        spread = np.maximum((apart + PRIOR) / (t + PRIOR), 1e-12)
    apart = np.maximum(xx - 2 * w[..., None] * xm + (w * w)[..., None] * mm, 0.0)
    like = -0.5 * (t * np.log(2 * math.pi * spread) + apart / spread).sum(axis=2) - 0.5 * PRIOR * (np.log(spread) + 1 / spread).sum(axis=2)
    return w, spread, like


def responsibilities(like: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    a = like + np.log(np.maximum(weight, 1e-300))
    top = a.max(axis=1, keepdims=True)
    e = np.exp(a - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, float((np.log(total) + top).sum())


def voxel_sums(x: np.ndarray, model: Parcels, fixed: np.ndarray | None = None) -> np.ndarray:
    """Mass of each parcel, sums of w^2 / variance (s, k) and of w / variance * x (s, k, t), voxels, log-likelihood."""
    w, spread, like = profile(x, model.course, model.kind != "plain")
    gamma, total = responsibilities(like, model.weight)
    if fixed is not None:
        gamma = np.eye(len(model.weight))[fixed]
        total = float((gamma * like).sum())
    each = gamma[..., None] * w[..., None] / spread
    a = (each * w[..., None]).sum(axis=0).T
    b = np.einsum("vks,vst->skt", each, x)
    return np.concatenate([gamma.sum(axis=0), a.ravel(), b.ravel(), [len(x), total]])


def maximised(sums: np.ndarray, model: Parcels) -> Parcels:
    """The model after one M-step from the sums over voxels."""
    s, k, t = model.course.shape
    mass, a, b = sums[:k], sums[k : k + s * k].reshape(s, k), sums[k + s * k : -2].reshape(s, k, t)
    weight, a = mass / max(sums[-2], 1.0), np.maximum(a, 1e-300)
    if model.basis is None:
        return Parcels(model.kind, weight, b / a[:, :, None], loglik=model.loglik)
    h, c = model.common, model.scale
    basis = np.empty_like(model.basis)
    for i in range(s):  # the orthonormal basis nearest to what the courses want
        u, _, vt = np.linalg.svd((h * c[i]) @ b[i], full_matrices=False)
        basis[i] = vt.T @ u.T
    cross = np.einsum("sk,skt,stj->kj", c, b, basis)
    h = cross.T / np.maximum((c * c * a).sum(axis=0), 1e-300)
    if model.kind == "network":
        along = np.einsum("skt,stk->sk", b, basis @ h)
        c = np.maximum(along / (a * np.maximum((h * h).sum(axis=0), 1e-300)), 0.0)
    course = np.einsum("stj,jk,sk->skt", basis, h, c)
    return Parcels(model.kind, weight, course, basis, h, c, model.loglik)


def started(course: np.ndarray, kind: str) -> Parcels:
    """A model that begins with the given courses (s, k, t)."""
    s, k, t = course.shape
    weight = np.full(k, 1.0 / k)
    if kind in ("plain", "scaled"):
        return Parcels(kind, weight, course)
    if t < k:
        raise ValueError("shared kinds need as many times as parcels")
    # The nearest model of the kind: orthonormal bases of the courses, and the mean of what they leave.
    scale = np.maximum(np.linalg.norm(course, axis=2), 1e-12) if kind == "network" else np.ones((s, k))
    wide = np.transpose(course / scale[:, :, None], (0, 2, 1))
    basis = np.empty_like(wide)
    for i in range(s):
        u, _, vt = np.linalg.svd(wide[i], full_matrices=False)
        basis[i] = u @ vt
    common = np.einsum("stj,stk->jk", basis, wide) / s
    return Parcels(kind, weight, np.einsum("stj,jk,sk->skt", basis, common, scale), basis, common, scale)


def voxel_rows(df: DataFrame, voxel: str, subject: str, time: str, value: str) -> tuple[DataFrame, list[object], list[object]]:
    """((voxel, x): values by subject, then time; the subjects; the times) of long rows; missing cells are 0."""
    subjects, times = (sorted(r[0] for r in df.select(c).distinct().collect() if r[0] is not None) for c in (subject, time))
    spark = df.sparkSession
    rows = df.select(F.col(voxel).alias("voxel"), F.col(subject).alias("_s"), F.col(time).alias("_t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_y"))
    for c, names in (("_s", subjects), ("_t", times)):
        place = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"`{c}i` int, `{c}` {rows.schema[c].dataType.simpleString()}")
        rows = rows.join(F.broadcast(place), c)  # subjects and times of the design
    cells = rows.groupBy("voxel", (F.col("_si") * len(times) + F.col("_ti")).alias("i")).agg(F.avg("_y").alias("v"))
    maps = cells.groupBy("voxel").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    size = len(subjects) * len(times)
    return maps.select("voxel", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("x")), subjects, times


def fit(rows: DataFrame, subjects: int, times: int, k: int, kind: str = "network", rounds: int = 100, tol: float = 1e-6, start: str | Sequence[object] = "kmeans", starts: int = 10, parcels: DataFrame | None = None, seed: int = 1) -> Parcels:
    """The model of rows (voxel, x).

    ``start`` is ``kmeans`` (the best of ``starts``), ``random`` or a list of voxels whose courses begin the parcels.  ``parcels`` (voxel, cluster) holds
    the parcels fixed; then courses begin as their means and voxels without a parcel are left out.  Stops at a relative change of the log-likelihood below ``tol``.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    source = rows.filter(F.col("x").isNotNull())
    if parcels is not None:
        source = source.join(parcels.select("voxel", F.col("cluster").cast("int").alias("cluster")).filter("cluster IS NOT NULL"), "voxel")
        means = {(r.cluster, r.i): r.v for r in source.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("v")).collect()}  # k courses
        flat = np.array([[means.get((c, i), 0.0) for i in range(subjects * times)] for c in range(k)])
    elif start == "kmeans":
        flat = kmeans_best(source, "voxel", "x", k, starts, seed)[1]
    elif start == "random":
        flat = seeds(source, "voxel", "x", k, seed)
    else:
        found = {r.voxel: r.x for r in source.filter(F.col("voxel").isin(list(start))).collect()}
        flat = np.array([found[v] for v in start], dtype=float)
    model = started(flat.reshape(len(flat), subjects, times).transpose(1, 0, 2), kind)
    columns = ["x", *(["cluster"] if parcels is not None else [])]
    for _ in range(rounds):

        def run(batches: Iterator[pd.DataFrame], model: Parcels = model) -> Iterator[pd.DataFrame]:
            total = None
            for pdf in batches:
                for lo in range(0, len(pdf), 256):
                    part = pdf.iloc[lo : lo + 256]
                    x = np.array([np.asarray(v, dtype=float) for v in part["x"]]).reshape(len(part), subjects, times)
                    sums = voxel_sums(x, model, part["cluster"].to_numpy() if "cluster" in part else None)
                    total = sums if total is None else total + sums
            if total is not None:
                yield pd.DataFrame({"v": [total.tobytes()]})

        parts = source.select(*columns).mapInPandas(run, "v binary").collect()  # one array of the model's size a task
        if not parts:
            break
        sums = np.sum([np.frombuffer(bytes(r.v)) for r in parts], axis=0)
        model = maximised(sums, model)
        model.loglik.append(float(sums[-1]))
        trace = model.loglik
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tol * abs(trace[-1]):
            break
    return model


def labelled(rows: DataFrame, model: Parcels) -> DataFrame:
    """(voxel, cluster, responsibility, scale): the likeliest parcel of each voxel and the voxel's scale in it."""
    s, _, t = model.course.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array([np.asarray(v, dtype=float) for v in pdf["x"]]).reshape(len(pdf), s, t)
                w, _, like = profile(x, model.course, model.kind != "plain")
                gamma, _ = responsibilities(like, model.weight)
                at = gamma.argmax(axis=1)
                yield pd.DataFrame({"voxel": pdf["voxel"], "cluster": at.astype("int32"), "responsibility": gamma.max(axis=1), "scale": w[np.arange(len(at)), at]})

    source = rows.filter(F.col("x").isNotNull()).select("voxel", "x")
    return source.mapInPandas(run, f"voxel {source.schema['voxel'].dataType.simpleString()}, cluster int, responsibility double, scale double")


def subject_maps(rows: DataFrame, model: Parcels, names: Sequence[object] | None = None) -> DataFrame:
    """(voxel, subject, cluster, weight, r): each voxel's weight on and correlation with each parcel's course in each subject."""
    s, k, t = model.course.shape
    spark, course = rows.sparkSession, model.course
    centred = course - course.mean(axis=2, keepdims=True)
    unit = centred / np.maximum(np.linalg.norm(centred, axis=2, keepdims=True), 1e-300)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array([np.asarray(v, dtype=float) for v in pdf["x"]]).reshape(len(pdf), s, t)
                weight = np.einsum("vst,skt->vsk", x, course) / np.maximum((course * course).sum(axis=2), 1e-300)
                y = x - x.mean(axis=2, keepdims=True)
                r = np.einsum("vst,skt->vsk", y, unit) / np.maximum(np.linalg.norm(y, axis=2), 1e-300)[..., None]
                v, i, j = np.indices(weight.shape).reshape(3, -1)
                yield pd.DataFrame({"voxel": pdf["voxel"].to_numpy()[v], "s": i.astype("int32"), "cluster": j.astype("int32"), "weight": weight.ravel(), "r": r.ravel()})

    source = rows.filter(F.col("x").isNotNull()).select("voxel", "x")
    out = source.mapInPandas(run, f"voxel {source.schema['voxel'].dataType.simpleString()}, s int, cluster int, weight double, r double")
    if names is None:
        return out.withColumnRenamed("s", "subject")
    kind = "bigint" if all(isinstance(n, int) for n in names) else "string"
    named = spark.createDataFrame([(i, n if kind == "bigint" else str(n)) for i, n in enumerate(names)], f"s int, subject {kind}")
    return out.join(F.broadcast(named), "s").select("voxel", "subject", "cluster", "weight", "r")
