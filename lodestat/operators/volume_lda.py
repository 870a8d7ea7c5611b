"""Group discriminant maps from volumes: linear discriminants in principal components over split halves of subjects, in sample space.

Samples are the labelled times of all subjects, a few thousand by design; voxels may be any number.  All that the discriminants, their
predictions and the reproducibility of their maps need are the products of samples over voxels: one pass over voxels gives that table and the sums
of samples, and each map is a combination of samples.  A second pass writes the combination for each voxel.  No task or driver holds the voxels.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import finite
from ..sources import nifti
from .multivariate import posterior


@dataclass
class Samples:
    """Subject and class (1 or 0) of each sample, products of samples and sums of samples over voxels, and the number of voxels."""

    subject: np.ndarray
    label: np.ndarray
    products: np.ndarray
    sums: np.ndarray
    voxels: int


def sample_rows(voxels: DataFrame, mask: DataFrame, onsets: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((x, y, z, v): the values of all samples, each subject's mean removed; subjects; classes).

    ``voxels`` has (subject, x, y, z, t, value), ``mask`` (x, y, z), ``onsets`` (subject, t, label) with labels -1, 0, 1, where 0 is left out.
    A missing value is 0.
    """
    found = sorted((r.subject, r.t, r.label) for r in onsets.filter("label <> 0").select("subject", "t", "label").distinct().collect())  # the design
    spark, kinds = voxels.sparkSession, [onsets.schema[c].dataType.simpleString() for c in ("subject", "t")]
    places = spark.createDataFrame([(s, t, i) for i, (s, t, _) in enumerate(found)], f"subject {kinds[0]}, t {kinds[1]}, i int")
    rows = voxels.join(mask.select("x", "y", "z").distinct(), ["x", "y", "z"], "left_semi").join(F.broadcast(places), ["subject", "t"])
    cells = rows.groupBy("x", "y", "z", "i").agg(F.avg(finite("value")).alias("v")).groupBy("x", "y", "z").agg(F.map_from_entries(F.collect_list(F.struct("i", F.coalesce("v", F.lit(0.0))))).alias("m"))
    wide = cells.select("x", "y", "z", F.transform(F.sequence(F.lit(0), F.lit(max(len(found) - 1, 0))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))
    subject = np.unique([str(s) for s, _, _ in found], return_inverse=True)[1] if found else np.zeros(0, dtype=int)
    return wide, subject, np.array([int(label == 1) for _, _, label in found], dtype=int)


def _centred(pdf: pd.DataFrame, subject: np.ndarray) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=float) for v in pdf["v"]])
    share = np.eye(subject.max() + 1)[subject]
    return x - (x @ share / share.sum(axis=0)) @ share.T


def sample_products(rows: DataFrame, subject: np.ndarray, label: np.ndarray) -> Samples:
    n = len(subject)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                x = _centred(pdf.iloc[lo : lo + 512], subject)
                part = np.concatenate([(x.T @ x).ravel(), x.sum(axis=0), [float(len(x))]])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"v": [total.tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

    parts = rows.select("v").mapInPandas(run, "v binary").groupBy(F.spark_partition_id() % 8).applyInPandas(added, "v binary").collect()  # eight tables of samples by samples
    total = np.sum([np.frombuffer(bytes(r.v)) for r in parts], axis=0) if parts else np.zeros(n * n + n + 1)
    return Samples(subject, label, total[: n * n].reshape(n, n), total[n * n : -1], int(total[-1]))


def directions(s: Samples, at: np.ndarray, most: int) -> np.ndarray:
    """Discriminants of the samples ``at`` in their first 1..``most`` principal components, of unit pooled spread, as combinations of all samples."""
    g = s.products[np.ix_(at, at)]
    m = len(at)
    centre = np.eye(m) - 1.0 / m
    val, vec = np.linalg.eigh(centre @ g @ centre)
    order = np.argsort(-val)
    val, vec = val[order], vec[:, order]
    kept = int(min(most, (val > 1e-10 * max(val[0], 1e-300)).sum()))
    size = np.sqrt(val[:kept])
    t, y = vec[:, :kept] * size, s.label[at]
    out = np.zeros((kept, len(s.subject)))
    for k in range(1, kept + 1):
        a, b = t[y == 1, :k], t[y != 1, :k]
        within = ((a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) + (b - b.mean(axis=0)).T @ (b - b.mean(axis=0))) / max(m - 2, 1)
        w = np.linalg.lstsq(within, a.mean(axis=0) - b.mean(axis=0), rcond=None)[0]
        w = w / math.sqrt(max(float(w @ within @ w), 1e-300))
        out[k - 1, at] = centre @ (vec[:, :k] / size[:k]) @ w
    return out


def reproducible(s: Samples, a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """(correlation over voxels of two maps, combination of samples that is their reproducible z map)."""
    n = s.voxels
    mean = a @ s.sums / n, b @ s.sums / n
    var = [(u @ s.products @ u - n * m * m) / max(n - 1, 1) for u, m in zip((a, b), mean, strict=True)]
    if n < 3 or not min(var) > 0:
        return -1.0, np.zeros(len(a))
    sa, sb = math.sqrt(var[0]), math.sqrt(var[1])
    r = (a @ s.products @ b - n * mean[0] * mean[1]) / (n - 1) / (sa * sb)
    return float(r), (a / sa + b / sb) / math.sqrt(2) / math.sqrt(1 - r) if r < 1 else np.zeros(len(a))


def predicted(s: Samples, direction: np.ndarray, train: np.ndarray, test: np.ndarray) -> float:
    """Mean posterior probability of the true class of the samples ``test``."""
    score = s.products @ direction
    one, zero = (score[train][s.label[train] == c].mean() for c in (1, 0))
    p = posterior(score[test], one, zero)
    return float(np.where(s.label[test] == 1, p, 1 - p).mean())


def halved(s: Samples, most: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[list[dict], list[np.ndarray]]:
    """(reproducibility and prediction by number of components, mean z maps as combinations of samples) over pairs of halves of samples.

    Halves without both classes are left out.  ``d`` is the distance from perfect reproducibility and prediction, by medians over pairs.
    """
    reference = directions(s, np.arange(len(s.label)), most)
    found: list[list[tuple[float, float, np.ndarray]]] = [[] for _ in range(len(reference))]
    for halves in pairs:
        if any(len(np.unique(s.label[h])) < 2 for h in halves):
            continue
        maps = [directions(s, h, most) for h in halves]
        for k in range(min(len(reference), *map(len, maps))):
            one, two = (m[k] * (1 if m[k] @ s.products @ reference[k] >= 0 else -1) for m in maps)
            r, z = reproducible(s, one, two)
            p = (predicted(s, maps[0][k], halves[0], halves[1]) + predicted(s, maps[1][k], halves[1], halves[0])) / 2
            found[k].append((r, p, z))
    table = [{"k": k + 1, "r": float(np.median([x[0] for x in f])), "p": float(np.median([x[1] for x in f]))} for k, f in enumerate(found) if f]
    for row in table:
        row["d"] = math.hypot(1 - row["r"], 1 - row["p"])
    return table, [np.mean([x[2] for x in f], axis=0) for f in found if f]


def _most(s: Samples, share: float) -> int:
    n = len(s.label)
    return max(1, min(int(share * n / 2), s.voxels, n // 2 - 2)) if n else 0


def split_maps(s: Samples, share: float = 0.5, splits: int = 50, seed: int = 1) -> tuple[list[dict], np.ndarray]:
    """``halved`` over halves of subjects drawn ``splits`` times, and the z map of the least ``d``."""
    rng, members = np.random.default_rng(seed), np.unique(s.subject)
    if len(s.subject) < 4 or len(np.unique(s.label)) < 2:
        return [], np.zeros(len(s.subject))

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _ in range(splits):
            order = rng.permutation(members)
            yield tuple(np.flatnonzero(np.isin(s.subject, h)) for h in (order[: len(order) // 2], order[len(order) // 2 :]))

    table, maps = halved(s, _most(s, share), pairs())
    return table, maps[min(range(len(table)), key=lambda i: (table[i]["d"], i))] if table else np.zeros(len(s.subject))


def mapped(rows: DataFrame, subject: np.ndarray, combination: np.ndarray) -> DataFrame:
    """(x, y, z, value): a combination of samples for each voxel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[["x", "y", "z"]].assign(value=_centred(pdf, subject) @ combination)

    return rows.mapInPandas(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in "xyz") + ", value double")


def group_map(voxels: DataFrame, mask: DataFrame, onsets: DataFrame, share: float = 0.5, splits: int = 50, seed: int = 1) -> tuple[DataFrame, list[dict]]:
    """((x, y, z, value): the discriminant map of a group of subjects, mean z score over split halves; curves by number of components)."""
    rows, subject, label = sample_rows(voxels, mask, onsets)
    if not len(subject):
        return voxels.filter("1 = 0").select("x", "y", "z", F.lit(0.0).alias("value")), []
    rows = rows.persist()
    table, combination = split_maps(sample_products(rows, subject, label), share, splits, seed)
    return mapped(rows, subject, combination), table


def run_files(spark, runs: dict[object, str], mask_path: str, onsets: DataFrame, out_prefix: str | None = None, share: float = 0.5, splits: int = 50, seed: int = 1) -> tuple[DataFrame, list[dict]]:
    """``group_map`` of NIfTI runs by subject (subject: path), within the mask volume; with ``out_prefix`` the map is written as a volume.

    The volume written has the geometry (header, affine) of the first subject's run.
    """
    voxels = _read(spark, runs, "subject")
    mask = nifti.read_volumes(spark, mask_path).filter("value > 0").select("x", "y", "z")
    found, table = group_map(voxels, mask, onsets, share, splits, seed)
    if out_prefix is not None:
        nifti.write_volume(found, nifti.header(spark, next(iter(runs.values()))), f"{out_prefix}_LDA_SPM_group.nii")
    return found, table


def _read(spark, paths: dict[object, str], name: str) -> DataFrame:
    parts = [nifti.read_volumes(spark, path).select(F.lit(key).alias(name), "x", "y", "z", "t", "value") for key, path in paths.items()]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def run_split_files(spark, runs: tuple[str, str], mask_path: str, onsets: DataFrame, out_prefix: str | None = None, share: float = 0.5) -> tuple[DataFrame, list[dict]]:
    """One subject's map from two runs, each a half: (x, y, z, value) and curves; ``onsets`` has (run, t, label) with runs 0 and 1."""
    mask = nifti.read_volumes(spark, mask_path).filter("value > 0").select("x", "y", "z")
    rows, run, label = sample_rows(_read(spark, dict(enumerate(runs)), "subject"), mask, onsets.withColumnRenamed("run", "subject"))
    rows = rows.persist()
    s = sample_products(rows, run, label)
    table, maps = halved(s, _most(s, share), [(np.flatnonzero(run == 0), np.flatnonzero(run == 1))])
    found = mapped(rows, run, maps[min(range(len(table)), key=lambda i: (table[i]["d"], i))] if table else np.zeros(len(run)))
    if out_prefix is not None:
        nifti.write_volume(found, nifti.header(spark, runs[0]), f"{out_prefix}_LDA_SPM.nii")
    return found, table


def run_map_files(spark, maps: dict[object, str], labels: dict[object, int], mask_path: str, out_prefix: str | None = None, share: float = 0.5, splits: int = 50, seed: int = 1) -> tuple[dict[str, DataFrame], list[dict]]:
    """Maps of two groups of subjects, one volume each: the discriminant's z maps at the best ``Dmin``, ``Rmax`` and ``Pmax``, and curves.

    ``labels`` are 0 and 1 by subject.  Halves are drawn within each group.
    """
    mask = nifti.read_volumes(spark, mask_path).filter("value > 0").select("x", "y", "z")
    kind = "bigint" if all(isinstance(k, int) for k in maps) else "string"
    design = spark.createDataFrame([(k, 0, 1 if labels[k] else -1) for k in maps], f"subject {kind}, t int, label int")
    rows, subject, label = sample_rows(_read(spark, maps, "subject"), mask, design)
    rows, subject = rows.persist(), np.zeros_like(subject)  # a subject has one sample: no mean of its own to remove
    s, rng = sample_products(rows, subject, label), np.random.default_rng(seed)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _ in range(splits):
            one, two = [], []
            for g in (0, 1):
                order = rng.permutation(np.flatnonzero(label == g))
                cut = (len(order) + 1) // 2
                one.append(order[:cut])
                two.append(order[cut:])
            yield np.sort(np.concatenate(one)), np.sort(np.concatenate(two))

    table, combos = halved(s, _most(s, share), pairs())
    best = {"Dmin": lambda i: table[i]["d"], "Rmax": lambda i: -table[i]["r"], "Pmax": lambda i: -table[i]["p"]}
    out = {name: mapped(rows, subject, combos[min(range(len(table)), key=lambda i: (key(i), i))] if table else np.zeros(len(label))) for name, key in best.items()}
    if out_prefix is not None:
        head = nifti.header(spark, next(iter(maps.values())))
        for name, found in out.items():
            nifti.write_volume(found, head, f"{out_prefix}_LDA_SPM_group_{name}.nii")
    return out, table


def sample_variates(s: Samples, one: np.ndarray, two: np.ndarray, ks: list[int], share: float = 0.5) -> tuple[list[dict], np.ndarray]:
    """(k, r, p, d) of canonical variates of two halves of samples for each number of components, and the optimum's z map as a combination of samples.

    Features are the first ``share`` of the principal components of all samples, uncentred; variates are found in the components of each half's centred features and
    turned to agree with those of all samples by their class means.  Halves without both classes give nothing.
    """
    use = np.concatenate([one, two])
    if any(len(np.unique(s.label[h])) < 2 for h in (one, two)):
        return [], np.zeros(len(s.label))
    val, vec = np.linalg.eigh(s.products[np.ix_(use, use)])
    order = np.argsort(-val)
    keep = order[: max(1, min(round(len(use) * share), int((val > 1e-10 * max(val.max(), 1e-300)).sum())))]
    size = np.sqrt(val[keep])
    features, y = vec[:, keep] * size, s.label[use]
    basis = np.zeros((len(s.label), len(keep)))
    basis[use] = vec[:, keep] / size

    def fitted(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = features[at] - features[at].mean(axis=0)
        _, spread, axes = np.linalg.svd(c, full_matrices=False)
        return c, axes[: int((spread > 1e-10 * spread[0]).sum())], y[at]

    def variate(c: np.ndarray, axes: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        t = c @ axes[:k].T
        a, b = t[label == 1], t[label != 1]
        within = ((a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) + (b - b.mean(axis=0)).T @ (b - b.mean(axis=0))) / max(len(t) - 2, 1)
        w = np.linalg.lstsq(within, a.mean(axis=0) - b.mean(axis=0), rcond=None)[0]
        dx = axes[:k].T @ w / math.sqrt(max(float(w @ within @ w), 1e-300))
        return dx, np.array([(c[label == g] @ dx).mean() for g in (1, 0)])

    first = np.arange(len(use)) < len(one)
    whole, parts = fitted(np.arange(len(use))), [fitted(np.flatnonzero(h)) for h in (first, ~first)]
    table, best = [], (math.inf, np.zeros(len(s.label)))
    for k in ks:
        if k > min(len(p[1]) for p in (whole, *parts)):
            continue
        _, reference = variate(*whole, k)
        found = []
        for part in parts:
            dx, mean = variate(*part, k)
            turn = -1.0 if ((mean - reference) ** 2).sum() > ((mean + reference) ** 2).sum() else 1.0
            found.append((dx * turn, mean * turn))
        r, z = reproducible(s, *(basis @ dx for dx, _ in found))
        p = []
        for (dx, mean), (c, _, label) in zip(found, parts[::-1], strict=True):
            q = posterior(c @ dx, mean[0], mean[1])
            p.append(float(np.where(label == 1, q, 1 - q).mean()))
        d = math.hypot(1 - r, 1 - np.mean(p))
        table.append({"k": k, "r": r, "p": float(np.mean(p)), "d": d})
        best = min(best, (d, z), key=lambda x: x[0])
    return table, best[1]


def kernel_ridge(s: Samples, at: np.ndarray, count: int = 10, lmax: float = 2.0) -> list[tuple[float, np.ndarray]]:
    """(lambda, combination of samples) of ridge discriminants in their dual form: (K + lambda I)^-1 y for products K of the samples ``at``.

    For fewer samples than voxels; the map is that of (X X' + lambda I)^-1 X y over voxels.  Lambda goes from the inverse of to ``lmax`` times the trace.
    """
    k, y = s.products[np.ix_(at, at)], s.label[at].astype(float)
    if len(np.unique(y)) < 2:
        return []
    y = y / y.sum() - (1 - y) / (1 - y).sum()
    y /= np.linalg.norm(y)
    top = max(lmax * float(np.trace(k)), 1.0 + 1e-9)
    out = []
    for lam in np.exp(np.linspace(-math.log(top), math.log(top), count)):
        a = np.zeros(len(s.label))
        a[at] = np.linalg.solve(k + lam * np.eye(len(k)), y)
        out.append((float(lam), a))
    return out
