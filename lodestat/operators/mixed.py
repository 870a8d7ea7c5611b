"""Linear mixed models over subjects, and bootstraps of subjects, by sums over blocks of a subject.

A subject's rows are reduced to the cross-products of its random-effect columns Z, fixed-effect columns X and response y.  For a relative
covariance L L' of the random effects, X'V^-1 X and its kin are sums over subjects of C - B' (Psi^-1 + Z'Z)^-1 B with B = Z'[X y] and C = [X y]'[X y];
the profiled REML criterion follows from the sums.  Replicates share a pass: each has its own draw counts and its own trial values of L,
and a task gives one array of sums, so what reaches the driver is replicates x trial values x (columns squared), whatever the number of subjects.

Draw counts of a replicate are multinomial over all subjects.  Subjects are dealt to buckets by hash; the count of a bucket comes down a tree of
seeded binomials, and is spread within the bucket by a seeded multinomial.  No task numbers all subjects, and reruns agree.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import finite

#: Subjects of a bucket, about; replicates that are worked on at once.
BUCKET, CHUNK = 256, 50
#: Different Z'Z of subjects, and bytes of replicates' sums by them on the driver, up to which one pass gives all trial values.
CLASSES, HELD_BYTES = 64, 64 << 20
INTERCEPT = "(intercept)"
#: A kernel: (values of subjects, draw counts by replicate, numbers of the replicates, rng of the replicates) -> sums by replicate.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, Callable[[int], np.random.Generator]], np.ndarray]


@dataclass(frozen=True)
class Formula:
    """Response, fixed and random terms, and the subject; '1' is the intercept and 'a:b' a product."""

    y: str
    fixed: tuple[str, ...]
    random: tuple[str, ...]
    subject: str


def formula(text: str) -> Formula:
    """``y ~ a + b + a:b + (1 + a | subject)``; an intercept is meant on both sides unless ``0`` is given."""
    side, found = text.split("~"), re.search(r"\(([^|)]*)\|([^)]*)\)", text)
    if len(side) != 2 or not found:
        raise ValueError(f"a formula like 'y ~ x + (1 | subject)' is needed, not {text!r}")

    def terms(part: str) -> tuple[str, ...]:
        names = [t.strip() for t in part.split("+") if t.strip()]
        return tuple(([] if "0" in names else ["1"]) + [t for t in names if t not in ("0", "1")])

    return Formula(side[0].strip(), terms(side[1].replace(found[0], "")), terms(found[1]), found[2].strip())


def term(name: str) -> Column:
    if name == "1":
        return F.lit(1.0)
    first, *rest = name.split(":")
    out = finite(first.strip())
    for other in rest:
        out = out * finite(other.strip())
    return out


class Resampler:
    """Subjects (``subject``, ``v``: its values) dealt to buckets, whose resampled sums are taken in passes."""

    def __init__(self, subjects: DataFrame, seed: int = 1):
        self.seed = seed
        self.total = subjects.count()
        self.buckets = max(1, -(-self.total // BUCKET))
        dealt = subjects.withColumn("bucket", F.pmod(F.xxhash64("subject"), F.lit(self.buckets)).cast("int"))
        sizes = np.zeros(self.buckets, dtype=np.int64)
        for r in dealt.groupBy("bucket").agg(F.count("*").alias("n")).collect():  # a row for each BUCKET subjects
            sizes[r.bucket] = r.n
        self.upto = np.concatenate([[0], np.cumsum(sizes)])
        tasks = max(int(subjects.sparkSession.conf.get("spark.sql.shuffle.partitions")), subjects.sparkSession.sparkContext.defaultParallelism)
        # Neighbouring buckets share a task, and most of the tree; with a given number of tasks none are put together because their rows are few.
        tasks = min(tasks, self.buckets)
        run = F.floor(F.col("bucket") * F.lit(min(8 * tasks, self.buckets)) / F.lit(self.buckets)).cast("int")
        self.dealt = dealt.repartition(tasks, run).sortWithinPartitions("bucket", "subject").persist()

    def __enter__(self) -> Resampler:
        return self

    def __exit__(self, *_: object) -> None:
        self.dealt.unpersist()

    def sums(self, kernel: Kernel, attempts: Sequence[tuple[int, int]] | None) -> np.ndarray:
        """Replicates x sums of ``kernel``; (replicate, attempt) name the draws, None takes every subject once."""
        seed, upto, buckets, total = self.seed, self.upto, self.buckets, self.total
        plan = list(attempts) if attempts is not None else [(0, 0)]

        def count(rep: int, attempt: int, bucket: int, nodes: dict[tuple[int, int, int, int], int]) -> int:
            lo, hi, left = 0, buckets, total
            while hi - lo > 1:
                mid = (lo + hi) // 2
                size = upto[hi] - upto[lo]
                first = nodes.get((rep, attempt, lo, hi))
                if first is None:
                    first = int(np.random.default_rng([seed, rep, attempt, lo, hi]).binomial(left, (upto[mid] - upto[lo]) / size)) if size else 0
                    nodes[rep, attempt, lo, hi] = first
                lo, hi, left = (lo, mid, first) if bucket < mid else (mid, hi, left - first)
            return left

        def of_bucket(bucket: int, values: np.ndarray, nodes: dict[tuple[int, int, int, int], int]) -> Iterator[tuple[int, np.ndarray]]:
            n = len(values)
            for key in [key for key in nodes if not key[2] <= bucket < key[3]]:  # only the path to a bucket is held
                del nodes[key]
            for lo in range(0, len(plan), CHUNK):
                some = plan[lo : lo + CHUNK]
                if attempts is None:
                    w = np.ones((1, n))
                else:
                    w = np.array([np.random.default_rng([seed, r, a, bucket, buckets, 1]).multinomial(count(r, a, bucket, nodes), np.full(n, 1.0 / n)) for r, a in some], dtype=float)
                yield lo, kernel(values, w, np.arange(lo, lo + len(some)), lambda k, lo=lo: np.random.default_rng([seed, *plan[lo + k], bucket, buckets, 2]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, np.ndarray] = {}
            bucket, rows, nodes = None, [], {}

            def flush() -> None:
                for lo, part in of_bucket(bucket, np.array(rows), nodes):
                    held[lo] = held[lo] + part if lo in held else part

            for pdf in batches:
                for b, v in zip(pdf["bucket"], pdf["v"], strict=True):
                    if b != bucket and rows:
                        flush()
                        rows = []
                    bucket = b
                    rows.append(np.asarray(v, dtype=float))
            if rows:
                flush()
            yield pd.DataFrame({"lo": list(held), "v": [a.tobytes() for a in held.values()]})

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"lo": [int(pdf["lo"].iloc[0])], "v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

        parts = self.dealt.select("bucket", "v").mapInPandas(run, "lo int, v binary").groupBy("lo").applyInPandas(added, "lo int, v binary")
        rows = sorted((r.lo, bytes(r.v)) for r in parts.collect())  # one array for CHUNK replicates
        return np.concatenate([np.frombuffer(v).reshape(min(CHUNK, len(plan) - lo), -1) for lo, v in rows]) if rows else np.zeros((len(plan), 0))


# Blocks


def subject_blocks(df: DataFrame, model: Formula) -> DataFrame:
    """(subject, v): number of rows, then sums of products of [Z X y] over complete rows, upper triangle by rows."""
    names = [*model.random, *model.fixed]
    columns = [*[term(t).alias(f"c{i}") for i, t in enumerate(names)], finite(model.y).alias(f"c{len(names)}")]
    m = len(columns)
    rows = df.select(F.col(model.subject).alias("subject"), *columns).dropna(subset=[f"c{i}" for i in range(m)])
    sums = [F.sum(F.col(f"c{i}") * F.col(f"c{j}")) for i in range(m) for j in range(i, m)]
    return rows.groupBy("subject").agg(F.array(F.count("*").cast("double"), *sums).alias("v"))


def _unfold(v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrices) of subjects."""
    full = np.zeros((len(v), m, m))
    i, j = np.triu_indices(m)
    full[:, i, j] = v[:, 1:]
    full[:, j, i] = v[:, 1:]
    return v[:, 0], full


def _factor(theta: np.ndarray, q: int) -> np.ndarray:
    """Lower triangular factors from (..., q (q + 1) / 2) parameters: logs of the diagonal, then what is below it by rows."""
    out = np.zeros((*theta.shape[:-1], q, q))
    i, j = np.tril_indices(q, -1)
    out[..., np.arange(q), np.arange(q)] = np.exp(np.clip(theta[..., :q], -9, 9))
    out[..., i, j] = theta[..., q:]
    return out


def _weights(a: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L (I + L'AL)^-1 L', log determinant) for every replicate (rows of ``factor``) and subject (rows of ``a``)."""
    q = a.shape[-1]
    if q == 1:
        t = factor[:, None, 0, 0] ** 2
        s = 1 + t * a[None, :, 0, 0]
        return (t / s)[..., None, None], np.log(s)
    inner = np.eye(q) + np.einsum("rki,skl,rlj->rsij", factor, a, factor)
    if q == 2:
        det = inner[..., 0, 0] * inner[..., 1, 1] - inner[..., 0, 1] * inner[..., 1, 0]
        inverse = np.stack([np.stack([inner[..., 1, 1], -inner[..., 0, 1]], -1), np.stack([-inner[..., 1, 0], inner[..., 0, 0]], -1)], -2) / det[..., None, None]
        log = np.log(det)
    else:
        inverse, log = np.linalg.inv(inner), np.linalg.slogdet(inner)[1]
    return np.einsum("rik,rskl,rjl->rsij", factor, inverse, factor), log


def _kernel(q: int, m: int, trials: np.ndarray) -> Kernel:
    """Sums at the trial values (replicates x points x parameters): per point the triangle of [X y]'V^-1[X y], log determinant and rows."""
    k = m - q
    up = np.triu_indices(k)

    def run(values: np.ndarray, w: np.ndarray, reps: np.ndarray, _: object) -> np.ndarray:
        n, full = _unfold(values, m)
        a, b, c = full[:, :q, :q], full[:, :q, q:], full[:, q:, q:][:, up[0], up[1]]
        products = [[(b[:, i, :, None] * b[:, j, None, :])[:, up[0], up[1]] for j in range(q)] for i in range(q)]
        plain, rows = w @ c, w @ n
        out = np.empty((len(w), trials.shape[1], len(up[0]) + 2))
        for p in range(trials.shape[1]):
            g, log = _weights(a, _factor(trials[reps, p], q))
            out[:, p, :-2] = plain
            for i in range(q):
                for j in range(q):
                    out[:, p, :-2] -= (w * g[..., i, j]) @ products[i][j]
            out[:, p, -2] = (w * log).sum(axis=1)
            out[:, p, -1] = rows
        return out.reshape(len(w), -1)

    return run


class ClassSums:
    """Sums of ``_kernel`` at any trial values from one pass over the draws, where the subjects have few different Z'Z.

    Subjects of the same Z'Z have the same weights at any trial value, so a replicate's numbers of drawn subjects and products by Z'Z, and [X y]'[X y] and rows
    over all, are enough.  ``of`` gives None where there are more than ``CLASSES``.
    """

    def __init__(self, sampler: Resampler, q: int, m: int, classes: np.ndarray):
        self.sampler, self.q, self.k, self.classes, self.held = sampler, q, m - q, classes, {}
        up, known = np.triu_indices(m - q), {c.tobytes(): i for i, c in enumerate(classes)}
        self.a = np.zeros((len(classes), q, q))
        i, j = np.triu_indices(q)
        self.a[:, i, j] = self.a[:, j, i] = classes

        def run(values: np.ndarray, w: np.ndarray, *_: object) -> np.ndarray:
            n, full = _unfold(values, m)
            b, c = full[:, :q, q:], full[:, q:, q:][:, up[0], up[1]]
            products = (b[:, :, None, :, None] * b[:, None, :, None, :])[..., up[0], up[1]].reshape(len(n), -1)
            of = np.array([known[v.tobytes()] for v in full[:, i, j]])
            out = np.zeros((len(w), len(known), 1 + products.shape[1]))
            for at in np.unique(of):
                own = of == at
                out[:, at] = np.column_stack([w[:, own].sum(axis=1), w[:, own] @ products[own]])
            return np.column_stack([w @ c, w @ n, out.reshape(len(w), -1)])

        self.kernel: Kernel = run

    @classmethod
    def of(cls, sampler: Resampler, q: int, m: int, reps: int) -> ClassSums | None:
        at = np.cumsum([1, *range(m, m - q, -1)])[:q]  # where the rows of the triangle start; the count of rows is before them
        cells = [F.col("v")[int(at[i]) + j - i] for i in range(q) for j in range(i, q)]
        width = 1 + q * q * (m - q) * (m - q + 1) // 2
        most = min(CLASSES, HELD_BYTES // (8 * reps * width))
        found = sampler.dealt.select(F.array(*cells).alias("z")).distinct().limit(most + 1).collect() if most else []
        return cls(sampler, q, m, np.array(sorted(r.z for r in found), dtype=float)) if 0 < len(found) <= most else None

    def sums(self, trials: np.ndarray, attempts: Sequence[tuple[int, int]] | None) -> np.ndarray:
        """Replicates x points x sums; draws that were not met before are gone over in one pass."""
        keys: list = [None] if attempts is None else list(attempts)
        new = [key for key in keys if key not in self.held]
        if new:
            self.held.update(zip(new, self.sampler.sums(self.kernel, None if attempts is None else new), strict=True))
        every, size = np.array([self.held[key] for key in keys]), self.k * (self.k + 1) // 2
        own = every[:, size + 1 :].reshape(len(every), len(self.classes), -1)
        out = np.empty((len(every), trials.shape[1], size + 2))
        for p in range(trials.shape[1]):
            g, log = _weights(self.a, _factor(trials[:, p], self.q))
            taken = np.einsum("rcx,rcxs->rs", g.reshape(*g.shape[:2], -1), own[:, :, 1:].reshape(*own.shape[:2], self.q**2, size))
            out[:, p, :-2], out[:, p, -2], out[:, p, -1] = every[:, :size] - taken, (own[:, :, 0] * log).sum(axis=1), every[:, size]
        return out


Trials = Callable[[np.ndarray, "Sequence[tuple[int, int]] | None"], np.ndarray]


def _trials(sampler: Resampler, model: Formula, reps: int) -> Trials:
    """Sums by replicate at trial values: from one pass where the subjects' Z'Z are few, else a pass each time."""
    q, m = len(model.random), len(model.random) + len(model.fixed) + 1
    few = ClassSums.of(sampler, q, m, reps)
    if few is not None:
        return few.sums
    return lambda trials, attempts: sampler.sums(_kernel(q, m, trials), attempts).reshape(*trials.shape[:2], -1)


@dataclass
class Fits:
    """Fits by replicate: coefficients and their covariance, residual variance, relative factors of the random effects, criterion."""

    beta: np.ndarray
    cov: np.ndarray
    residual: np.ndarray
    factor: np.ndarray
    criterion: np.ndarray
    condition: np.ndarray


def _criterion(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(REML criterion, coefficients, residual variance, X'V^-1X) from sums (..., triangle + 2); columns without rank get the least norm."""
    full = np.zeros((*sums.shape[:-1], k, k))
    i, j = np.triu_indices(k)
    full[..., i, j] = sums[..., :-2]
    full[..., j, i] = sums[..., :-2]
    xx, xy, yy = full[..., :-1, :-1], full[..., :-1, -1], full[..., -1, -1]
    beta = np.einsum("...ij,...j->...i", np.linalg.pinv(xx, rcond=1e-12, hermitian=True), xy)
    rank = k - 1
    free = np.maximum(sums[..., -1] - rank, 1.0)
    rss = np.maximum(yy - np.einsum("...i,...i->...", beta, xy), 1e-300)
    eig = np.linalg.eigvalsh(xx)
    logdet = np.log(np.maximum(eig, 1e-300)).sum(axis=-1)
    return free * np.log(rss / free) + sums[..., -2] + logdet, beta, rss / free, xx


def _stencil(d: int) -> np.ndarray:
    """Centre, both ways along each axis, and the diagonals of a quadratic."""
    eye = np.eye(d)
    return np.array([np.zeros(d), *eye, *-eye, *[eye[i] + eye[j] for i in range(d) for j in range(i + 1, d)]])


def _towards(f: np.ndarray, d: int) -> np.ndarray:
    """Step, in units of the stencil, to the least of the quadratic through its values; at most two units, to the best point where it has none."""
    f0, up, down = f[0], f[1 : d + 1], f[d + 1 : 2 * d + 1]
    g, h = (up - down) / 2, np.diag(up - 2 * f0 + down)
    for n, (i, j) in enumerate((i, j) for i in range(d) for j in range(i + 1, d)):
        h[i, j] = h[j, i] = f[2 * d + 1 + n] - up[i] - up[j] + f0
    best = _stencil(d)[np.argmin(f)]
    if not np.isfinite(f).all() or np.linalg.eigvalsh(h).min() <= 1e-9 * max(abs(f0), 1.0) * 1e-3:
        return best
    step = -np.linalg.solve(h, g)
    size = np.linalg.norm(step)
    return step if size <= 2 else step * 2 / size


def fit_blocks(sampler: Resampler, model: Formula, attempts: Sequence[tuple[int, int]] | None = None, start: np.ndarray | None = None, rounds: int = 20, width: float = 1.0, least: float = 0.02, trials_of: Trials | None = None) -> Fits:
    """REML fits of the whole sample, or of replicates, at trial values around ``start`` and the last ones.

    A fit's stencil shrinks once its step stays within it, until it is below ``least`` or ``rounds`` are over.
    """
    q, m = len(model.random), len(model.random) + len(model.fixed) + 1
    d, k, reps = q * (q + 1) // 2, m - q, 1 if attempts is None else len(attempts)
    trials_of = trials_of or _trials(sampler, model, reps)
    if start is None:  # a coarse grid of equal diagonals first
        grid = np.linspace(-5, 3, 17)
        trials = np.zeros((reps, len(grid), d))
        trials[:, :, :q] = grid[None, :, None]
        sums = trials_of(trials, attempts)
        start = trials[np.arange(reps), _criterion(sums, k)[0].argmin(axis=1)]
    centre, widths = np.broadcast_to(start, (reps, d)).copy(), np.full(reps, width)
    for _ in range(rounds):
        open_ = np.flatnonzero(widths >= least)
        if not len(open_):
            break
        trials = centre[open_, None, :] + widths[open_, None, None] * _stencil(d)[None]
        some = None if attempts is None else [attempts[i] for i in open_]
        value = _criterion(trials_of(trials, some), k)[0]
        steps = np.array([_towards(f, d) for f in value])
        before = centre[open_].copy()
        centre[open_] += widths[open_, None] * steps
        centre[:, :q] = np.clip(centre[:, :q], -9, 9)
        near = np.abs(centre[open_] - before).max(axis=1) <= 0.8 * widths[open_]
        widths[open_[near]] *= 0.35
    sums = trials_of(np.stack([centre, np.concatenate([np.full((reps, q), -50.0), np.zeros((reps, d - q))], axis=1)], axis=1), attempts)
    value, beta, residual, xx = _criterion(sums, k)
    # The second point has next to no random effects: its X'X tells how well the design is conditioned.
    eig = np.linalg.eigvalsh(xx[:, 1])
    condition = np.sqrt(eig[:, -1] / np.maximum(eig[:, 0], 1e-300))
    return Fits(beta[:, 0], np.linalg.pinv(xx[:, 0], hermitian=True) * residual[:, 0, None, None], residual[:, 0], _factor(centre, q), value[:, 0], condition)


def _conditions(trials_of: Trials, model: Formula, attempts: Sequence[tuple[int, int]]) -> np.ndarray:
    """Condition numbers of the fixed design of replicates."""
    q, m = len(model.random), len(model.random) + len(model.fixed) + 1
    k = m - q
    trials = np.zeros((len(attempts), 1, q * (q + 1) // 2))
    trials[..., :q] = -50.0
    eig = np.linalg.eigvalsh(_criterion(trials_of(trials, attempts), k)[3][:, 0])
    return np.sqrt(eig[:, -1] / np.maximum(eig[:, 0], 1e-300))


def _names(model: Formula) -> list[str]:
    return [INTERCEPT if t == "1" else t for t in model.fixed]


def fit(df: DataFrame, model: str | Formula) -> DataFrame:
    """(term, estimate, se, t) of the fixed effects, then (``var(a,b)``, estimate) of the random effects and ``residual``, by REML.

    Rows with a missing value in any term are left out.  Without complete rows the result is empty.
    """
    spec = formula(model) if isinstance(model, str) else model
    with Resampler(subject_blocks(df, spec)) as sampler:
        rows: list[tuple[str, float, float | None, float | None]] = []
        if sampler.total:
            found = fit_blocks(sampler, spec, least=0.002)
            se = np.sqrt(np.diagonal(found.cov[0]))
            rows = [(n, float(b), float(s), float(b / s) if s > 0 else None) for n, b, s in zip(_names(spec), found.beta[0], se, strict=True)]
            psi = found.factor[0] @ found.factor[0].T * found.residual[0]
            random = [INTERCEPT if t == "1" else t for t in spec.random]
            rows += [(f"var({random[i]},{random[j]})", float(psi[i, j]), None, None) for i in range(len(random)) for j in range(i, len(random))]
            rows.append(("residual", float(found.residual[0]), None, None))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, t double")


def _stable(trials_of: Trials, model: Formula, reps: int, worst: float, most: int) -> list[tuple[int, int]]:
    """(replicate, attempt): draws whose design is not worse conditioned than ``worst``, redrawn ``most`` times at most."""
    attempts = [(r, 0) for r in range(reps)]
    for _ in range(most + 1):
        bad = np.flatnonzero(~(_conditions(trials_of, model, attempts) <= worst))
        if not len(bad):
            return attempts
        attempts = [(r, a + 1) if k in set(bad.tolist()) else (r, a) for k, (r, a) in enumerate(attempts)]
    raise ValueError(f"{len(bad)} of {reps} replicates are ill-conditioned after {most} redraws: the model is prone to collapse")


def bootstrap(df: DataFrame, model: str | Formula, reps: int = 1000, contrasts: Sequence[tuple[str, str]] = (), seed: int = 1, worst: float = 500.0, redraws: int = 10) -> DataFrame:
    """(rep, term, stat): fixed effects on resampled subjects, and ``b - a`` for each contrast (a, b) of two terms.

    A replicate whose design has a condition number above ``worst`` is drawn anew, ``redraws`` times at most; then the model is refused.
    Each drawn copy of a subject is a subject of its own.
    """
    spec = formula(model) if isinstance(model, str) else model
    names = _names(spec)
    pairs = [(names.index(a), names.index(b)) for a, b in contrasts]
    terms = [*names, *[f"{b} - {a}" for a, b in contrasts]]
    with Resampler(subject_blocks(df, spec), seed) as sampler:
        stats = np.zeros((0, len(terms)))
        if sampler.total:
            whole = fit_blocks(sampler, spec)
            at = _parameters(whole.factor[0])
            trials_of = _trials(sampler, spec, reps)
            beta = fit_blocks(sampler, spec, _stable(trials_of, spec, reps, worst, redraws), at, width=0.7, trials_of=trials_of).beta
            stats = np.column_stack([beta, *[beta[:, b] - beta[:, a] for a, b in pairs]])
    return df.sparkSession.createDataFrame(pd.DataFrame({"rep": np.repeat(np.arange(len(stats)), len(terms)), "term": terms * len(stats), "stat": stats.ravel()}).astype({"rep": "int32", "term": object, "stat": float}), "rep int, term string, stat double")


def _parameters(factor: np.ndarray) -> np.ndarray:
    i, j = np.tril_indices(len(factor), -1)
    return np.concatenate([np.log(np.diagonal(factor)), factor[i, j]])


# Time courses and comparisons with controls


HOW = ("listwise", "pairwise", "imputed")


def _courses(df: DataFrame, spec: Formula, time: str, times: Sequence[object], covariates: Sequence[str]) -> tuple[DataFrame, Fits]:
    """(subject, v): responses by time (NaN where missing), their fixed parts, random columns, then covariates; and the fit."""
    with Resampler(subject_blocks(df, spec)) as sampler:
        found = fit_blocks(sampler, spec)
    fixed = sum((F.lit(float(b)) * term(t) for b, t in zip(found.beta[0], spec.fixed, strict=True)), F.lit(0.0))
    cell = F.struct(finite(spec.y).alias("y"), fixed.alias("f"), F.array(*[term(t) for t in spec.random]).alias("z"))
    nan = F.lit(float("nan"))
    each = [F.max(F.when(F.col(time) == F.lit(t), cell)).alias(f"t{i}") for i, t in enumerate(times)]
    wide = df.groupBy(F.col(spec.subject).alias("subject")).agg(*each, *[F.first(finite(c), ignorenulls=True).alias(f"x{i}") for i, c in enumerate(covariates)])
    values = [F.coalesce(F.col(f"t{i}.{p}"), nan) for p in "yf" for i in range(len(times))]
    values += [F.coalesce(F.element_at(F.col(f"t{i}.z"), k + 1), nan) for i in range(len(times)) for k in range(len(spec.random))]
    return wide.select("subject", F.array(*values, *[F.coalesce(f"x{i}", nan) for i in range(len(covariates))]).alias("v")), found


def _filled(v: np.ndarray, w: np.ndarray, rng: Callable[[int], np.random.Generator], times: int, q: int, psi: np.ndarray, residual: float, fills: int) -> np.ndarray:
    """Sums over the copies of each subject (replicates x subjects x times), where a missing cell has the mean of ``fills`` responses drawn from the model.

    A draw has the subject's random effects, shared by its cells, and a residual of its own; the copies' residuals are drawn as one.
    """
    y, f = v[:, :times], v[:, times : 2 * times]
    z = np.nan_to_num(v[:, 2 * times : 2 * times + times * q].reshape(len(v), times, q))
    root = np.linalg.cholesky(psi + 1e-300 * np.eye(q)) if np.all(np.diagonal(psi) > 0) else np.zeros((q, q))
    out = np.empty((len(w), len(v), times))
    for r in range(len(w)):
        g = rng(r)
        effect = np.einsum("stq,sq->st", z, g.normal(size=(len(v), q)) @ root.T)
        noise = g.normal(size=(len(v), times)) * np.sqrt(w[r][:, None] * residual / fills)
        out[r] = np.where(np.isfinite(y), w[r][:, None] * np.nan_to_num(y), w[r][:, None] * (f + effect) + noise)
    return out


def time_courses(df: DataFrame, model: str | Formula, time: str, reps: int = 1000, seed: int = 1, fills: int = 10) -> DataFrame:
    """(rep, how, time, mean, change): means by time and changes from the first time on resampled subjects.

    ``how`` is listwise (subjects without a missing time), pairwise (all values of a time; both of a change) or imputed (missing responses drawn from
    the mixed model, the mean of ``fills``).  ``df`` has a row for every subject and time, with null responses where missing.
    """
    spec = formula(model) if isinstance(model, str) else model
    times = sorted(r[0] for r in df.select(time).distinct().collect() if r[0] is not None)  # the time points of the design
    rows, found = _courses(df, spec, time, times, ())
    t, q = len(times), len(spec.random)
    psi, residual = found.factor[0] @ found.factor[0].T * found.residual[0], float(found.residual[0])

    def kernel(v: np.ndarray, w: np.ndarray, _: np.ndarray, rng: Callable[[int], np.random.Generator]) -> np.ndarray:
        y = v[:, :t]
        seen = np.isfinite(y)
        whole, y0 = seen.all(axis=1).astype(float), np.nan_to_num(y)
        both = seen & seen[:, :1]
        change = np.where(both, y0 - y0[:, :1], 0.0)
        filled = _filled(v, w, rng, t, q, psi, residual, fills)
        known = np.isfinite(filled).all(axis=(0, 2))
        total = np.where(known[None, :, None], filled, 0.0).sum(axis=1)
        return np.column_stack([w @ whole, w @ (y0 * whole[:, None]), w @ seen, w @ y0, w @ both, w @ change, w @ known, total])

    with Resampler(rows, seed) as sampler:
        s = sampler.sums(kernel, [(r, 0) for r in range(reps)])
    with np.errstate(all="ignore"):
        n1, s1, n2, s2, n3, s3, n4, s4 = np.split(s, np.cumsum([1, t, t, t, t, t, 1]), axis=1)
        mean = [s1 / n1, s2 / n2, s4 / n4]
        change = [mean[0] - mean[0][:, :1], s3 / n3, mean[2] - mean[2][:, :1]]
    out = [pd.DataFrame({"rep": np.repeat(np.arange(reps), t), "how": how, "time": times * reps, "mean": m.ravel(), "change": c.ravel()}) for how, m, c in zip(HOW, mean, change, strict=True)]
    kind = df.schema[time].dataType.simpleString()
    return df.sparkSession.createDataFrame(pd.concat(out), f"rep int, how string, time {kind}, mean double, change double").select("rep", "how", "time", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("mean", "change")])


def against_controls(df: DataFrame, controls: DataFrame, model: str | Formula, time: str, covariates: Sequence[str] = (), reps: int = 1000, seed: int = 1, fills: int = 10) -> DataFrame:
    """(rep, how, time, diff): subjects less controls at each time, resampled separately, adjusted for covariates by least squares.

    ``controls`` has one row a control with the response and the covariates.  ``how`` as in ``time_courses``.
    """
    spec = formula(model) if isinstance(model, str) else model
    times = sorted(r[0] for r in df.select(time).distinct().collect() if r[0] is not None)
    rows, found = _courses(df, spec, time, times, covariates)
    t, q, k = len(times), len(spec.random), len(covariates) + 1
    psi, residual = found.factor[0] @ found.factor[0].T * found.residual[0], float(found.residual[0])

    def design(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.column_stack([np.ones(len(v)), v[:, v.shape[1] - k + 1 :]])
        good = np.isfinite(x).all(axis=1)
        return np.where(good[:, None], x, 0.0), good

    def kernel(v: np.ndarray, w: np.ndarray, _: np.ndarray, rng: Callable[[int], np.random.Generator]) -> np.ndarray:
        x, good = design(v)
        y = v[:, :t]
        seen = np.isfinite(y) & good[:, None]
        products = (x[:, :, None] * x[:, None, :]).reshape(len(v), -1)
        filled = _filled(v, w, rng, t, q, psi, residual, fills)
        known = np.isfinite(filled).all(axis=(0, 2)) & good
        out = []
        for mask in (np.repeat(seen.all(axis=1)[:, None], t, axis=1), seen):
            out += [np.column_stack([w @ (products * mask[:, i, None]), w @ (x * (np.nan_to_num(y[:, i]) * mask[:, i])[:, None])]) for i in range(t)]
        for i in range(t):
            out.append(np.column_stack([w @ (products * known[:, None]), np.where(known[None], filled[:, :, i], 0.0) @ x]))
        return np.column_stack(out)

    def of_controls(v: np.ndarray, w: np.ndarray, *_: object) -> np.ndarray:
        x, good = design(v)
        mask = (good & np.isfinite(v[:, 0])).astype(float)
        return np.column_stack([w @ ((x[:, :, None] * x[:, None, :]).reshape(len(v), -1) * mask[:, None]), w @ (x * (np.nan_to_num(v[:, 0]) * mask)[:, None])])

    attempts = [(r, 0) for r in range(reps)]
    nan = F.lit(float("nan"))
    single = controls.select(F.xxhash64(*controls.columns).alias("subject"), F.array(F.coalesce(finite(spec.y), nan), *[F.coalesce(finite(c), nan) for c in covariates]).alias("v"))
    with Resampler(rows, seed) as sampler:
        ours = sampler.sums(kernel, attempts).reshape(reps, 3, t, k * k + k)
    with Resampler(single, seed + 1) as sampler:
        theirs = sampler.sums(of_controls, attempts).reshape(reps, 1, 1, k * k + k)
    both = ours + theirs
    xx, xy = np.zeros((reps, 3, t, k + 1, k + 1)), np.zeros((reps, 3, t, k + 1))
    xx[..., :k, :k] = both[..., : k * k].reshape(reps, 3, t, k, k)
    xx[..., k, :k] = xx[..., :k, k] = ours[..., :k]  # the first row of a subject's products: sums of its columns
    xx[..., k, k] = ours[..., 0]
    xy[..., :k], xy[..., k] = both[..., k * k :], ours[..., k * k]
    diff = np.einsum("...ij,...j->...i", np.linalg.pinv(xx, hermitian=True), xy)[..., k]
    diff[(ours[..., 0] == 0) | (theirs[..., 0] == 0)] = np.nan
    out = [pd.DataFrame({"rep": np.repeat(np.arange(reps), t), "how": how, "time": times * reps, "diff": diff[:, h].ravel()}) for h, how in enumerate(HOW)]
    kind = df.schema[time].dataType.simpleString()
    return df.sparkSession.createDataFrame(pd.concat(out), f"rep int, how string, time {kind}, diff double").withColumn("diff", F.when(~F.isnan("diff"), F.col("diff")))
