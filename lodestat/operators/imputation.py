"""Missing-data imputation over long (row_id, col_id, value) frames, null where missing.

Cell-wise models are window functions.  Models of whole matrices run as one grouped map for each matrix, keyed by ``by``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import finite, with_totals
from .ecm import ecm_array
from .resample import hash_int


def impute_mean(df: DataFrame, col: str, value: str, out: str = "filled") -> DataFrame:
    v = finite(value)
    return df.withColumn(out, F.coalesce(v, F.avg(v).over(Window.partitionBy(col))))


def impute_median(df: DataFrame, col: str, value: str, out: str = "filled") -> DataFrame:
    v = finite(value)
    mid = df.groupBy(col).agg(F.median(v).alias("_mid"))
    return df.join(mid, col).withColumn(out, F.coalesce(v, F.col("_mid"))).drop("_mid")


def impute_normal(df: DataFrame, row: str, col: str, value: str, seed: int = 1, out: str = "filled") -> DataFrame:
    """Missing cells drawn from their column's normal distribution, by hashed Box-Muller draws."""
    v = finite(value)
    w = Window.partitionBy(col)
    u1 = (hash_int(row, col, seed) + 1) / 4294967297.0
    u2 = hash_int(row, col, seed + 1) / 4294967296.0
    z = F.sqrt(-2 * F.ln(u1)) * F.cos(2 * math.pi * u2)
    return df.withColumn(out, F.coalesce(v, F.avg(v).over(w) + F.coalesce(F.stddev_samp(v).over(w), F.lit(0.0)) * z))


def complete_rows(df: DataFrame, row: str, value: str) -> DataFrame:
    """Listwise deletion: the rows without a missing cell."""
    return df.withColumn("_bad", F.max(finite(value).isNull().cast("int")).over(Window.partitionBy(row))).filter("_bad = 0").drop("_bad")


def column_means(df: DataFrame, row: str, col: str, value: str, how: str = "pairwise") -> DataFrame:
    """(col, n, mean) over available cells, or over complete rows if ``how`` is 'listwise'."""
    rows = complete_rows(df, row, value) if how == "listwise" else df
    return rows.groupBy(col).agg(F.count(finite(value)).alias("n"), F.avg(finite(value)).alias("mean"))


def ecm_start(df: DataFrame, row: str, col: str, value: str, method: str = "twostage") -> DataFrame:
    """(i, j, mean_i, cov): start values for ECM; divisor n.

    'twostage': column means and the covariance of deviations with missing ones as 0; 'diagonal': variances only;
    'nanskip': both from complete rows.
    """
    rows = complete_rows(df, row, value) if method == "nanskip" else df
    dev = rows.withColumn("_m", F.avg(finite(value)).over(Window.partitionBy(col))).select(F.col(row).alias("r"), F.col(col).alias("c"), "_m", F.coalesce(finite(value) - F.col("_m"), F.lit(0.0)).alias("d"))
    if method == "diagonal":
        spread = rows.groupBy(F.col(col).alias("i")).agg(F.avg(finite(value)).alias("mean_i"), F.var_pop(finite(value)).alias("cov"))
        return spread.select("i", F.col("i").alias("j"), "mean_i", "cov")
    a = dev.select("r", F.col("c").alias("i"), F.col("_m").alias("mean_i"), F.col("d").alias("a"))
    b = dev.select("r", F.col("c").alias("j"), F.col("d").alias("b"))
    return a.join(b, "r").groupBy("i", "j").agg(F.max("mean_i").alias("mean_i"), F.avg(F.col("a") * F.col("b")).alias("cov"))


def additive(df: DataFrame, row: str, col: str, value: str, rounds: int = 2, out: str = "filled") -> DataFrame:
    """Bias-only factorisation: grand mean plus row and column effects by alternating means; fills missing cells."""
    v = finite(value)
    rows = with_totals(df.withColumn("_v", v), {"_mu": F.avg("_v")}).withColumns({"_a": F.lit(0.0), "_b": F.lit(0.0)})
    for _ in range(rounds):
        rows = rows.withColumn("_a", F.avg(F.col("_v") - F.col("_mu") - F.col("_b")).over(Window.partitionBy(row)))
        rows = rows.withColumn("_b", F.avg(F.col("_v") - F.col("_mu") - F.col("_a")).over(Window.partitionBy(col)))
    fit = F.col("_mu") + F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))
    return rows.withColumn(out, F.coalesce("_v", fit)).drop("_v", "_mu", "_a", "_b")


def nearest_row(df: DataFrame, row: str, col: str, value: str, out: str = "filled") -> DataFrame:
    """Missing cells taken from the nearest row that has them: least mean squared difference over common columns."""
    v = df.select(F.col(row).alias("r"), F.col(col).alias("c"), finite(value).alias("v"))
    seen, holes = v.dropna(subset=["v"]), v.filter("v IS NULL").select("r", "c")
    a, b = seen.select("r", "c", F.col("v").alias("va")), seen.select(F.col("r").alias("o"), "c", F.col("v").alias("vb"))
    wanting = a.join(holes.select("r").distinct(), "r", "left_semi")
    near = wanting.join(b, "c").filter("r <> o").groupBy("r", "o").agg(F.avg((F.col("va") - F.col("vb")) ** 2).alias("d"))
    given = holes.join(b, "c").join(near, ["r", "o"]).groupBy("r", "c").agg(F.min_by("vb", F.struct("d", "o")).alias("g"))
    return df.join(given.select(F.col("r").alias(row), F.col("c").alias(col), "g"), [row, col], "left").withColumn(out, F.coalesce(finite(value), F.col("g"))).drop("g")


def soft_impute(x: np.ndarray, lam: float, rounds: int = 100, tol: float = 1e-6, start: np.ndarray | None = None) -> np.ndarray:
    """Fill by soft-thresholded singular values (Mazumder et al., 2010); observed cells stay."""
    seen = np.isfinite(x)
    z = np.where(seen, x, 0.0 if start is None else start)
    for _ in range(rounds):
        u, s, vt = np.linalg.svd(z, full_matrices=False)
        low = (u * np.maximum(s - lam, 0)) @ vt
        new = np.where(seen, x, low)
        if np.sum((new - z) ** 2) < tol * max(np.sum(z**2), 1e-300):
            return new
        z = new
    return z


def hard_impute(x: np.ndarray, rank: int, rounds: int = 100, tol: float = 1e-6) -> np.ndarray:
    seen = np.isfinite(x)
    z = np.where(seen, x, 0.0)
    for _ in range(rounds):
        u, s, vt = np.linalg.svd(z, full_matrices=False)
        new = np.where(seen, x, (u[:, :rank] * s[:rank]) @ vt[:rank])
        if np.sum((new - z) ** 2) < tol * max(np.sum(z**2), 1e-300):
            return new
        z = new
    return z


def lambda_path(x: np.ndarray, count: int = 100) -> np.ndarray:
    top = np.linalg.svd(np.where(np.isfinite(x), x, 0.0), compute_uv=False)[0]
    return np.exp(np.linspace(math.log(max(top, 1e-12)), math.log(max(top, 1e-12) / 100), count))


def impute_svd(x: np.ndarray, kind: str = "soft", count: int = 100, rank: int = 1) -> list[tuple[float, np.ndarray]]:
    """(lambda or rank, filled matrix) along a path, on columns with mean 0 and spread 1, restored afterwards."""
    mean, sd = np.nanmean(x, axis=0), np.nanstd(x, axis=0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
    mean, sd = np.nan_to_num(mean), np.where(np.nan_to_num(sd) > 0, np.nan_to_num(sd), 1.0)
    z = (x - mean) / sd
    if kind == "mean":
        return [(0.0, np.where(np.isfinite(z), z, 0.0) * sd + mean)]
    if kind == "hard":
        return [(float(r), hard_impute(z, r) * sd + mean) for r in range(1, rank + 1)]
    out, start = [], None
    for lam in lambda_path(z, count):
        start = soft_impute(z, lam, start=start)
        out.append((float(lam), start * sd + mean))
    return out


def ecm_mle(x: np.ndarray, rounds: int = 50, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(mean, covariance, negative log-likelihoods) of an incomplete multivariate normal, one matrix in memory; ``ecm.ecm_rows`` is the form for tables."""
    return ecm_array(x, rounds, tol)


def matfac(x: np.ndarray, rank: int, lam: float = 1e-3, rounds: int = 100, tries: int = 3, seed: int = 1, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filled, row factors, column factors) by regularised alternating least squares about additive means; best of some starts."""
    seen = np.isfinite(x)
    mu = np.nanmean(x)
    a = np.nan_to_num(np.nanmean(np.where(seen, x - mu, np.nan), axis=1))
    b = np.nan_to_num(np.nanmean(np.where(seen, x - mu - a[:, None], np.nan), axis=0))
    base = mu + a[:, None] + b[None, :]
    if rank == 0:
        return np.where(seen, x, base), np.zeros((len(x), 0)), np.zeros((x.shape[1], 0))
    r, best = np.where(seen, x - base, 0.0), None
    for t in range(tries):
        rng = np.random.default_rng(seed + t)
        v = rng.normal(size=(x.shape[1], rank))
        old = math.inf
        for _ in range(rounds):
            u = np.array([np.linalg.solve(v[s].T @ v[s] + lam * np.eye(rank), v[s].T @ y[s]) for y, s in zip(r, seen, strict=True)])
            v = np.array([np.linalg.solve(u[s].T @ u[s] + lam * np.eye(rank), u[s].T @ y[s]) for y, s in zip(r.T, seen.T, strict=True)])
            err = float(((r - u @ v.T)[seen] ** 2).sum())
            if old - err < tol * max(err, 1e-12):
                break
            old = err
        if best is None or err < best[0]:
            best = err, u, v
    return np.where(seen, x, base + best[1] @ best[2].T), best[1], best[2]


def _ridge(x: np.ndarray, y: np.ndarray, lam: float) -> Callable[[np.ndarray], np.ndarray]:
    a = np.column_stack([np.ones(len(x)), x])
    b = np.linalg.solve(a.T @ a + lam * np.eye(a.shape[1]), a.T @ y)
    return lambda z: np.append(1.0, z) @ b


def pls_fit(x: np.ndarray, y: np.ndarray, k: int) -> Callable[[np.ndarray], np.ndarray]:
    """Predictor by k components of the singular vectors of X'Y, deflating both sides."""
    mx, my = x.mean(axis=0), y.mean(axis=0)
    sx, sy = (np.where((s := v.std(axis=0, ddof=1)) > 0, s, 1.0) for v in (x, y))
    a, b = (x - mx) / sx, (y - my) / sy
    w, p, q = [], [], []
    for _ in range(min(k, x.shape[1], len(x) - 1)):
        u, s, _ = np.linalg.svd(a.T @ b, full_matrices=False)
        if s[0] < 1e-12:
            break
        t = a @ u[:, 0]
        load, out = a.T @ t / (t @ t), b.T @ t / (t @ t)
        a, b = a - np.outer(t, load), b - np.outer(t, out)
        w.append(u[:, 0])
        p.append(load)
        q.append(out)
    if not w:
        return lambda z: my
    w_, p_, q_ = np.array(w).T, np.array(p).T, np.array(q)
    coef = w_ @ np.linalg.solve(p_.T @ w_, q_)
    return lambda z: (z - mx) / sx @ coef * sy + my


def impute_by_rows(x: np.ndarray, fit: Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]], least: int = 3) -> np.ndarray:
    """Fill each incomplete row by models trained on rows that have its missing cells.

    Training rows are grouped by which of the row's present cells they have too; each group of ``least`` rows or more gives a
    prediction, weighted by its size less 1.
    """
    out, seen = x.copy(), np.isfinite(x)
    for i in np.flatnonzero(~seen.all(axis=1)):
        holes, have = ~seen[i], seen[i]
        rows = np.flatnonzero(seen[:, holes].all(axis=1))
        rows = rows[rows != i]
        groups: dict[bytes, list[int]] = {}
        for r in rows:
            groups.setdefault((seen[r] & have).tobytes(), []).append(r)
        total, weight = np.zeros(holes.sum()), 0.0
        for key, members in groups.items():
            cols = np.frombuffer(key, dtype=bool)
            if len(members) >= least and cols.any():
                total += (len(members) - 1) * fit(x[np.ix_(members, np.flatnonzero(cols))], x[np.ix_(members, np.flatnonzero(holes))])(x[i, cols])
                weight += len(members) - 1
        if weight:
            out[i, holes] = total / weight
    return out


Fits = Callable[[np.ndarray], np.ndarray]


def _ridge_class(n: int, mean: np.ndarray, cross: np.ndarray, own: np.ndarray, lam: float = 1.0) -> Fits:
    """Fits of ``_ridge`` to a class of rows, from its number, means and centred cross-products; ``own`` marks the columns it has.

    The fits take the predicted columns (models x holes) and give (models, holes, 1 + columns) coefficients on the other own columns; those of predicted
    columns are for cells that are missing. With the intercept taken out, one inverse over the own columns has all fits: - inverse(y, y)^-1 inverse(y, x).
    """
    at = np.flatnonzero(own)
    inverse = np.zeros_like(cross)
    inverse[np.ix_(at, at)] = np.linalg.inv(cross[np.ix_(at, at)] + n * lam / (n + lam) * np.outer(mean[at], mean[at]) + lam * np.eye(len(at)))
    lines = np.column_stack([n / (n + lam) * (inverse @ mean), -inverse])
    return lambda ys: np.linalg.inv(inverse[ys[:, :, None], ys[:, None, :]]) @ lines[ys]


def _pls_class(n: int, mean: np.ndarray, cross: np.ndarray, own: np.ndarray, k: int = 2) -> Fits:
    """Fits of ``pls_fit`` as ``_ridge_class`` has them; a column whose spread is rounding has none."""
    sd = np.sqrt(np.maximum(np.diagonal(cross), 0.0) / (n - 1))
    sd = np.where(sd > 1e-9 * np.maximum(np.abs(mean), 1e-300), sd, 0.0)
    scale = np.where(sd > 0, sd, 1.0)
    z = np.where(np.outer(sd, sd) > 0, cross / np.outer(scale, scale), 0.0)
    turn = np.column_stack([-mean / scale, np.diag(1 / scale)])  # from weights of standard scores to 1 + columns

    def fits(ys: np.ndarray) -> np.ndarray:
        xs = np.repeat(own[None].astype(float), len(ys), axis=0)
        np.put_along_axis(xs, ys, 0.0, axis=1)
        ab, live, width, past = z[ys], np.ones(len(ys), dtype=bool), xs.sum(axis=1), []
        ab *= xs[:, None, :]
        for step in range(min(k, n - 1)):
            if step:
                ab -= (tt * out)[:, :, None] * load[:, None, :]
            value, vector = np.linalg.eigh(ab @ ab.transpose(0, 2, 1))
            top = np.sqrt(np.maximum(value[:, -1], 0.0))
            live &= (step < width) & (top >= 1e-10 * n)
            if not live.any():
                break
            u = (vector[:, None, :, -1] @ ab)[:, 0] * (live / np.where(live, top, 1.0))[:, None]
            along, turned = u @ z, u
            au, out = along * xs, np.take_along_axis(along, ys, axis=1)
            for load, tt, before, r in past:
                on = np.einsum("bd,bd->b", load, u)[:, None]
                au -= tt * on * load
                out -= tt * on * before
                turned = turned - on * r
            tt = np.einsum("bd,bd->b", u, au)[:, None]
            tt = np.where(tt > 0, tt, 1.0)
            load, out = au / tt, out / tt
            past.append((load, tt, out, turned))
        coef = np.zeros((*ys.shape, 1 + len(mean)))
        if past:
            coef += np.stack([out * scale[ys] for *_, out, _ in past], axis=2) @ np.stack([r @ turn for *_, r in past], axis=1)
        coef[:, :, 0] += mean[ys]
        return coef

    return fits


#: Models of ``impute_rows`` by name: from sums of a class of rows to its fits.
ROW_MODELS: dict[str, Callable[..., Fits]] = {"mlr": _ridge_class, "pls": _pls_class}
#: Patterns to fill and classes to fit of a task's block at most, bytes of either, rows of a class summed in one place, and numbers of a batch of fits.
TARGETS, CLASSES, BLOCK_BYTES, CLASS_ROWS, BATCH = 4096, 512, 1 << 25, 50_000, 1 << 16


def impute_rows(df: DataFrame, by: str, row: str, col: str, value: str, method: str, least: int = 3) -> DataFrame:
    """(by, row, col, filled): ``impute_by_rows`` of each matrix, by classes of rows with the same present cells.

    Rows that have another's missing cells and share a subset of its present ones are the rows of one pattern of present cells, so all models follow
    from each pattern's cross-products. Rows of a pattern share their coefficients; work grows with the pairs of patterns to fill and patterns of
    ``least`` rows, which are dealt as a grid of blocks of both. The columns are those of the whole table; the driver holds their names alone.
    """
    rows = df.select(F.col(by).alias("g"), F.col(row).alias("r"), F.col(col).alias("c"), finite(value).alias("v"))
    names = sorted(x[0] for x in rows.select("c").distinct().collect())
    d, model = len(names), ROW_MODELS[method]
    cell = {c: F.max(F.when(F.col("c") == F.lit(c), F.col("v"))) for c in names}
    wide = rows.groupBy("g", "r").agg(F.array(*[F.coalesce(v, F.lit(float("nan"))) for v in cell.values()]).alias("x"))
    wide = wide.withColumn("p", F.concat(*[F.when(F.isnan(F.col("x")[j]), "0").otherwise("1") for j in range(d)])).persist()
    kind = {c: rows.schema[c].dataType.simpleString() for c in "grc"}
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Moments of each run of rows of a class: a row for it and for each batch that it goes on in."""
        for pdf in batches:
            x, code = np.nan_to_num(np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), d)), pdf.groupby(["g", "p"], sort=False, dropna=False).ngroup().to_numpy()
            first = np.flatnonzero(np.diff(code, prepend=-1))
            parts = [x[lo:hi] for lo, hi in zip(first, [*first[1:], len(x)], strict=True)]
            means = [part.mean(axis=0) for part in parts]
            cross = [((part - m).T @ (part - m)).tobytes() for part, m in zip(parts, means, strict=True)]
            yield pdf.iloc[first][["g", "p"]].assign(n=[len(part) for part in parts], m=[m.tobytes() for m in means], s=cross)

    def merged(pdf: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
        n, mean, cross = 0, np.zeros(d), np.zeros((d, d))
        for k, m, s in zip(pdf["n"], pdf["m"], pdf["s"], strict=True):
            gap = np.frombuffer(m) - mean
            cross = cross + np.frombuffer(s).reshape(d, d) + np.outer(gap, gap) * n * k / (n + k)
            mean, n = mean + gap * k / (n + k), n + k
        return n, mean, cross

    def fitted(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Sums of the coefficients of a block of patterns, which have as many holes each, over a block of classes, weighted by their rows less 1."""
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ["g", "h", "tb", "cb", "p", "w", "b"]})
        left, right = left.sort_values("p"), right.sort_values(["p", "n", "m"])
        first = np.flatnonzero((right["p"] != right["p"].shift()).to_numpy())
        has, own = (np.array([[ch == "1" for ch in p] for p in side]) for side in (left["p"], right["p"].iloc[first]))
        h = int(left["h"].iloc[0])
        ys = np.nonzero(~has)[1].reshape(-1, h)
        fits = (~has).astype(np.float32) @ (~own).T.astype(np.float32) == 0  # the class has all the holes
        total, weight, size = np.zeros((len(left), h, d + 1)), np.zeros(len(left)), max(1, BATCH // (h * d))
        for k, (lo, hi) in enumerate(zip(first, [*first[1:], len(right)], strict=True)):
            at = np.flatnonzero(fits[:, k]) if own[k].sum() > h else []
            if len(at):
                n, mean, cross = merged(right.iloc[lo:hi])
                fit = model(n, mean, cross, own[k])
                weight[at] += n - 1
                for some in (at[lo : lo + size] for lo in range(0, len(at), size)):
                    coef = fit(ys[some])
                    coef *= n - 1
                    total[some] += coef
        out = left[["g", "h", "tb", "cb", "p"]].assign(w=weight, b=[b.tobytes() for b in total])
        return out[weight > 0]

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "cb"])
        first = np.flatnonzero((pdf["p"] != pdf["p"].shift()).to_numpy())
        b, w = (np.add.reduceat(v, first, axis=0) for v in (np.array([np.frombuffer(b) for b in pdf["b"]]), pdf["w"].to_numpy(float)))
        return pdf.iloc[first][["g", "p"]].assign(b=[v.tobytes() for v in b / w[:, None]])

    def same(*columns: str) -> Column:
        return functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])

    counts = wide.groupBy("g", "p").agg(F.count("*").alias("n"), (d - F.length(F.regexp_replace("p", "0", ""))).alias("h")).persist()
    large = counts.filter(F.col("n") >= least)
    open_ = counts.filter((F.col("h") > 0) & (F.col("h") < d))
    # Blocks of patterns by their number of holes, and of classes; a row for each group and number of holes.
    most = F.greatest(F.least(F.lit(TARGETS), F.floor(F.lit(BLOCK_BYTES) / (8 * (d + 1) * F.col("h")))), F.lit(1))
    grid = open_.groupBy("g", "h").agg(F.count("*").alias("t")).select("g", "h", F.ceil(F.col("t") / most).cast("int").alias("tbs"))
    split = large.groupBy(F.col("g").alias("_g")).agg(F.ceil(F.count("*") / max(1, min(CLASSES, BLOCK_BYTES // (8 * d * d)))).cast("int").alias("cbs"))
    grid = grid.join(split, same("g")).select(F.col("g").alias("_g"), F.col("h").alias("_h"), "tbs", "cbs")
    blocks = grid.groupBy("_g").agg(F.max("cbs").alias("cbs"), F.sort_array(F.collect_list(F.struct(F.col("_h").alias("h"), "tbs"))).alias("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("p"), F.col(n)).cast("int")

    known = large.join(blocks, same("g")).select(F.col("g").alias("_g"), F.col("p").alias("_p"), F.col("n").alias("rows"), place("cbs").alias("cb"), "blocks")
    deal = F.pmod(F.xxhash64("r"), F.ceil(F.col("rows") / CLASS_ROWS))
    trained = wide.join(known, same("g", "p")).repartition(tasks, "g", "p", deal).sortWithinPartitions("g", "p", "r").select("g", "p", "x")
    moments = f"g {kind['g']}, p string, n bigint, m binary, s binary"
    classes = trained.mapInPandas(sums, moments)
    classes = classes.join(known, same("g", "p")).select("g", F.explode("blocks").alias("z"), "cb", "p", "n", "m", "s")
    classes = classes.select("g", "z.h", every("z.tbs").alias("tb"), "cb", "p", "n", "m", "s")
    targets = open_.join(grid, same("g", "h")).select("g", "h", place("tbs").alias("tb"), every("cbs").alias("cb"), "p")
    keys, sort = ["g", "h", "tb", "cb"], f"g {kind['g']}, p string, b binary"
    # With a given number of tasks blocks are not put together because their rows are few.
    targets, classes = (side.repartition(4 * tasks, *keys) for side in (targets, classes))
    parts = targets.groupBy(*keys).cogroup(classes.groupBy(*keys)).applyInPandas(fitted, f"g {kind['g']}, h int, tb int, cb int, p string, w double, b binary")
    found = parts.groupBy("g", "h", "tb", F.pmod(F.hash("p"), F.lit(8))).applyInPandas(added, sort).withColumnsRenamed({"g": "_g", "p": "_p"})
    joined = wide.join(found, same("g", "p"), "left").select("g", "r", "x", "b")

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), d)
            for i, b in enumerate(pdf["b"]):
                if b is not None:
                    holes = np.isnan(x[i])
                    x[i, holes] = np.frombuffer(b).reshape(-1, d + 1) @ np.append(1.0, np.nan_to_num(x[i]))
            yield pdf[["g", "r"]].assign(x=list(x))

    out = joined.mapInPandas(filled, f"g {kind['g']}, r {kind['r']}, x array<double>")
    cells = F.explode(F.arrays_zip(F.array(*[F.lit(c).cast(kind["c"]) for c in names]).alias("c"), F.col("x").alias("f"))).alias("z")
    out = out.select("g", "r", cells).select("g", "r", F.col("z.c").alias("c"), finite("z.f").alias("filled"))
    return out.withColumnsRenamed({"g": by, "r": row, "c": col})


#: Whole-matrix methods by name: matrix with NaN for missing cells -> filled matrix.
METHODS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "soft": lambda x: impute_svd(x, "soft", 20)[-1][1],
    "hard": lambda x: impute_svd(x, "hard", rank=min(2, *x.shape))[-1][1],
    "als": lambda x: matfac(x, 1, 0.1)[0],
    "mlr": lambda x: impute_by_rows(x, lambda a, b: _ridge(a, b, 1.0)),
    "pls": lambda x: impute_by_rows(x, lambda a, b: pls_fit(a, b, 2)),
}


def impute_matrix(df: DataFrame, by: str, row: str, col: str, value: str, method: str | Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(by, row, col, filled): each matrix filled by a whole-matrix method; a matrix is one task's group."""
    fill = METHODS[method] if isinstance(method, str) else method

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="r", columns="c", values="v").astype(float)
        long = pd.DataFrame(fill(wide.to_numpy()), index=wide.index, columns=wide.columns).stack(future_stack=True).rename("filled").reset_index()
        long.insert(0, "g", pdf["g"].iloc[0])
        return long[["g", "r", "c", "filled"]]

    rows = df.select(F.col(by).alias("g"), F.col(row).alias("r"), F.col(col).alias("c"), finite(value).alias("v"))
    kinds = [rows.schema[c].dataType.simpleString() for c in "grc"]
    out = rows.groupBy("g").applyInPandas(run, f"g {kinds[0]}, r {kinds[1]}, c {kinds[2]}, filled double")
    return out.withColumnsRenamed({"g": by, "r": row, "c": col})


def hold_out_errors(x: np.ndarray, kind: str, hidden: int, loops: int = 5, seed: int = 1, count: int = 20, rank: int = 3) -> list[tuple[float, float]]:
    """(lambda or rank, mean squared error on hidden observed cells), averaged over random deletions."""
    rng, total = np.random.default_rng(seed), None
    cells = np.argwhere(np.isfinite(x))
    for _ in range(loops):
        gone = cells[rng.choice(len(cells), min(hidden, len(cells)), replace=False)]
        y = x.copy()
        y[gone[:, 0], gone[:, 1]] = np.nan
        path = impute_svd(y, kind, count, rank)
        err = np.array([np.mean((z[gone[:, 0], gone[:, 1]] - x[gone[:, 0], gone[:, 1]]) ** 2) for _, z in path])
        total = err if total is None else total + err
    return [(float(i) if kind == "soft" else float(p), float(e)) for i, ((p, _), e) in enumerate(zip(path, total / loops, strict=True))]


Columns = Sequence[str]
