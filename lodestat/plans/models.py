"""Queries of iterative and dense models: checked by rows here, by identities in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.stats import finite, percentiles
from ..operators import classify as C
from ..operators import clustering as K
from ..operators import ecm as E
from ..operators import factor as A
from ..operators import gcca as G
from ..operators import halves as H
from ..operators import imputation as I
from ..operators import linalg as L
from ..operators import mixed as X
from ..operators import multivariate as M
from ..operators import outliers as O
from ..operators import parcels as V
from ..operators import plotdata as P
from ..operators import plsc as Y
from ..operators import resample as B
from ..operators import resampled as R
from ..operators import univariate as U
from ..operators import volume_lda as W
from .series import r
from .tables import DAYS, WEEKS, blocks, days, table, weeks, wide_vectors

DIMS = 8


def _two(s, d):
    return wide_vectors(s, d, DIMS).filter(F.col("label").isin(0, 1))


def _plan(s, d, reps=4):
    return B.split_plan(_two(s, d), "vec_id", reps, strata=["label"])


def _held_plan(s, d, reps=4):
    """Halves 1 and 2, and a fifth of the ids held out as 3."""
    p = _plan(s, d, reps)
    return p.withColumn("half", F.when(B.hash_int("vec_id", 9) % 5 == 0, 3).otherwise(F.col("half")))


def _path(method, held=True, posterior=False):
    def run(s, d):
        return r(C.split_half_path(_two(s, d), (_held_plan if held else _plan)(s, d), "vec_id", "x", "label", method, posterior), "r", "p", "g", "d", digits=5)

    return run


def _sample(s, d, dims=DIMS, most=400):
    """Vectors of the two classes in memory, for models of a bounded sample; ``most`` is the model's parameter."""
    rows = wide_vectors(s, d, dims).filter(F.col("label").isin(0, 1)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()
    return np.array([x.vec_id for x in rows]), np.array([x.x for x in rows]), np.array([x.label for x in rows])


def _subjects(s, d, subjects=6, samples=40, dims=6):
    """A block of samples x variables for each subject, from a bounded sample of vectors."""
    rows = wide_vectors(s, d, subjects * dims).orderBy("vec_id").limit(samples).collect()
    x = np.array([v.x for v in rows])
    return [x[:, i * dims : (i + 1) * dims] for i in range(subjects)]


def _frame(s, rows, schema):
    return s.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in row) for row in rows], schema)


def _matrix(s, d):
    return days(s, d).withColumn("g", (F.col("user_id") % 4).cast("int"))


def _impute(method):
    return lambda s, d: r(I.impute_rows(_matrix(s, d), "g", "user_id", "day", "value", method), "filled", digits=4)


def _mixture(**options):
    def run(s, d):
        labels, _ = K.gaussian_mixture(wide_vectors(s, d, DIMS), "vec_id", "x", 3, rounds=10, **options)
        return r(labels, "responsibility", digits=5)

    return run


def _gcca(s, d):
    """Eight subjects of eight dimensions each over all vectors."""
    rows, found = G.fit_rows(wide_vectors(s, d), "vec_id", "x", 8, 4, 2)
    of = _frame(s, [(c, float(v), float(r)) for c, (v, r) in enumerate(zip(found.value, found.correlation, strict=True))], "component int, eigenvalue double, correlation double")
    return r(rows.withColumnRenamed("value", "variate").join(F.broadcast(of), "component"), "variate", "eigenvalue", "correlation", digits=6)


def _gcca_resample(s, d):
    ((_, rep, rows),) = G.resample_rows(wide_vectors(s, d), "vec_id", "x", 8, [4], 2, 20, strata=[0, 0, 0, 0, 1, 1, 1, 1])
    of = _frame(s, [(c, float(v)) for c, v in enumerate(rep)], "component int, reproducibility double")
    return r(rows.withColumnRenamed("value", "z").join(F.broadcast(of), "component"), "z", "reproducibility", digits=5)


def _gcca_multi(s, d):
    rows = [(k, c, float(v)) for k, rep, _ in G.resample_rows(wide_vectors(s, d), "vec_id", "x", 8, [2, 3, 4], 2, 20) for c, v in enumerate(rep)]
    return _frame(s, rows, "kpc int, component int, reproducibility double")


def _plsc(task):
    """The whole embedding of all vectors of the two classes; for behaviour its last three dimensions are Y."""

    def run(s, d):
        x = _whole_two(s, d)
        if task:
            p, out = 64, Y.analyse_task(x, "vec_id", "x", 64, "label", factors=1)
        else:
            sides = x.select("vec_id", "label", F.slice("x", 1, 61).alias("x"), F.slice("x", 62, 3).alias("y"))
            p, out = 61, Y.analyse(sides, "vec_id", "x", "y", 61, 3, "label", factors=2)
        rows = [(f, i, float(out["x_salience"][i, f]), float(out["bsr"][i, f]), float(out["fraction"][f]), float(out["p"][f])) for f in range(out["x_salience"].shape[1]) for i in range(p)]
        return _frame(s, rows, "factor int, var_id int, salience double, bsr double, fraction double, p double")

    return run


def _trilinear(s, d, factors, boots):
    x = _whole_two(s, d).select("vec_id", "x", F.array(F.col("label").cast("double")).alias("y"))
    return Y.analyse_trilinear(x, "vec_id", "x", "y", (8, 8), factors, boots)


def _npls(s, d):
    rows = [(f, i, j, float(m["first"][i] * m["second"][j]), m["covariance"]) for f, m in enumerate(_trilinear(s, d, 2, 0)) for i in range(8) for j in range(8)]
    return _frame(s, rows, "factor int, i int, j int, weight double, covariance double")


def _distatis(s, d):
    stack = np.array([np.corrcoef(b.T) for b in _subjects(s, d)])
    out = M.distatis(stack, boots=50)
    rows = []
    for i in range(stack.shape[1]):
        e = M.ellipse(out["boots"][:, i, 0], out["boots"][:, i, 1])
        rows.append((i, float(out["scores"][i, 0]), float(out["scores"][i, 1]), e["major"], e["minor"], float(out["share"][0])))
    return _frame(s, rows, "item int, axis1 double, axis2 double, major double, minor double, share1 double")


def _whole_two(s, d):
    """All dimensions of all vectors of the two classes."""
    return wide_vectors(s, d).filter(F.col("label").isin(0, 1))


def _tensor(s, d):
    """Covariances of the class with the whole embedding, as a table of 8 rows."""
    _, _, m = L.array_moments(_whole_two(s, d).select(F.concat(F.array(F.col("label").cast("double")), "x").alias("x")), "x")
    size, modes = M.tensor_rank_one(m[0, 1:].reshape(8, -1))
    return _frame(s, [(m, i, float(v), size) for m, mode in enumerate(modes) for i, v in enumerate(mode)], "mode int, i int, weight double, size double")


def _rcaa(s, d):
    x = np.array(_subjects(s, d, 6, 60, 6)).transpose(0, 2, 1).reshape(36, -1)
    a, b = np.cumsum(x[:18], axis=1), np.cumsum(x[18:], axis=1)
    return _frame(s, [(k, i, float(v), c["r"]) for k, c in enumerate(M.rcaa(a, b, 3, keep=0.5)) for i, v in enumerate(c["map"])], "component int, voxel int, z double, r double")


def _svd_nobias(s, d):
    return _frame(s, [(i, float(v)) for i, v in enumerate(M.svd_nobias_rows(_whole_two(s, d), "x"))], "component int, variance double")


def _pcr_loo(s, d):
    ks = (1, 2, 4)
    return _frame(s, list(zip(ks, M.pcr_loo_rows(_whole_two(s, d), "x", "label", ks), strict=True)), "k int, rss double")


def _procrustes(s, d):
    """Axes of one half of the vectors matched to those of the other; a hash of the id deals the halves."""
    halves = [_whole_two(s, d).filter(F.pmod(F.xxhash64("vec_id"), F.lit(2)) == h) for h in (0, 1)]
    index, flip = L.procrustes_match(*[L.pca(L.array_moments(h, "x")[2], 3)[1] for h in halves])
    return _frame(s, [(i, int(index[i]), float(flip[i])) for i in range(3)], "component int, matched int, flip double")


def _logdet(s, d):
    _, _, m = L.array_moments(wide_vectors(s, d), "x")
    return _frame(s, [(L.logdet(m),)], "logdet double")


def _cov_generalization(s, d):
    _, x, y = _sample(s, d)
    out = M.np.array(K.covariance_generalization(x[::2][:60].T, x[1::2][:60].T, np.arange(DIMS) % 2, np.arange(DIMS) % 3 % 2))
    return _frame(s, [(float(out[0]), float(out[1]))], "predictive double, agreement double")


def _nested(s, d):
    _, x, y = _sample(s, d)
    return s.createDataFrame(C.nested_cv(x, y, C.FITS["ld_l2"], 4, 4))


def _halves(method, held=True, posterior=False):
    """Split-half curves of all vectors of the two classes, in all dimensions."""
    return lambda s, d: r(H.split_half_paths(_whole_two(s, d), "vec_id", "x", "label", method, 64, 10, held=held, posterior=posterior)[0], "r", "p", "g", "d", digits=5)


def _reference(method):
    return lambda s, d: r(H.split_half_paths(_whole_two(s, d), "vec_id", "x", "label", method, 64, 2)[1], "value", digits=4)


def _holdout(kind):
    def run(s, d):
        rows = days(s, d).toPandas().pivot(index="user_id", columns="day", values="value").to_numpy(dtype=float)
        return _frame(s, I.hold_out_errors(rows, kind, 20, 3), "setting double, error double")

    return run


def _day_rows(s, d):
    """(row, x): each user's days as an array."""
    return E.array_of(days(s, d), "user_id", "day", finite("value"), list(range(1, 31))).persist()


def _ecm(s, d):
    mean, cov, trace = E.ecm_rows(_day_rows(s, d), "x", 30)
    return _frame(s, [(i + 1, j + 1, float(mean[i]), float(cov[i, j]), float(trace[-1])) for i in range(len(mean)) for j in range(len(mean))], "i int, j int, mean_i double, cov double, objective double")


def _ecm_objective(s, d):
    """The negative log-likelihood at independent columns with their own mean and variance."""
    rows = _day_rows(s, d)
    mean, spread = A.column_moments(rows, "x", 30)
    return r(_frame(s, [(E.objective(rows, "x", mean, np.diag(spread**2)),)], "objective double"), "objective", digits=3)


def _filled_days(s, d, kind):
    """Whole tables of users by days, filled by row blocks: (user_id, day, filled)."""
    rows = _day_rows(s, d)
    if kind == "soft":
        *_, model = A.soft_path(rows, "x", 30, 4, rounds=15)
    elif kind == "hard":
        model = A.fit_rows(rows, "x", 30, 2, 1e-3, rounds=50, tol=1e-6)
    else:
        model = A.fit_rows(rows, "x", 30, 1, 0.1, rounds=50, tol=1e-6)
    out = A.filled(rows, "x", model, ["row"]).select(F.col("row").alias("user_id"), F.posexplode("filled").alias("day", "filled"))
    return r(out.withColumn("day", F.col("day") + 1), "filled", digits=4)


def _band(s, d):
    x = table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("double").alias("x"), F.avg("o_totalprice").alias("y"))
    grid = s.createDataFrame([(float(v),) for v in (5, 10, 15, 20)], "x0 double")
    return r(P.reg_band(x, grid, "x", "y", ["id"], 100), "fit", "ci_low", "ci_high", digits=3)


def _shade(s, d):
    x = blocks(s, d).groupBy("event_type", (F.col("user_id") % 6).cast("double").alias("x")).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    return r(P.shade_fill(x.select("event_type", "x", (F.col("m") - F.col("sd")).alias("low"), (F.col("m") + F.col("sd")).alias("high")), "event_type", "x", "low", "high", 20), "x", "low", "high", digits=4)


def _orders(s, d):
    x = table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("y"), F.avg(F.month("o_orderdate")).alias("m"))
    return x.withColumn("grp", (F.col("id") % 2).cast("int"))


def _terms(reps):
    return r(B.boot_summary(reps, "stat", ["term"]), "av", "se", "bsr", "ci_low", "ci_high", digits=4)


def _pls_half(s, d):
    _, x, y = _sample(s, d, 16)
    return s.createDataFrame(R.pls_splithalf(x, y.astype(float), [1, 2, 4, 8], 20))


def _pls_predict(s, d):
    _, x, y = _sample(s, d, 16)
    return s.createDataFrame(R.pls_predict(x, y, 2, 20))


def _npls_boot(s, d):
    rows = [(f, m, i, float(v)) for f, found in enumerate(_trilinear(s, d, 1, 500)) for m, name in enumerate(("first_bsr", "second_bsr")) for i, v in enumerate(found[name])]
    return _frame(s, rows, "factor int, mode int, i int, bsr double")


def _matfac3(s, d):
    x = np.array(_subjects(s, d))
    x[np.random.default_rng(1).random(x.shape) < 0.1] = np.nan
    full, _ = R.matfac3(x, 1, 0.1, tries=1)
    return _frame(s, [(i, j, k, float(full[i, j, k])) for i, j, k in np.ndindex(full.shape)], "subject int, sample int, var_id int, filled double")


def _volume_lda(s, d):
    e = table(s, d, "events").groupBy((F.col("user_id") % 6).cast("int").alias("subject"), F.dayofmonth("ts").alias("t"), F.hash("event_type").alias("h")).agg(F.avg("value").alias("value"))
    voxels = e.select("subject", F.pmod("h", F.lit(3)).alias("x"), F.pmod(F.floor(F.col("h") / 3), F.lit(3)).cast("int").alias("y"), F.lit(0).alias("z"), "t", "value").groupBy("subject", "x", "y", "z", "t").agg(F.avg("value").alias("value"))
    onsets = e.select("subject", "t").distinct().withColumn("label", F.when(F.col("t") % 3 == 0, 0).when(F.col("t") % 3 == 1, 1).otherwise(-1))
    return voxels, voxels.select("x", "y", "z"), onsets


def _volume_curves(s, d):
    _, curves = W.group_map(*_volume_lda(s, d))
    return _frame(s, [(c["k"], c["r"], c["p"], c["d"]) for c in curves], "k int, r double, p double, d double")


def _volume_samples(s, d):
    rows, subject, label = W.sample_rows(*_volume_lda(s, d))
    rows = rows.persist()
    return rows, subject, W.sample_products(rows, subject, label)


def _sample_variates(s, d):
    _, subject, found = _volume_samples(s, d)
    curves, _ = W.sample_variates(found, np.flatnonzero(subject % 2 == 0), np.flatnonzero(subject % 2 == 1), [1, 2, 3, 4])
    return _frame(s, [(c["k"], c["r"], c["p"], c["d"]) for c in curves], "k int, r double, p double, d double")


def _kernel_map(s, d):
    rows, subject, found = _volume_samples(s, d)
    path = W.kernel_ridge(found, np.arange(len(subject)), 5)
    return r(W.mapped(rows, subject, path[len(path) // 2][1] if path else np.zeros(len(subject))), "value", digits=6)


def _parcel_rows(s, d):
    """Users as voxels, event types as subjects and days as times: mean values."""
    e = table(s, d, "events").select("user_id", "event_type", F.dayofmonth("ts").alias("day"), "value")
    return V.voxel_rows(e, "user_id", "event_type", "day", "value")


def _parcels(kind):
    def run(s, d):
        rows, subjects, times = _parcel_rows(s, d)
        rows = rows.persist()
        model = V.fit(rows, len(subjects), len(times), 3, kind, rounds=20, start="random")
        return r(V.labelled(rows, model), "responsibility", "scale", digits=4)

    return run


def _parcel_maps(s, d):
    rows, subjects, times = _parcel_rows(s, d)
    rows = rows.persist()
    fixed = rows.select("voxel", (F.col("voxel") % 3).cast("int").alias("cluster"))
    model = V.fit(rows, len(subjects), len(times), 3, "network", rounds=10, parcels=fixed)
    return r(V.subject_maps(rows, model, subjects), "weight", "r", digits=4)


def _components_to(x, digits):
    """Coefficients to four digits, variances, whose search ends near its goal, to fewer."""
    return x.withColumn("estimate", F.when(F.col("term").startswith("var") | (F.col("term") == "residual"), F.round("estimate", digits)).otherwise(F.round("estimate", 4)) + 0.0)


LMM, LMM_PANEL = "y ~ t + grp + (1 | subject)", "y ~ t + n + (1 | subject)"


def _week_dummies(s, d):
    return weeks(s, d).select("subject", "y", *[F.when(F.col("t") == k, 1.0).otherwise(0.0).alias(f"w{k}") for k in (1, 2, 3)])


def _panel(s, d):
    """(subject, t, n, y): mean click value of each user and week, null where there is none, and the user's number of events."""
    e = table(s, d, "events")
    users = e.groupBy(F.col("user_id").alias("subject")).agg(F.count("*").cast("double").alias("n"))
    w = F.least(F.floor((F.dayofmonth("ts") - 1) / 7), F.lit(3)).cast("int")
    y = e.filter("event_type = 'click'").groupBy(F.col("user_id").alias("subject"), w.alias("t")).agg(F.avg("value").alias("y"))
    return users.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(3)))).join(y, ["subject", "t"], "left")


def _controls(s, d, covariates):
    """Users with even ids against those with odd ones, who count as controls with their mean over weeks."""
    p = _panel(s, d)
    other = p.filter("subject % 2 = 1").groupBy("subject").agg(F.avg("y").alias("y"), F.first("n").alias("n"))
    return X.against_controls(p.filter("subject % 2 = 0"), other, LMM_PANEL, "t", covariates, 1000)


QUERIES = {
    "lmm_fit": lambda s, d: _components_to(r(X.fit(weeks(s, d), LMM), "se", digits=4), 1).drop("t"),
    "lmm_slopes": lambda s, d: r(X.fit(weeks(s, d), "y ~ t + grp + t:grp + (1 + t | subject)"), "estimate", "se", "t", digits=4),
    "lmm_bootstrap": lambda s, d: _terms(X.bootstrap(weeks(s, d), LMM, 1000)),
    "lmm_bootstrap_fdr": lambda s, d: U.fdr(_terms(X.bootstrap(weeks(s, d), LMM, 1000)).filter("term <> '(intercept)'"), "p"),
    "lmm_contrasts": lambda s, d: _terms(X.bootstrap(_week_dummies(s, d), "y ~ w1 + w2 + w3 + (1 | subject)", 1000, [("w1", "w2"), ("w1", "w3"), ("w2", "w3")]).filter("term LIKE '%-%'")),
    "lmm_time_courses": lambda s, d: r(B.boot_summary(X.time_courses(_panel(s, d), LMM_PANEL, "t", 1000), "mean", ["how", "time"]), "av", "se", "bsr", "ci_low", "ci_high", digits=4),
    "lmm_changes": lambda s, d: r(B.boot_summary(X.time_courses(_panel(s, d), LMM_PANEL, "t", 1000).filter("time > 0"), "change", ["how", "time"]), "av", "se", "bsr", "ci_low", "ci_high", digits=4),
    "lmm_controls": lambda s, d: r(B.boot_summary(_controls(s, d, []), "diff", ["how", "time"]), "av", "se", "bsr", "ci_low", "ci_high", digits=4),
    "lmm_controls_adjusted": lambda s, d: r(B.boot_summary(_controls(s, d, ["n"]), "diff", ["how", "time"]), "av", "se", "bsr", "ci_low", "ci_high", digits=4),
    "lmm_bootstrap_impute": lambda s, d: r(B.boot_summary(R.mixed_bootstrap_impute(days(s, d), "value", "day", "user_id", 40), "change", ["time"]).filter("time > 1"), "av", "se", "bsr", "ci_low", "ci_high", digits=4),
    "reg_boot": lambda s, d: _terms(R.reg_boot(_orders(s, d), "y", ["n", "m"], ["id"], reps=50)),
    "reg_boot_delta": lambda s, d: _terms(R.reg_boot(_orders(s, d), "y", ["n"], ["id"], tried="m", reps=50)),
    "pcorr_boot": lambda s, d: _terms(R.pcorr_boot(_orders(s, d), "y", "n", ["m"], ["id"])),
    "adjusted_diff": lambda s, d: _terms(R.adjusted_diff(_orders(s, d), "y", "grp", ["n"], ["id"], 50)),
    "pls_splithalf": _pls_half,
    "pls_predict": _pls_predict,
    "npls_bootstrap": _npls_boot,
    "matfac_three_way": _matfac3,
    "group_lda_map": lambda s, d: r(W.group_map(*_volume_lda(s, d))[0], "value", digits=4),
    "group_lda_curves": _volume_curves,
    "sample_variates": _sample_variates,
    "ld_kernel_map": _kernel_map,
    **{f"parcels_{k}": _parcels(k) for k in V.KINDS},
    "parcel_subject_maps": _parcel_maps,
    "lda_splithalf": lambda s, d: r(M.split_halves(_two(s, d), _plan(s, d, 2), "vec_id", "x", "label"), "r", "p", "d", digits=5),
    "lda_group": lambda s, d: r(M.split_halves(_two(s, d), _plan(s, d, 10), "vec_id", "x", "label").groupBy("k").agg(F.median("r").alias("r"), F.median("p").alias("p")), "r", "p", digits=5),
    "lda_optimum": lambda s, d: r(M.rp_optimum(M.split_halves(_two(s, d), _plan(s, d, 6), "vec_id", "x", "label"), ["rep"]), "d", digits=5),
    "pcr_r2": lambda s, d: r(M.pcr_r2(wide_vectors(s, d, DIMS), B.split_plan(wide_vectors(s, d, DIMS), "vec_id", 5, share=0.9), "vec_id", "x", "label", [1, 2, 4]), "press", "tss", "r2", digits=4),
    "pcr_loo": _pcr_loo,
    "plsc_behaviour": _plsc(False),
    "plsc_task": _plsc(True),
    "npls": _npls,
    "gcca": _gcca,
    "gcca_resample": _gcca_resample,
    "gcca_resample_multi": _gcca_multi,
    "distatis": _distatis,
    "tensor_rank_one": _tensor,
    "rcaa": _rcaa,
    "svd_nobias": _svd_nobias,
    "procrustes_match": _procrustes,
    "logdet": _logdet,
    "pca_outliers": lambda s, d: r(O.pca_outliers(wide_vectors(s, d, DIMS), "vec_id", "x", 3), "mahalanobis", "leverage", "orthogonal", digits=5),
    "pca_kurtosis_filter": lambda s, d: O.pca_kurtosis_filter(wide_vectors(s, d, DIMS), "vec_id", "x", 3.2, 0.01),
    "kmeans_multi": lambda s, d: r(K.kmeans_best(wide_vectors(s, d, DIMS), "vec_id", "x", 3, 2)[0], "distance", digits=5),
    "mixture_plain": _mixture(),
    "mixture_scaled": _mixture(scaled=True),
    "mixture_shared": _mixture(shared=True),
    "mixture_scaled_shared": _mixture(scaled=True, shared=True, prior=1.0),
    "covariance_generalization": _cov_generalization,
    "impute_svd_soft": lambda s, d: _filled_days(s, d, "soft"),
    "impute_svd_hard": lambda s, d: _filled_days(s, d, "hard"),
    "impute_als": lambda s, d: _filled_days(s, d, "als"),
    "impute_mlr": _impute("mlr"),
    "impute_pls": _impute("pls"),
    "impute_svd_modeltest": _holdout("soft"),
    "ecm_mle": _ecm,
    "ecm_objective": _ecm_objective,
    **{f"{m}_path": _path(m) for m in C.FITS},
    "ld_ic_path": lambda s, d: _path(C.with_components(C.FITS["ld_pc"], 4))(s, d),
    "lr_ic_path": lambda s, d: _path(C.with_components(C.FITS["lr_pc"], 4))(s, d),
    "svm_ic_path": lambda s, d: _path(C.with_components(C.FITS["svm_l2"], 4))(s, d),
    "ld_two_splits": _path("ld_l2", held=False),
    "ld_posterior": _path("ld_l2", posterior=True),
    "lr_posterior": _path("lr_l2", posterior=True),
    **{m: _halves(m) for m in ("qd_l2", "qd_l1", "qd_nr")},
    **{f"{m}_two_splits": _halves(m, held=False) for m in ("qd_l2", "qd_l1", "qd_nr")},
    **{f"{m}_posterior": _halves(m, posterior=True) for m in ("qd_l2", "qd_nr")},
    **{f"{m}_map": _reference(m) for m in ("qd_l2", "qd_l1", "qd_nr")},
    **{f"{m}_whole": _halves(m) for m in ("ld_l2", "ld_pc")},
    "nested_cv": _nested,
    "cd_sets": lambda s, d: r(P.cd_sets(blocks(s, d), "event_type", "user_id", "value"), "mean_rank"),
    "box_ci": lambda s, d: r(P.box_ci(blocks(s, d), ["event_type"], "value", ["user_id"], 100), "av", "se", "bsr", "ci_low", "ci_high", digits=4),
    "reg_band": _band,
    "shade_fill": _shade,
    "hazen_percentiles": lambda s, d: r(percentiles(table(s, d, "events"), "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, ["event_type"]), "p05", "p50", "p95"),
}

_AT = "least(greatest(n * {p} + 0.5, 1.0), n)"


def _pct(p: float) -> str:
    at = _AT.format(p=p)
    return f"round(sum(CASE WHEN k = floor({at}) THEN value * (1 - ({at} - floor({at}))) END) + coalesce(sum(CASE WHEN k = floor({at}) + 1 THEN value * ({at} - floor({at})) END), 0), 6)"


# Each user has all four weeks, so that the model's estimates are those of the analysis of variance; a negative variance of users is
# zero, and both mean squares are pooled.
_LMM = f"""WITH {WEEKS}, m AS (SELECT subject, grp, avg(y) AS m FROM w GROUP BY 1, 2), g AS (SELECT grp, count(*) AS n, avg(m) AS m FROM m GROUP BY 1),
b AS (SELECT sum((t - 1.5) * y) / sum((t - 1.5) * (t - 1.5)) AS b FROM w),
e AS (SELECT sum((y - m - b * (t - 1.5)) * (y - m - b * (t - 1.5))) AS ss, count(DISTINCT subject) AS n FROM w JOIN m USING (subject), b),
s AS (SELECT 4 * sum((m.m - g.m) * (m.m - g.m)) AS ss FROM m JOIN g USING (grp)),
v AS (SELECT n, CASE WHEN s.ss / (n - 2) > e.ss / (3 * n - 1) THEN e.ss / (3 * n - 1) ELSE (e.ss + s.ss) / (4 * n - 3) END AS r, s.ss / (n - 2) AS between, e.ss / (3 * n - 1) AS within FROM e, s),
c AS (SELECT n, r, greatest(between - within, 0) / 4 AS u FROM v),
z AS (SELECT n, r, u, u + r / 4 AS h, (SELECT n FROM g WHERE grp = 0) AS n0, (SELECT n FROM g WHERE grp = 1) AS n1, (SELECT m FROM g WHERE grp = 0) AS m0, (SELECT m FROM g WHERE grp = 1) AS m1, b FROM c, b)
SELECT term, CASE WHEN term LIKE 'var%' OR term = 'residual' THEN round(estimate, 1) ELSE round(estimate, 4) END AS estimate, round(se, 4) AS se FROM (
SELECT '(intercept)' AS term, m0 - 1.5 * b AS estimate, sqrt(h / n0 + 2.25 * r / (5 * n)) AS se FROM z UNION ALL SELECT 't', b, sqrt(r / (5 * n)) FROM z UNION ALL SELECT 'grp', m1 - m0, sqrt(h * (1.0 / n0 + 1.0 / n1)) FROM z
UNION ALL SELECT 'var((intercept),(intercept))', u, NULL FROM z UNION ALL SELECT 'residual', r, NULL FROM z)"""

SQL = {
    "lmm_fit": _LMM,
    "ecm_objective": f"WITH {DAYS}, m AS (SELECT day, count(value) AS n, avg(value) AS mean, var_samp(value) AS v, coalesce(var_pop(value) * count(value), 0) AS ss FROM d GROUP BY day) SELECT round(sum(0.5 * (n * (ln(CASE WHEN v > 0 THEN v ELSE 1 END) + ln(2 * pi())) + ss / CASE WHEN v > 0 THEN v ELSE 1 END)), 3) AS objective FROM m",
    "hazen_percentiles": f"WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, {_pct(0.05)} AS p05, {_pct(0.5)} AS p50, {_pct(0.95)} AS p95 FROM x GROUP BY 1",
}
