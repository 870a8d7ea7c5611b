"""Identities and known cases of operators that SQL can't express."""

import math

import numpy as np
import pytest

from lodestat.functions import dist
from lodestat.operators import classify, clustering, imputation, linalg, multivariate, outliers, plotdata, resample, temporal, univariate
from lodestat.sources import nifti

RNG = np.random.default_rng(4)


def series_frame(spark, arrays):
    return spark.createDataFrame([(i, t + 1, float(v)) for i, a in enumerate(arrays) for t, v in enumerate(a)], "series_id bigint, t int, value double")


def two_classes(n=80, d=5, gap=3.0):
    y = np.arange(n) % 2
    x = RNG.normal(size=(n, d))
    x[:, 0] += gap * y
    return x, y


def test_distributions():
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert dist.normal_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert dist.f_sf(4.0, 2, 10) == pytest.approx(1.8**-5, abs=1e-12)
    assert dist.chi2_sf(2.0, 2) == pytest.approx(math.exp(-1), abs=1e-12)
    assert dist.gamma_sf(np.array([2.0]), 2.0, 1.0)[0] == pytest.approx(3 * math.exp(-2), abs=1e-12)
    x = RNG.gamma(3.0, 2.0, 20000)
    assert dist.gamma_shape(x.mean(), np.log(x).mean()) == pytest.approx(3.0, rel=0.05)


def test_dfa_of_noise_and_its_sum(spark):
    noise = RNG.normal(size=1024)
    got = {r.series_id: r.hurst for r in temporal.dfa(series_frame(spark, [noise, np.cumsum(noise)]), [8, 16, 32, 64, 128]).collect()}
    assert got[0] == pytest.approx(0.5, abs=0.15)
    assert got[1] == pytest.approx(1.5, abs=0.2)
    assert temporal.dfa_scales(256) == sorted(set(temporal.dfa_scales(256)))


@pytest.mark.parametrize("wavelet", ["haar", "db2", "db3", "db4"])
def test_wavelet_round_trip(wavelet):
    x = RNG.normal(size=64)
    a, d = temporal.dwt_array(x, wavelet)
    assert np.allclose(temporal.idwt_array(a, d, wavelet, 64), x)
    assert np.isclose((a**2).sum() + (d**2).sum(), (x**2).sum())


def test_welch_peak():
    f, p = temporal.welch_array(np.sin(2 * np.pi * 8 * np.arange(128) / 128), 128.0, "hann", None)
    assert f[p.argmax()] == 8.0


def test_fdr_rules(spark):
    df = spark.createDataFrame([(1, 0.02), (2, 0.03), (3, 0.04), (4, None)], "i int, p double")
    assert {r.crit for r in univariate.fdr(df, "p").collect()} == {0.04}
    assert {r.crit for r in univariate.fdr(df, "p", compat=True).collect()} == {0.03}
    assert univariate.fdr(df, "p").filter("i = 4").first()["mask"] == -1
    assert [(r.crit, r["mask"]) for r in univariate.fdr_one_family(df, "p").orderBy("i").collect()] == [(r.crit, r["mask"]) for r in univariate.fdr(df, "p").orderBy("i").collect()]


def test_regression_and_mixed_model(spark):
    rows, truth = [], np.array([1.0, 2.0, -0.5])
    for s in range(60):
        u = RNG.normal() * 2
        for _ in range(6):
            a, b = RNG.normal(size=2)
            rows.append((s, float(a), float(b), float(truth @ [1, a, b] + u + RNG.normal() * 0.5)))
    df = spark.createDataFrame(rows, "s int, a double, b double, y double")
    fit = {r.term: r.b for r in univariate.random_intercept(df, "y", ["a", "b"], "s").collect()}
    assert fit["a"] == pytest.approx(2.0, abs=0.1) and fit["b"] == pytest.approx(-0.5, abs=0.1)
    assert fit["var(residual)"] == pytest.approx(0.25, abs=0.08) and fit["var(subject)"] == pytest.approx(4.0, rel=0.5)
    x = np.array([[1, r[1], r[2]] for r in rows])
    want = np.linalg.lstsq(x, np.array([r[3] for r in rows]), rcond=None)[0]
    assert np.allclose([r.b for r in univariate.regression(df, "y", ["a", "b"]).collect()], want)
    parts = univariate.variance_partition(df, "y", ["a", "b"]).collect()
    r2 = 1 - ((np.array([r[3] for r in rows]) - x @ want) ** 2).sum() / np.var([r[3] for r in rows]) / len(rows)
    assert sum(p.relative_weight for p in parts) == pytest.approx(r2, abs=1e-6)
    assert sum(p.pratt for p in parts) == pytest.approx(r2, abs=1e-6)


def test_draws_are_a_bootstrap(spark):
    d = resample.draws(spark, 200, 50).toPandas()
    assert d.groupby("rep").times.sum().eq(200).all()
    assert d.groupby("rep").size().mean() / 200 == pytest.approx(1 - math.exp(-1), abs=0.02)
    key = ["rep", "i"]
    again = resample.draws(spark, 200, 50).repartition(7).toPandas()
    assert d.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_gen_esd_finds_the_outlier(spark):
    x = [*RNG.normal(size=40), 9.0]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "var int, sample int, value double")
    assert [r["sample"] for r in outliers.gen_esd(df, "var", "sample", "value").filter("outlier").collect()] == [40]


def test_isolation_forest_ranks_the_outlier_first(spark):
    x = np.vstack([RNG.normal(size=(60, 2)), [[8.0, -8.0]]])
    df = spark.createDataFrame([(v, i, float(x[i, v])) for i in range(61) for v in range(2)], "var int, sample int, value double")
    assert outliers.isolation_forest(df, "var", "sample", "value", 40, 6).orderBy("height").first()["sample"] == 60


def test_mixture_and_kmeans_recover_groups(spark):
    y = np.arange(90) % 3
    x = RNG.normal(size=(90, 2)) * 0.3 + np.array([[0, 0], [5, 5], [0, 5]])[y]
    df = spark.createDataFrame([(i, [float(v) for v in r], int(y[i])) for i, r in enumerate(x)], "id int, x array<double>, y int")
    for labels in (clustering.kmeans(df, "id", "x", x[:3])[0], clustering.gaussian_mixture(df, "id", "x", 3, seed=2)[0], clustering.kmeans_best(df, "id", "x", 3, 3)[0]):
        both = labels.join(df.select("id", "y"), "id")
        assert clustering.nmi(both, "cluster", "y").first().nmi > 0.6
    assert clustering.nmi(df, "y", "y").first().nmi == pytest.approx(1.0)


def test_imputation_recovers_low_rank():
    full = RNG.normal(size=(30, 2)) @ RNG.normal(size=(2, 12))
    x = full.copy()
    x[RNG.random(x.shape) < 0.2] = np.nan
    hole = np.isnan(x)
    base = np.sqrt(np.mean((np.nanmean(x, axis=0)[None, :].repeat(30, 0) - full)[hole] ** 2))
    fills = [imputation.impute_svd(x, "soft", 30)[-1][1], imputation.impute_svd(x, "hard", rank=2)[-1][1], imputation.matfac(x, 2, 1e-3)[0]]
    for fill in fills:
        assert np.allclose(fill[~hole], x[~hole]) and np.sqrt(np.mean((fill - full)[hole] ** 2)) < 0.6 * base
    full = RNG.normal(size=(200, 2)) @ RNG.normal(size=(2, 4))
    x = np.where(RNG.random(full.shape) < 0.15, np.nan, full)
    hole = np.isnan(x) & np.isfinite(x).any(axis=1, keepdims=True)
    for name in ("mlr", "pls"):
        fill = imputation.METHODS[name](x)
        assert np.isfinite(fill[hole]).mean() > 0.9 and np.nanmean((fill - full)[hole] ** 2) < 0.5 * np.mean(full**2)


def test_ecm_on_complete_data_is_the_sample_moments():
    x = RNG.normal(size=(50, 3))
    mean, cov, trace = imputation.ecm_mle(x)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True), atol=1e-6)
    x[RNG.random(x.shape) < 0.2] = np.nan
    trace = imputation.ecm_mle(x)[2]
    assert all(b <= a + 1e-6 for a, b in zip(trace, trace[1:]))


def test_lars_ends_at_least_squares():
    x, y = RNG.normal(size=(50, 4)), RNG.normal(size=50)
    x, y = x - x.mean(axis=0), y - y.mean()
    path = classify.lars(x, y, 50)
    assert np.allclose(path[-1], np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)
    assert (path[0] != 0).sum() == 1


def test_graphical_lasso_without_penalty_is_the_inverse():
    s = np.cov(RNG.normal(size=(200, 4)).T)
    assert np.allclose(classify.graphical_lasso(s, 1e-6), np.linalg.inv(s), atol=1e-2)
    off = classify.graphical_lasso(s, 10.0)
    assert np.count_nonzero(off - np.diag(np.diag(off))) == 0


@pytest.mark.parametrize("name", sorted(classify.FITS))
def test_paths_separate_classes(name):
    x, y = two_classes()
    best = max(((x @ w > c) == (y == 1)).mean() for _, w, c in classify.FITS[name](x, y))
    assert best > 0.9
    out = classify.split_half(x, y, np.arange(len(y)) // 2 % 2 + 1, classify.FITS[name])
    assert out.p.max() > 0.85


def test_quadratic_and_nested():
    x, y = two_classes()
    for kind in ("L2", "L1", "NR"):
        assert max(((classify.qd_scores(m, x) > 0) == (y == 1)).mean() for _, m in classify.qd_models(x, y, kind)) > 0.85
    assert classify.nested_cv(x, y, classify.FITS["ld_l2"]).accuracy.mean() > 0.85


def test_ica_unmixes():
    s = np.column_stack([np.sign(RNG.normal(size=2000)), RNG.uniform(-1, 1, 2000)])
    x = s @ np.array([[1.0, 0.5], [0.3, 1.0]])
    c = np.abs(np.corrcoef(((x - x.mean(0)) @ classify.fast_ica(x, 2).T).T, s.T)[:2, 2:])
    assert c.max(axis=1).min() > 0.95


def test_multivariate_kernels(spark):
    x, y = two_classes(60, 4)
    out = multivariate.lda_splithalf(x[:30], y[:30], x[30:], y[30:])
    assert out.p.max() > 0.8 and out.r.max() > 0.5
    blocks = [np.column_stack([np.sin(np.arange(40) / 3), RNG.normal(size=(40, 3)) * 0.1]) for _ in range(5)]
    _, _, corr = multivariate.gcca(blocks, 2, 1)
    assert abs(corr[0]) > 0.9
    size, modes = multivariate.tensor_rank_one(np.einsum("i,j,k->ijk", *(RNG.normal(size=n) for n in (3, 4, 5))))
    assert all(np.isclose(np.linalg.norm(m), 1) for m in modes) and size > 0
    r, _ = multivariate.rspm_array(np.arange(10.0), np.arange(10.0) * 2)
    assert r == pytest.approx(1.0)
    d = multivariate.distatis(np.array([np.corrcoef(RNG.normal(size=(4, 20))) for _ in range(5)]), boots=10)
    assert d["weights"].sum() == pytest.approx(1.0)
    out = multivariate.plsc(x, np.column_stack([x[:, 0], RNG.normal(size=60)]), np.zeros(60), np.arange(60), 1, 20, 20)
    assert abs(out["x_salience"][0, 0]) > 0.8
    index, flip = linalg.procrustes_match(x, -x[:, ::-1])
    assert list(index) == [3, 2, 1, 0] and set(flip) == {-1.0}


def test_pchip_is_monotone():
    x, y = np.arange(6.0), np.array([0, 1, 1, 2, 5, 5.0])
    z = plotdata.pchip(x, y, np.linspace(0, 5, 101))
    assert np.all(np.diff(z) >= -1e-12) and z[0] == 0 and z[-1] == 5


def test_volume_round_trip(spark, tmp_path):
    v = RNG.normal(size=(3, 4, 2, 2))
    (tmp_path / "a.nii").write_bytes(nifti.volume(v))
    assert np.allclose(nifti.parse(nifti.volume(v)), v)
    rows = nifti.read_volumes(spark, str(tmp_path / "a.nii"))
    assert rows.count() == v.size
    mask = spark.createDataFrame([(0, 0, 0, 1.0), (1, 1, 1, 0.0)], "x int, y int, z int, value double")
    assert nifti.masked(rows, mask).count() == 2


def test_edge_frames(spark):
    empty = spark.createDataFrame([], "series_id bigint, t int, value double")
    assert temporal.dfa(empty, [4, 8]).count() == 0
    one = spark.createDataFrame([(1, 1, 3.0)], "series_id bigint, t int, value double")
    assert temporal.haar(one, 2).count() == 3
    flat = spark.createDataFrame([(1, i, 2.0) for i in range(1, 20)], "series_id bigint, t int, value double")
    assert temporal.dfa(flat, [4, 8]).count() == 0
    nulls = spark.createDataFrame([(1, 1, None), (1, 2, float("nan")), (2, 1, float("inf"))], "u int, d int, v double")
    assert imputation.impute_mean(nulls, "u", "v").filter("filled IS NOT NULL").count() == 0


def test_streaming_segments(spark, tmp_path):
    from lodestat.streaming import segments

    rows = spark.createDataFrame([(1, f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(20)], "u int, ts string, v double")
    rows.selectExpr("u", "cast(ts as timestamp) as ts", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u int, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = segments.segment_stats(stream, "ts", "v", "u", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("seg").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("SELECT * FROM seg").collect()) == [10, 10]
    q = segments.displacement(stream, "u", "v", "v", 3).writeStream.outputMode("append").format("memory").queryName("disp").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {round(r.d, 6) for r in spark.sql("SELECT * FROM disp WHERE t >= 3").collect()} == {4.0}


def test_models_of_vectors_use_the_whole_table(spark, sf_dir):
    from lodestat.plans import models

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("label IN (0, 1)").select("embedding", "label", "vec_id").toPandas()
    x, y = np.array(rows["embedding"].tolist(), dtype=float), rows["label"].to_numpy(float)
    got = {name: models.QUERIES[name](spark, sf_dir).collect() for name in ("svd_nobias", "pcr_loo", "tensor_rank_one", "procrustes_match")}
    assert [r.variance for r in got["svd_nobias"]] == pytest.approx(list(multivariate.svd_nobias(x.T)[1]), rel=1e-6)
    assert [r.rss for r in got["pcr_loo"]] == pytest.approx([multivariate.pcr_loo(x, y, k) for k in (1, 2, 4)], rel=1e-8)
    z = ((y - y.mean()) @ x).reshape(8, -1)
    assert got["tensor_rank_one"][0].size == pytest.approx(np.linalg.svd(z)[1][0])
    assert len(got["procrustes_match"]) == 3


def test_logdet_of_the_whole_embedding(spark, sf_dir):
    from lodestat.plans import models

    x = np.array(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding").toPandas()["embedding"].tolist(), dtype=float)
    x = x - x.mean(axis=0)
    assert x.shape[1] > models.DIMS
    assert models.QUERIES["logdet"](spark, sf_dir).first().logdet == pytest.approx(np.linalg.slogdet(x.T @ x)[1], rel=1e-8)


def test_imputation_models_use_all_users_and_days(spark, sf_dir):
    from lodestat.plans import models, tables

    x = tables.days(spark, sf_dir).toPandas().pivot(index="user_id", columns="day", values="value").to_numpy(dtype=float)
    mean = imputation.ecm_mle(x)[0]
    assert {r.i: r.mean_i for r in models.QUERIES["ecm_mle"](spark, sf_dir).collect()} == pytest.approx(dict(enumerate(mean, 1)))
    assert [r.error for r in models.QUERIES["impute_svd_modeltest"](spark, sf_dir).collect()] == pytest.approx([e for _, e in imputation.hold_out_errors(x, "soft", 20, 3)])
    assert sorted(r.time for r in models.QUERIES["lmm_bootstrap_impute"](spark, sf_dir).collect()) == list(range(2, 31))
