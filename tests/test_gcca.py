"""Generalised CCA from cross-products against the form that holds the samples."""

import numpy as np

from lodestat.operators import gcca, multivariate


def data(seed=1, n=80, subjects=4, d=5):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=(n, 2))
    return [common @ rng.normal(size=(2, d)) + 0.6 * rng.normal(size=(n, d)) + s for s in range(subjects)]


def frame(spark, blocks):
    x = np.concatenate(blocks, axis=1)
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>").repartition(3)


def table(df, k):
    out = df.toPandas().pivot(index="id", columns="component", values="value").to_numpy()
    assert out.shape[1] == k
    return out


def test_variates_equal_the_dense_form(spark):
    blocks = data()
    rows, found = gcca.fit_rows(frame(spark, blocks), "id", "x", 4, 3, 2)
    vec, val, corr = multivariate.gcca(blocks, 3, 2)
    got = table(rows, 2)
    assert np.allclose(np.abs((got * vec).sum(axis=0)), 1) and np.allclose(found.value, val) and np.allclose(found.correlation, corr)


def test_halves_equal_the_dense_form(spark):
    blocks = data(2)
    (k, r, rows), (k2, _, _) = gcca.resample_rows(frame(spark, blocks), "id", "x", 4, [3, 4], 2, splits=10)
    rep, z = multivariate.gcca_resample(blocks, 3, 2, 10)
    assert (k, k2) == (3, 4) and np.allclose(r, rep)
    got = table(rows, 2)
    assert np.allclose(np.abs((got * z).sum(axis=0)), (z * z).sum(axis=0), rtol=1e-6)


def test_strata_and_rank(spark):
    rng = np.random.default_rng(1)
    for _ in range(20):
        one, two = gcca.halves_of(9, rng, list("aaaabbbbb"))
        assert sorted([*one, *two]) == list(range(9)) and (one < 4).sum() == 2 and (two < 4).sum() == 2
    blocks = data(3)
    blocks[1][:, 2:] = 7.0  # flat columns
    _, found = gcca.fit_rows(frame(spark, blocks), "id", "x", 4, 5, 3)
    assert np.isfinite(found.coef).all() and found.coef.shape[1] == 3
