"""PLS correlation of whole tables against the forms in memory."""

import numpy as np
import pytest

from lodestat.operators import mixed, multivariate, plsc


def data(seed=1, n=200, p=6, q=3):
    rng = np.random.default_rng(seed)
    c = rng.integers(0, 2, n)
    t = rng.normal(size=n)
    x = rng.normal(size=(n, p)) + np.outer(t * (1 + c), np.linspace(1, -0.5, p)) + 3
    y = rng.normal(size=(n, q)) + np.outer(t, [1.0, 0.2, -0.8]) - 2
    return x, y, c


def frame(spark, x, y, c, extra=()):
    rows = [(i, [float(v) for v in a], [float(v) for v in b], int(k)) for i, (a, b, k) in enumerate(zip(x, y, c, strict=True))]
    return spark.createDataFrame([*rows, *extra], "id int, x array<double>, y array<double>, c int").repartition(4)


def same_axes(a, b):
    return np.allclose(np.abs(a), np.abs(b), atol=1e-8) and np.allclose(np.abs((a * b).sum(axis=0)), 1, atol=1e-8)


def test_behaviour_equals_the_dense_form(spark, monkeypatch):
    monkeypatch.setattr(mixed, "BUCKET", 60)
    x, y, c = data()
    got = plsc.analyse(frame(spark, x, y, c, [(900, None, [1.0] * 3, 0), (901, [float("nan")] * 6, [1.0] * 3, 1)]), "id", "x", "y", 6, 3, "c", 2, 200, 300)
    want = multivariate.plsc(x, y, c, np.arange(len(x)), 2, 200, 300)
    assert np.allclose(got["singular"], want["singular"]) and np.allclose(got["fraction"], want["fraction"]) and np.allclose(got["var_frac"], want["var_frac"])
    assert same_axes(got["x_salience"], want["x_salience"]) and same_axes(got["y_salience"], want["y_salience"])
    assert got["p"][0] == want["p"][0] == 1 / 201
    # The bootstrap's spread agrees up to its own sampling error.
    ratio = np.abs(got["bsr"][:, 0]) / np.abs(want["bsr"][:, 0])
    assert 0.75 < np.median(ratio) < 1.33


def test_permutations_hold_their_level(spark, monkeypatch):
    monkeypatch.setattr(mixed, "BUCKET", 40)
    rng = np.random.default_rng(5)
    ps = []
    for k in range(6):
        x, y = rng.normal(size=(120, 4)), rng.normal(size=(120, 2))
        ps.append(plsc.analyse(frame(spark, x, y, np.zeros(120, int)), "id", "x", "y", 4, 2, None, 1, 99, 0, seed=k)["p"][0])
    assert min(ps) > 0.01 and np.mean(ps) > 0.2


def test_task_and_repeated_rows(spark):
    x, y, c = data(2)
    got = plsc.analyse_task(frame(spark, x, y, c), "id", "x", 6, "c", factors=1, perms=50, boots=50)
    want = multivariate.plsc_task(x, c, np.arange(len(x)), factors=1, perms=50, boots=50)
    assert np.allclose(got["singular"], want["singular"]) and same_axes(got["x_salience"], want["x_salience"]) and got["groups"] == [0, 1]
    twice = frame(spark, x, y, c).unionByName(frame(spark, x, y, c))
    assert np.allclose(plsc.analyse(twice, "id", "x", "y", 6, 3, "c", 2, 0, 0)["singular"], plsc.analyse(frame(spark, x, y, c), "id", "x", "y", 6, 3, "c", 2, 0, 0)["singular"])
    none = plsc.analyse(frame(spark, x, y, c).filter("id < 0"), "id", "x", "y", 6, 3, None)
    assert none["x_salience"].shape == (6, 2) and not none["singular"].any()


def test_trilinear_equals_the_dense_form(spark):
    x, y, _ = data(3)
    got = plsc.analyse_trilinear(frame(spark, x, y[:, :1], np.zeros(len(x), int)), "id", "x", "y", (2, 3), 3, 100)
    want = multivariate.npls(x.reshape(-1, 2, 3), y[:, 0], 3)
    for g, (a, b, c) in zip(got, want, strict=True):
        assert g["covariance"] == pytest.approx(c) and np.allclose(np.abs(g["first"]), np.abs(a)) and np.allclose(np.abs(g["second"]), np.abs(b))
    assert np.abs(got[0]["second_bsr"]).max() > 3
