"""Split halves by class moments against fits on the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import classify, halves
from lodestat.operators.multivariate import rspm_array


def two_classes(seed=1, n=400, d=6):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    root = rng.normal(size=(2, d, d)) * 0.4 + np.eye(d)
    x = np.array([rng.normal(size=d) @ root[c] + c * np.linspace(0.2, 1.2, d) for c in y])
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, y int").repartition(4)


def pair(x, y):
    return halves.Moments.rows(x[y == 0]), halves.Moments.rows(x[y == 1])


@pytest.mark.parametrize("kind", ["L2", "L1", "NR"])
def test_quadratic_models_equal_those_of_rows(kind):
    x, y = two_classes()
    got, want = halves.quadratic(pair(x, y), kind, first=4), classify.qd_models(x, y, kind, first=4)
    assert [s for s, _ in got] == [s for s, _ in want]
    for (_, m), (_, w) in zip(got, want, strict=True):
        assert list(m[1][0]) == list(w["cols"])
        assert np.allclose(halves.scores(m, x), classify.qd_scores(w, x), atol=1e-6)
        assert np.allclose(halves.map_of(m, pair(x, y)), classify.qd_map(w, x), atol=1e-6)


def test_linear_models_equal_those_of_rows():
    x, y = two_classes(2)
    for got, want in ((halves.linear_ridge(pair(x, y)), classify.ld_ridge(x, y)), (halves.linear_components(pair(x, y)), classify.ld_plain(x, y))):
        assert len(got) == len(want)
        for (s, m), (t, w, c) in zip(got, want, strict=True):
            assert s == pytest.approx(t) and np.allclose(m[1], w, atol=1e-9) and m[2] == pytest.approx(c)


@pytest.mark.parametrize("method", ["qd_l2", "ld_l2"])
@pytest.mark.parametrize("posterior", [False, True])
def test_curves_equal_brute_force(spark, monkeypatch, method, posterior):
    monkeypatch.setattr(halves, "BLOCK", 37)
    x, y = two_classes(3)
    df = frame(spark, x, y)
    curves, maps = halves.split_half_paths(df, "id", "x", "y", method, 6, reps=70 if method == "ld_l2" else 3, posterior=posterior)
    got = {(r.rep, r.step): r for r in curves.collect()}
    member = {r.id: (r.bits, r.out) for r in df.select("id", F.xxhash64(F.lit(1), F.lit(0), "id").alias("b0"), F.xxhash64(F.lit(1), F.lit(1), "id").alias("b1"), (F.pmod(F.xxhash64(F.lit(1), F.lit(-1), "id"), F.lit(5)) == 0).alias("out")).select("id", F.array("b0", "b1").alias("bits"), "out").collect()}
    out = np.array([member[i][1] for i in range(len(x))])

    def rate(model, at):
        z = halves.scores(model, x[at])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.where(y[at] == 1, p, 1 - p).sum() if posterior else ((z > 0) == (y[at] == 1)).sum()

    reference = halves.FITS[method](pair(x[~out], y[~out]))
    for rep in (0, 2, *([69] if method == "ld_l2" else [])):
        one = np.array([(member[i][0][rep // 64] >> (rep % 64)) & 1 == 1 for i in range(len(x))]) & ~out
        two = ~one & ~out
        paths = [halves.FITS[method](pair(x[h], y[h])) for h in (one, two)]
        for k in range(len(reference)):
            r = got[rep, k + 1]
            assert r.p == pytest.approx((rate(paths[0][k][1], two) + rate(paths[1][k][1], one)) / (~out).sum())
            assert r.g == pytest.approx((rate(paths[0][k][1], out) + rate(paths[1][k][1], out)) / 2 / out.sum())
            ref = halves.map_of(reference[k][1], pair(x[~out], y[~out]))
            a, b = (halves.map_of(p[k][1], pair(x[h], y[h])) for p, h in zip(paths, (one, two), strict=True))
            assert r.r == pytest.approx(rspm_array(a * np.sign(a @ ref), b * np.sign(b @ ref))[0], abs=1e-6)
    assert maps.count() == len(reference) * 6


def test_too_few_rows(spark):
    x, y = two_classes(4, 40)
    df = frame(spark, x, y)
    for rows in (df.filter("id < 0"), df.filter("y = 1"), df.limit(2)):
        curves, maps = halves.split_half_paths(rows, "id", "x", "y", "qd_l2", 6)
        assert curves.count() == 0 and maps.count() == 0
    curves, _ = halves.split_half_paths(df, "id", "x", "y", "ld_l2", 6, reps=2, held=False)
    assert {r.g for r in curves.collect()} == {None}
