"""Parcels over voxels, times and subjects: planted parcels and maps are recovered and the likelihood never falls."""

import numpy as np
import pytest

from lodestat.operators import parcels


def planted(seed=1, voxels=90, k=3, s=4, t=20, noise=0.4):
    """Parcels whose courses share H'H over subjects, with scales by voxel and by subject."""
    rng = np.random.default_rng(seed)
    h = np.array([[2.0, 0.5, 0.0], [0.0, 1.5, 0.3], [0.0, 0.0, 1.2]]) * 3
    scale = rng.uniform(0.6, 1.6, (s, k))
    course = np.empty((s, k, t))
    for i in range(s):
        q, _ = np.linalg.qr(rng.normal(size=(t, k)))
        course[i] = (q @ h * scale[i]).T
    label, w = np.arange(voxels) % k, rng.uniform(0.5, 1.5, voxels)
    x = course[:, label].transpose(1, 0, 2) * w[:, None, None] + noise * rng.normal(size=(voxels, s, t))
    return x, label, w, course


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v.ravel()]) for i, v in enumerate(x)], "voxel int, x array<double>").repartition(4)


def agreement(a, b):
    return np.mean([len(set(b[a == c])) == 1 for c in set(a)]) == 1 and len(set(a)) == len(set(b))


@pytest.mark.parametrize("kind", parcels.KINDS)
def test_planted_parcels_and_likelihood(spark, kind):
    x, label, w, _ = planted(noise=0.2)
    if kind == "plain":
        x = x / w[:, None, None]
    rows = frame(spark, x)
    model = parcels.fit(rows, 4, 20, 3, kind, rounds=15, start=[0, 1, 2])
    got = parcels.labelled(rows, model).toPandas().sort_values("voxel")
    assert agreement(got.cluster.to_numpy(), label)
    trace = model.loglik
    assert len(trace) > 2 and all(b >= a - 1e-6 * abs(a) for a, b in zip(trace, trace[1:], strict=False))
    if kind in ("shared", "network"):
        for p in model.basis:
            assert np.allclose(p.T @ p, np.eye(3), atol=1e-9)
        assert np.allclose(np.einsum("stj,jk,sk->skt", model.basis, model.common, model.scale), model.course)
    if kind != "plain":
        assert np.corrcoef(got.scale, w / np.array([w[label == c].mean() for c in range(3)])[label])[0, 1] > 0.5


def test_subject_maps_and_fixed_parcels(spark):
    x, label, w, course = planted(2)
    rows = frame(spark, x)
    fixed = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label[:80])], "voxel int, cluster int")
    model = parcels.fit(rows, 4, 20, 3, "network", rounds=20, parcels=fixed)
    for s in range(4):
        for c in range(3):
            assert abs(np.corrcoef(model.course[s, c], course[s, c])[0, 1]) > 0.97
    maps = parcels.subject_maps(rows, model, ["a", "b", "c", "d"]).toPandas()
    own = maps[maps.cluster == label[maps.voxel]]
    assert len(maps) == 90 * 4 * 3 and own.r.mean() > 0.8
    assert np.corrcoef(own.groupby("voxel").weight.mean(), w)[0, 1] > 0.8


def test_sums_do_not_depend_on_blocks_and_kmeans_starts(spark):
    x, label, _, _ = planted(3, noise=0.2)
    model = parcels.started(x[[0, 1, 2]].transpose(1, 0, 2), "network")
    assert np.allclose(parcels.voxel_sums(x, model), parcels.voxel_sums(x[:40], model) + parcels.voxel_sums(x[40:], model))
    rows = frame(spark, x)
    model = parcels.fit(rows, 4, 20, 3, "network", rounds=10, starts=3)
    assert agreement(parcels.labelled(rows, model).toPandas().sort_values("voxel").cluster.to_numpy(), label)
    with pytest.raises(ValueError):
        parcels.fit(rows, 4, 20, 3, "other")
    with pytest.raises(ValueError, match="as many times"):
        parcels.started(np.zeros((2, 5, 3)), "shared")


def test_long_rows_become_voxels(spark):
    long = spark.createDataFrame([(v, s, t, float(v + 10 * s + 100 * t)) for v in range(3) for s in "ab" for s in [ord(s) - 97] for t in range(2)], "v int, s int, t int, y double")
    rows, subjects, times = parcels.voxel_rows(long.filter("NOT (v = 1 AND s = 1 AND t = 1)"), "v", "s", "t", "y")
    assert subjects == [0, 1] and times == [0, 1]
    assert {r.voxel: list(r.x) for r in rows.collect()} == {0: [0.0, 100.0, 10.0, 110.0], 1: [1.0, 101.0, 11.0, 0.0], 2: [2.0, 102.0, 12.0, 112.0]}
