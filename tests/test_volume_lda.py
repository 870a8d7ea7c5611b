"""Group discriminant maps in sample space against the form that holds all voxels, and from files to a map file."""

import struct

import numpy as np
import pandas as pd
import pytest

from lodestat.operators import multivariate, volume_lda
from lodestat.sources import nifti


def study(seed=1, subjects=6, times=12, shape=(4, 3, 2)):
    rng = np.random.default_rng(seed)
    effect = rng.normal(size=shape)
    runs, onsets = [], []
    for s in range(subjects):
        data = rng.normal(size=(*shape, times)) + 5
        for t in range(times):
            label = (-1, 1, 0)[t % 3]
            data[..., t] += 1.5 * label * effect
            onsets.append((s, t, label))
        runs.append(data)
    return effect, runs, onsets


def long(spark, runs):
    rows = [(s, x, y, z, t, float(d[x, y, z, t])) for s, d in enumerate(runs) for x, y, z, t in np.ndindex(d.shape)]
    return spark.createDataFrame(rows, "subject int, x int, y int, z int, t int, value double").repartition(4)


def held(runs, onsets):
    """Samples by voxels, each subject's mean removed, with subjects and classes."""
    x, subject, y = [], [], []
    for s, t, label in sorted(onsets):
        if label:
            x.append(runs[s][..., t].ravel())
            subject.append(s)
            y.append(int(label == 1))
    x, subject = np.array(x), np.array(subject)
    for s in set(subject):
        x[subject == s] -= x[subject == s].mean(axis=0)
    return x, subject, np.array(y)


def test_directions_and_maps_equal_those_over_voxels(spark):
    _, runs, onsets = study()
    mask = spark.createDataFrame([p for p in np.ndindex(4, 3, 2)], "x int, y int, z int")
    rows, subject, label = volume_lda.sample_rows(long(spark, runs), mask, spark.createDataFrame(onsets, "subject int, t int, label int"))
    s = volume_lda.sample_products(rows, subject, label)
    x, want_subject, y = held(runs, onsets)
    assert list(subject) == list(want_subject) and list(label) == list(y) and s.voxels == 24
    assert np.allclose(s.products, x @ x.T) and np.allclose(s.sums, x.sum(axis=1))
    at = np.flatnonzero(subject < 3)
    got, want = volume_lda.directions(s, at, 5) @ x, multivariate.lda_directions(x[at], y[at], 5)
    assert np.allclose(got, want, atol=1e-8)
    other = volume_lda.directions(s, np.flatnonzero(subject >= 3), 5)
    for k in range(5):
        r, z = volume_lda.reproducible(s, volume_lda.directions(s, at, 5)[k], other[k])
        want_r, want_z = multivariate.rspm_array(got[k], other[k] @ x)
        assert r == pytest.approx(want_r) and np.allclose(z @ x, want_z)


def test_files_to_a_map_file(spark, tmp_path):
    effect, runs, onsets = study(2)
    head = bytearray(nifti.volume(runs[0])[:352])
    struct.pack_into("<4f", head, 76, 1.0, 3.0, 3.0, 4.0)
    struct.pack_into("<12f", head, 280, *range(12))
    for s, d in enumerate(runs):
        (tmp_path / f"run{s}.nii").write_bytes(nifti.like(bytes(head), d))
    inside = np.ones((4, 3, 2))
    inside[0, 0, 0] = 0
    (tmp_path / "mask.nii").write_bytes(nifti.volume(inside))
    found, table = volume_lda.run_files(spark, {s: str(tmp_path / f"run{s}.nii") for s in range(6)}, str(tmp_path / "mask.nii"), spark.createDataFrame(onsets, "subject int, t int, label int"), str(tmp_path / "out"), splits=8)
    assert found.count() == 23 and {"k", "r", "p", "d"} == set(table[0])
    raw = (tmp_path / "out_LDA_SPM_group.nii").read_bytes()
    back = nifti.parse(raw)[..., 0]
    assert back.shape == (4, 3, 2) and back[0, 0, 0] == 0
    assert struct.unpack("<12f", raw[280:328]) == tuple(map(float, range(12))) and struct.unpack("<4f", raw[76:92]) == (1.0, 3.0, 3.0, 4.0)
    rows = found.toPandas()
    assert np.allclose(back[rows.x, rows.y, rows.z], rows.value)
    assert np.corrcoef(rows.value, effect[rows.x, rows.y, rows.z])[0, 1] > 0.8
    assert max(r["p"] for r in table) > 0.9


def test_without_classes_or_rows(spark):
    _, runs, onsets = study(3, 2, 6)
    voxels, mask = long(spark, runs), spark.createDataFrame([(0, 0, 0)], "x int, y int, z int")
    none = spark.createDataFrame([(s, t, 0) for s, t, _ in onsets], "subject int, t int, label int")
    assert volume_lda.group_map(voxels, mask, none)[0].count() == 0
    one = spark.createDataFrame([(s, t, 1) for s, t, _ in onsets], "subject int, t int, label int")
    found, table = volume_lda.group_map(voxels, mask, one)
    assert table == [] and pd.Series([r.value for r in found.collect()]).abs().max() == 0


def samples_of(x, subject, y):
    return volume_lda.Samples(subject, y, x @ x.T, x.sum(axis=1), x.shape[1])


def test_kernel_ridge_equals_the_primal():
    _, runs, onsets = study(4)
    x, subject, y = held(runs, onsets)
    s = samples_of(x, subject, y)
    at = np.flatnonzero(subject != 2)
    contrast = y[at] / y[at].sum() - (1 - y[at]) / (1 - y[at]).sum()
    contrast = contrast / np.linalg.norm(contrast)
    path = volume_lda.kernel_ridge(s, at, 5)
    assert len(path) == 5 and volume_lda.kernel_ridge(s, at[y[at] == 1]) == []
    for lam, a in path:
        want = np.linalg.solve(x[at].T @ x[at] + lam * np.eye(x.shape[1]), x[at].T @ contrast)
        assert np.allclose(a @ x, want, atol=1e-8)


def test_sample_variates_over_halves():
    effect, runs, onsets = study(5)
    x, subject, y = held(runs, onsets)
    s = samples_of(x, subject, y)
    one, two = np.flatnonzero(subject < 3), np.flatnonzero(subject >= 3)
    table, z = volume_lda.sample_variates(s, one, two, [1, 2, 4, 8, 500], 0.4)
    assert [r["k"] for r in table] == [1, 2, 4, 8] and max(r["p"] for r in table) > 0.9
    assert abs(np.corrcoef(z @ x, effect.ravel())[0, 1]) > 0.8
    # By the features themselves, over voxels.
    u, size, vt = np.linalg.svd(x, full_matrices=False)
    f = u[:, : round(len(x) * 0.4)] * size[: round(len(x) * 0.4)]
    for row in table[:3]:
        maps = []
        for h in (one, two):
            d = multivariate.lda_directions(f[h], y[h], row["k"])[row["k"] - 1]
            maps.append(d @ vt[: f.shape[1]])
        assert abs(row["r"]) == pytest.approx(abs(np.corrcoef(maps[0], maps[1])[0, 1]), abs=1e-8)
    assert volume_lda.sample_variates(s, one[y[one] == 1], two, [1])[0] == []


def test_two_runs_and_maps_of_groups(spark, tmp_path):
    effect, runs, onsets = study(6, 2, 18)
    for s, d in enumerate(runs):
        (tmp_path / f"run{s}.nii").write_bytes(nifti.volume(d))
    (tmp_path / "mask.nii").write_bytes(nifti.volume(np.ones((4, 3, 2))))
    found, table = volume_lda.run_split_files(spark, (str(tmp_path / "run0.nii"), str(tmp_path / "run1.nii")), str(tmp_path / "mask.nii"), spark.createDataFrame(onsets, "run int, t int, label int"), str(tmp_path / "one"))
    rows = found.toPandas()
    assert np.corrcoef(rows.value, effect[rows.x, rows.y, rows.z])[0, 1] > 0.7 and table
    assert nifti.parse((tmp_path / "one_LDA_SPM.nii").read_bytes()).shape == (4, 3, 2, 1)
    rng = np.random.default_rng(7)
    paths, labels = {}, {}
    for s in range(14):
        labels[f"s{s}"] = s % 2
        paths[f"s{s}"] = str(tmp_path / f"map{s}.nii")
        (tmp_path / f"map{s}.nii").write_bytes(nifti.volume(effect * (s % 2) * 2 + rng.normal(size=effect.shape)))
    out, table = volume_lda.run_map_files(spark, paths, labels, str(tmp_path / "mask.nii"), str(tmp_path / "all"), splits=6)
    assert set(out) == {"Dmin", "Rmax", "Pmax"} and all((tmp_path / f"all_LDA_SPM_group_{n}.nii").exists() for n in out)
    rows = out["Dmin"].toPandas()
    assert abs(np.corrcoef(rows.value, effect[rows.x, rows.y, rows.z])[0, 1]) > 0.7 and len(table) > 1
