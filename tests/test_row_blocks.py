"""Models of incomplete tables by patterns and row blocks against their dense forms."""

import numpy as np
import pytest

from lodestat.operators import ecm, factor, imputation


def holes(seed, n, d, rank=2, share=0.2, noise=0.05):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, d)) + noise * rng.normal(size=(n, d))
    y = x.copy()
    y[rng.random(x.shape) < share] = np.nan
    return x, y


def frame(spark, y, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "row int, x array<double>").repartition(parts)


def dense_em(x, rounds=50, tol=1e-8):
    """EM row by row, without patterns or sums."""
    x = x[np.isfinite(x).any(axis=1)]
    n, d = x.shape
    mean = np.nanmean(x, axis=0)
    dev = np.nan_to_num(x - mean)
    cov, before = dev.T @ dev / n, None
    for _ in range(rounds):
        filled, extra, like = x.copy(), np.zeros((d, d)), 0.0
        for i in range(n):
            o = np.isfinite(x[i])
            inv = np.linalg.inv(cov[np.ix_(o, o)])
            r = x[i, o] - mean[o]
            like += 0.5 * (np.linalg.slogdet(cov[np.ix_(o, o)])[1] + o.sum() * np.log(2 * np.pi) + r @ inv @ r)
            filled[i, ~o] = mean[~o] + cov[np.ix_(~o, o)] @ inv @ r
            extra[np.ix_(~o, ~o)] += cov[np.ix_(~o, ~o)] - cov[np.ix_(~o, o)] @ inv @ cov[np.ix_(o, ~o)]
        mean = filled.mean(axis=0)
        cov = ((filled - mean).T @ (filled - mean) + extra) / n
        if before is not None and abs(before - like) < tol * max(abs(like), 1.0):
            break
        before = like
    return mean, cov, like


@pytest.mark.parametrize("local", [1 << 30, 0])
def test_ecm_by_patterns_equals_the_dense_form(spark, monkeypatch, local):
    monkeypatch.setattr(ecm, "HELD", 3)
    _, y = holes(1, 80, 4, noise=0.5)
    y[5] = np.nan
    mean, cov, like = dense_em(y)
    got = ecm.ecm_rows(frame(spark, y), "x", 4, local_bytes=local)
    assert np.allclose(got[0], mean, atol=1e-8) and np.allclose(got[1], cov, atol=1e-8) and got[2][-1] == pytest.approx(like)
    assert np.allclose(ecm.ecm_array(y)[0], mean, atol=1e-8)
    assert all(b <= a + 1e-9 for a, b in zip(got[2], got[2][1:], strict=False))
    assert ecm.objective(frame(spark, y), "x", mean, cov) <= like + 1e-9


def test_ecm_with_fewer_rows_than_columns_and_flat_columns(spark):
    _, y = holes(2, 6, 9)
    y[:, 3] = 2.0
    mean, cov, _ = ecm.ecm_rows(frame(spark, y), "x", 9)
    assert np.isfinite(mean).all() and np.linalg.eigvalsh(cov)[0] > 0 and mean[3] == pytest.approx(2.0)
    assert np.allclose(mean, ecm.ecm_array(y)[0])
    empty = ecm.ecm_rows(frame(spark, y).filter("row < 0"), "x", 9)
    assert np.isnan(empty[0]).all() and empty[2] == []
    assert np.isnan(ecm.ecm_rows(frame(spark, np.full((3, 2), np.nan)), "x", 2)[0]).all()


def test_row_blocks_equal_one_matrix_and_soft_thresholds(spark):
    x, y = holes(3, 120, 6)
    rows = frame(spark, y, 5)
    mean, sd = np.nanmean(y, axis=0), np.nanstd(y, axis=0, ddof=1)
    z = (y - mean) / sd
    model = factor.fit_rows(rows, "x", 6, 3, 0.5, tol=1e-12, rounds=300)
    dense, errors = factor.fit_array(z, 3, 0.5, rounds=300, tol=1e-12)
    assert np.allclose(model.factor, dense, atol=1e-6) and np.allclose(model.errors, errors)
    assert all(b <= a + 1e-6 for a, b in zip(errors[2:], errors[3:], strict=False)) or len(errors) > 3
    # Full rank and a ridge: the fit of soft-thresholded singular values.
    lam = 3.0
    model = factor.fit_rows(rows, "x", 6, 6, lam, rounds=400, tol=1e-13)
    got = np.array([r.filled for r in factor.filled(rows, "x", model, ["row"]).orderBy("row").collect()])
    want = imputation.soft_impute(z, lam, rounds=3000, tol=1e-14) * sd + mean
    assert np.abs(got - want).max() < 2e-3
    assert np.allclose(got[np.isfinite(y)], y[np.isfinite(y)])


def test_planted_ranks_are_recovered(spark):
    x, y = holes(4, 200, 8, noise=0.01)
    rows, gone = frame(spark, y), ~np.isfinite(y)
    hard = factor.fit_rows(rows, "x", 8, 2, 1e-6, rounds=300, tol=1e-12)
    got = np.array([r.filled for r in factor.filled(rows, "x", hard, ["row"]).orderBy("row").collect()])
    assert np.sqrt(np.mean((got - x)[gone] ** 2)) < 0.2
    path = list(factor.soft_path(rows, "x", 8, 6))
    assert [m.penalty for m in path] == sorted([m.penalty for m in path], reverse=True) and path[-1].errors[-1] < path[0].errors[-1]
    odd = frame(spark, np.array([[np.nan] * 8, [1.0] * 8]))
    assert len(factor.filled(odd, "x", hard, ["row"]).collect()) == 2
