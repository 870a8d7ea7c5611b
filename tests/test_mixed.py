"""Mixed models by subject blocks against dense fits, and their bootstraps."""

import numpy as np
import pandas as pd
import pytest

from lodestat.operators import mixed
from lodestat.operators import resampled as R


def panel(seed=1, subjects=60, slopes=True, holes=0.15):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(subjects):
        b = rng.multivariate_normal([0, 0], [[2.0, 0.5], [0.5, 0.6 if slopes else 0.51]])
        for t in range(5):
            g, x = s % 2, rng.normal()
            y = 1 + 0.5 * t + g + 0.3 * g * t + 0.2 * x + b[0] + (b[1] * t if slopes else 0) + rng.normal()
            rows.append((s, t, g, float(x), None if rng.random() < holes else float(y)))
    return rows


SCHEMA = "subj int, t int, g int, x double, y double"


def dense(rows, fixed, random):
    """(coefficients, sigma2, psi) by minimising the REML criterion of the whole covariance matrix."""
    d = pd.DataFrame(rows, columns=["subj", "t", "g", "x", "y"]).dropna()
    d = d.assign(**{"1": 1.0, "t:g": d.t * d.g})
    x, y = d[fixed].to_numpy(float), d.y.to_numpy(float)
    groups = [np.flatnonzero(d.subj.to_numpy() == s) for s in d.subj.unique()]
    z, q = d[random].to_numpy(float), len(random)

    def value(theta):
        root = np.zeros((q, q))
        root[np.diag_indices(q)] = np.exp(theta[:q])
        root[np.tril_indices(q, -1)] = theta[q:]
        xx, xy, yy, logs = np.zeros((x.shape[1],) * 2), np.zeros(x.shape[1]), 0.0, 0.0
        for at in groups:
            v = np.eye(len(at)) + z[at] @ root @ root.T @ z[at].T
            inv = np.linalg.inv(v)
            xx, xy, yy, logs = xx + x[at].T @ inv @ x[at], xy + x[at].T @ inv @ y[at], yy + y[at] @ inv @ y[at], logs + np.linalg.slogdet(v)[1]
        b = np.linalg.solve(xx, xy)
        rss, free = yy - b @ xy, len(y) - x.shape[1]
        return free * np.log(rss / free) + logs + np.linalg.slogdet(xx)[1], b, rss / free, root

    theta, step = np.zeros(q * (q + 1) // 2), 1.0
    best = value(theta)[0]
    while step > 1e-5:  # pattern search
        for i in range(len(theta)):
            for sign in (1, -1):
                trial = theta.copy()
                trial[i] += sign * step
                if (v := value(trial)[0]) < best - 1e-12:
                    theta, best = trial, v
                    break
            else:
                continue
            break
        else:
            step /= 2
    _, b, s2, root = value(theta)
    return b, s2, root @ root.T * s2


@pytest.mark.parametrize(("text", "fixed", "random"), [("y ~ t + g + t:g + (1 | subj)", ["1", "t", "g", "t:g"], ["1"]), ("y ~ t + x + (1 + t | subj)", ["1", "t", "x"], ["1", "t"])])
def test_fit_equals_the_dense_criterion(spark, monkeypatch, text, fixed, random):
    monkeypatch.setattr(mixed, "BUCKET", 7)
    rows = panel()
    got = {r.term: r for r in mixed.fit(spark.createDataFrame(rows, SCHEMA).repartition(4), text).collect()}
    b, s2, psi = dense(rows, fixed, random)
    for name, v in zip(fixed, b, strict=True):
        assert got[mixed.INTERCEPT if name == "1" else name].estimate == pytest.approx(v, abs=2e-4)
    assert got["residual"].estimate == pytest.approx(s2, rel=2e-3)
    names = [mixed.INTERCEPT if n == "1" else n for n in random]
    for i in range(len(random)):
        for j in range(i, len(random)):
            assert got[f"var({names[i]},{names[j]})"].estimate == pytest.approx(psi[i, j], rel=5e-3, abs=2e-3)


def test_draws_are_multinomial_and_repeat(spark, monkeypatch):
    monkeypatch.setattr(mixed, "BUCKET", 7)
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "subject int, v array<double>")
    kernel = lambda v, w, reps, rng: np.column_stack([w @ v, (w * w) @ np.ones(len(v))])
    with mixed.Resampler(df.repartition(3)) as one, mixed.Resampler(df.repartition(5)) as two:
        plan = [(r, 0) for r in range(400)]
        a, b = one.sums(kernel, plan), two.sums(kernel, plan)
        assert np.array_equal(a, b) and (a[:, 0] == 50).all()
        assert np.array_equal(one.sums(kernel, [(7, 0), (8, 1)])[0], a[7]) and not np.array_equal(one.sums(kernel, [(8, 1)])[0], a[8])
    assert abs(a[:, 1].mean() / 50 - 24.5) < 0.4 and abs(a[:, 1].std() / 50 - np.sqrt((50**2 - 1) / 12 / 50)) < 0.2
    assert abs(a[:, 2].mean() - 99) < 2  # sum of squared counts: n + n (n - 1) / n


def test_bootstrap_equals_refits_on_the_drawn_subjects(spark):
    rows = panel(2, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixed.bootstrap(df, "y ~ t + g + (1 + t | subj)", reps=6, contrasts=[("t", "g")]).toPandas().pivot(index="rep", columns="term", values="stat")
    spec = mixed.formula("y ~ t + g + (1 + t | subj)")
    blocks = mixed.subject_blocks(df, spec)
    with mixed.Resampler(blocks) as sampler:
        ids = np.array([r.subject for r in sampler.dealt.orderBy("bucket", "subject").collect()])
        counts = sampler.sums(lambda v, w, reps, rng: w, [(r, 0) for r in range(6)])
    for rep in range(6):
        drawn, n = [], 0
        for s, w in zip(ids, counts[rep], strict=True):
            for _ in range(int(w)):
                drawn += [(n, *r[1:]) for r in rows if r[0] == s]
                n += 1
        b, _, _ = dense(drawn, ["1", "t", "g"], ["1", "t"])
        assert np.allclose(got.loc[rep, [mixed.INTERCEPT, "t", "g"]].to_numpy(float), b, atol=3e-3)
    assert np.allclose(got["g - t"], got["g"] - got["t"])


def test_ill_conditioned_draws_are_redrawn(spark):
    rows = [(s, t, int(s < 2), 0.0, float(s + t + (s * 7 + t * 3) % 5)) for s in range(8) for t in range(3)]  # g is often the same in all drawn subjects
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixed.bootstrap(df, "y ~ t + g + (1 | subj)", reps=60).toPandas()
    assert got.rep.nunique() == 60 and got.stat.abs().max() < 1e4
    with pytest.raises(ValueError, match="prone to collapse"):
        mixed.bootstrap(df.withColumn("x", df.t.cast("double")), "y ~ t + x + (1 | subj)", reps=5)


def test_time_courses_and_controls(spark):
    rows = panel(3, 50)
    df = spark.createDataFrame(rows, SCHEMA)
    d = pd.DataFrame(rows, columns=["subj", "t", "g", "x", "y"]).pivot(index="subj", columns="t", values="y")
    got = mixed.time_courses(df, "y ~ t + (1 | subj)", "t", reps=300).toPandas()
    mean = got.groupby(["how", "time"])[["mean", "change"]].mean()
    whole = d.dropna()
    for t in range(5):
        assert mean.loc[("listwise", t), "mean"] == pytest.approx(whole[t].mean(), abs=0.12)
        assert mean.loc[("pairwise", t), "mean"] == pytest.approx(d[t].mean(), abs=0.12)
        assert mean.loc[("pairwise", t), "change"] == pytest.approx((d[t] - d[0]).mean(), abs=0.15)
        assert abs(mean.loc[("imputed", t), "mean"] - d[t].mean()) < 0.6
    controls = spark.createDataFrame([(i, 2.0 + (i % 5) * 0.1, float(i % 3)) for i in range(30)], "id int, y double, x double")
    diff = mixed.against_controls(df, controls, "y ~ t + (1 | subj)", "t", reps=200).toPandas().groupby(["how", "time"])["diff"].mean()
    for t in range(5):
        assert diff["pairwise", t] == pytest.approx(d[t].mean() - 2.2, abs=0.12)
        assert diff["listwise", t] == pytest.approx(whole[t].mean() - 2.2, abs=0.15)
    cross = mixed.against_controls(df.withColumn("x", df.g.cast("double")), controls, "y ~ t + (1 | subj)", "t", ["x"], reps=100).toPandas()
    assert len(cross) == 100 * 3 * 5 and cross["diff"].notna().all()


def test_edges(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0, None)], SCHEMA)
    assert mixed.fit(df, "y ~ t + (1 | subj)").count() == 0
    assert mixed.bootstrap(df, "y ~ t + (1 | subj)", reps=3).count() == 0
    assert mixed.formula("y ~ 0 + a + a:b + (0 + a | s)") == mixed.Formula("y", ("a", "a:b"), ("a",), "s")


def test_imputation_by_blocks_of_subjects(spark):
    """Sums over blocks give the fits and fills of whole replicates; with so many fills no matrix of them could be held."""
    g = np.random.default_rng(5)
    y = g.normal(size=(40, 1)) + np.arange(4.0) + g.normal(size=(40, 4))
    y[g.random(y.shape) < 0.3] = np.nan
    y[7] = np.nan
    df = spark.createDataFrame([(i, t, None if np.isnan(y[i, t]) else float(y[i, t])) for i in range(40) for t in range(4)], "s int, t int, y double")
    got = {(r.rep, int(r.time)): (r.mean, r.change) for r in R.mixed_bootstrap_impute(df, "y", "t", "s", 3, fills=10**12).collect()}
    drawn = R.subject_draws(df, "s", 3).toPandas()
    assert len(got) == 12
    for rep, pdf in drawn.groupby("rep"):
        v = pdf.pivot_table(index="clone", columns="t", values="y", dropna=False).to_numpy(float)
        at = np.argwhere(np.isfinite(v))
        b, vs, vr = R.fit_random_intercept(v[at[:, 0], at[:, 1]], np.eye(4)[at[:, 1]], at[:, 0])
        shrunk = np.nansum(v - b, axis=1) * vs / (np.isfinite(v).sum(axis=1) * vs + vr)
        mean = np.where(np.isfinite(v), v, b + shrunk[:, None]).mean(axis=0)
        assert np.allclose([got[rep, t] for t in range(4)], np.column_stack([mean, mean - mean[0]]), atol=1e-4)


def test_all_trial_values_come_from_one_pass(spark, monkeypatch):
    """Subjects with few different Z'Z: one pass over the draws, with the sums that passes at each trial value give."""
    df = spark.createDataFrame(panel(3), SCHEMA)
    for text in ("y ~ t + g + (1 | subj)", "y ~ t + (1 + t | subj)"):
        spec = mixed.formula(text)
        q, m = len(spec.random), len(spec.random) + len(spec.fixed) + 1
        with mixed.Resampler(mixed.subject_blocks(df, spec)) as sampler:
            attempts = [(r, r % 2) for r in range(6)]
            trials = np.random.default_rng(1).normal(size=(6, 3, q * (q + 1) // 2))
            want = sampler.sums(mixed._kernel(q, m, trials), attempts).reshape(6, 3, -1)
            few = mixed.ClassSums.of(sampler, q, m, 6)
            assert np.allclose(few.sums(trials, attempts), want, rtol=1e-9, atol=1e-9)
    passes, sums = [], mixed.Resampler.sums
    monkeypatch.setattr(mixed.Resampler, "sums", lambda self, kernel, attempts: passes.append(attempts) or sums(self, kernel, attempts))
    assert mixed.bootstrap(df, "y ~ t + g + (1 | subj)", 20).count() == 60
    assert len(passes) == 2  # the whole sample, and the replicates
