"""Bootstraps of partial correlations: all replicates of the operator's default, draws that do not hang on partitions, and a known spread."""

import math

import numpy as np
from pyspark.sql import functions as F

from lodestat.operators import resampled
from lodestat.plans import models


def test_partial_correlation_takes_two_thousand_replicates(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(models, "_terms", lambda reps: reps)
    got = models.QUERIES["pcorr_boot"](spark, sf_dir).collect()
    assert sorted(x.rep for x in got) == list(range(1, 2001))
    assert all(math.isfinite(x.stat) and abs(x.stat) <= 1 for x in got) and len({x.stat for x in got}) == 2000


def test_partial_correlations_on_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(resampled, "BUCKET", 100)
    rng = np.random.default_rng(3)
    z, n = rng.normal(size=(1500, 4)), 1500
    c, y = z[:, 2], z[:, 0] + z[:, 2]
    x, t = z[:, 1] + 0.5 * z[:, 0] + z[:, 2] + 1e6, z[:, 3]
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(zip(y, x, c, t, strict=True))], "id int, y double, x double, c double, t double")
    df = df.union(spark.createDataFrame([(n, None, 1.0, 1.0, 1.0), (n + 1, float("nan"), 1.0, 1.0, 1.0)], df.schema))
    a, b = (sorted(map(tuple, resampled.pcorr_boot(df.repartition(m), "y", "x", ["c"], ["id"], reps=200).collect())) for m in (1, 5))
    assert [r[:2] for r in a] == [(k, "partial") for k in range(1, 201)] and np.allclose([r[2] for r in a], [r[2] for r in b], rtol=1e-9)
    r = np.corrcoef(*[v - np.polyval(np.polyfit(c, v, 1), c) for v in (y, x - 1e6)])[0, 1]
    stats = np.array([v[2] for v in a])
    se = (1 - r * r) / math.sqrt(n)
    assert abs(stats.mean() - r) < 4 * se / math.sqrt(200) + 0.1 * se and 0.8 < stats.std() / se < 1.2
    change = [v.stat for v in resampled.pcorr_boot(df, "y", "x", ["c"], ["id"], tried="t", reps=20).collect()]
    assert len(change) == 20 and max(map(abs, change)) < 0.02
    assert resampled.pcorr_boot(df.filter("id < 0"), "y", "x", ["c"], ["id"], reps=5).collect() == []
    assert [v.stat for v in resampled.pcorr_boot(df.withColumn("x", F.lit(1.0)), "y", "x", ["c"], ["id"], reps=2).collect()] == [None, None]
