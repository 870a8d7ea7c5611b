"""Medians by counting, and plans without a task that holds a group."""

import numpy as np

from lodestat.functions.stats import medians
from lodestat.operators import outliers


def test_medians_are_exact(spark):
    g = np.random.default_rng(4)
    groups = {"even": g.normal(size=1000), "odd": g.normal(size=2001), "one": [3.0], "two": [1.0, 2.0], "same": [5.0] * 40, "tied": [0.0] * 50 + [1.0] * 50}
    df = spark.createDataFrame([(k, float(v)) for k, values in groups.items() for v in values] + [("one", None)], "k string, v double").repartition(5)
    assert {r.k: r.median for r in medians(df, ["k"], "v").collect()} == {k: float(np.median(v)) for k, v in groups.items()}


def test_huber_does_not_hold_a_group(spark, capsys):
    df = spark.range(5000).selectExpr("id % 2 AS k", "cast(pmod(hash(id), 1000) AS double) AS v")
    out = outliers.huber_location(df, ["k"], "v")
    assert out.count() == 2
    out.explain()
    plan = capsys.readouterr().out
    assert "percentile(" not in plan and "SortMergeJoin" not in plan
