"""Sums of row blocks reach the driver as one array, however many tasks give one."""

import numpy as np
import pandas as pd

from lodestat.operators import factor


def test_one_array_reaches_the_driver(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(120, 5))
    x[::7, 2] = np.nan
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(12).persist()
    received, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: [received.append(len(r.v)) or r for r in collect(self)] if "v" in self.columns else collect(self))
    model = factor.fit_rows(rows, "x", 5, 2, 0.5, rounds=1, moments=(np.zeros(5), np.ones(5)))
    assert sum(received) == 8 * (5 * 2 * 3 + 2)
    assert np.allclose(model.errors, factor.fit_array(x, 2, 0.5, rounds=1)[1])


def test_no_rows_give_no_sum(spark):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"v": [np.ones(3).tobytes()]})

    assert factor.summed(spark.createDataFrame([], "x double"), run) is None
    assert factor.summed(spark.range(5).repartition(5), run).shape == (3,)
