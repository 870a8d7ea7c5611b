import math
import time

import numpy as np

from lodestat.functions import dist
from lodestat.operators import outliers


def plain(x, share=0.2, alpha=0.05):
    ids, n, out = np.arange(len(x)), len(x), []
    for i in range(1, int(math.floor(share * n + 0.5)) + 1):
        dev = np.abs(x - x.mean())
        at, t = int(dev.argmax()), dist.t_ppf(1 - alpha / (2 * (n - i + 1)), n - i - 1)
        out.append((int(ids[at]), dev[at] / x.std(ddof=1), (n - i) * t / math.sqrt((n - i - 1 + t * t) * (n - i + 1))))
        x, ids = np.delete(x, at), np.delete(ids, at)
    return out


def test_ends_of_ordered_values(spark):
    x = np.round(np.random.default_rng(3).normal(size=120), 1)  # with ties
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "var string, sample int, value double")
    got = [(r["sample"], r["r"], r["lam"]) for r in outliers.gen_esd(rows, "var", "sample", "value").orderBy("step").collect()]
    want = plain(x)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in want], rtol=1e-9)


def test_quantiles_of_arrays():
    began = time.time()
    p, dof = 1 - 0.025 / np.arange(20_001, 1, -1), np.arange(20_000, 0, -1.0)
    got = outliers._t_ppf(p, dof)
    assert np.allclose(got[::4000], [dist.t_ppf(a, b) for a, b in zip(p[::4000], dof[::4000], strict=True)], rtol=1e-9)
    assert time.time() - began < 60
