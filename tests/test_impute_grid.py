"""Blocks of patterns and of classes: the same fills as row by row, and a class is set up once a block, not once a pair."""

import numpy as np
import pytest

from lodestat.operators import imputation


def table(rows=300, d=6):
    rng = np.random.default_rng(5)
    x = rng.normal(50, 9, size=(rows, 1)) + rng.normal(0, 4, size=(rows, d))
    x[rng.random(x.shape) < 0.25] = np.nan
    return x


@pytest.mark.parametrize("method", ["mlr", "pls"])
def test_blocks_give_the_fills_of_rows_and_models_are_set_up_once(spark, monkeypatch, method):
    """Two matrices, the second without a name."""
    x, calls, model = table(), spark.sparkContext.accumulator(0), imputation.ROW_MODELS[method]
    monkeypatch.setattr(imputation, "TARGETS", 9, raising=False)
    monkeypatch.setattr(imputation, "CLASSES", 16, raising=False)

    def counted(*given):
        calls.add(1)
        return model(*given)

    monkeypatch.setitem(imputation.ROW_MODELS, method, counted)
    y = np.where(np.arange(6) == 2, 2 * x, x)[::-1]
    cells = [(g, i, j, None if np.isnan(v) else float(v)) for g, m in ((1, x), (None, y)) for (i, j), v in np.ndenumerate(m)]
    got = imputation.impute_rows(spark.createDataFrame(cells, "g int, r int, c int, value double"), "g", "r", "c", "value", method).collect()
    assert len(got) == 2 * x.size
    for g, m in ((1, x), (None, y)):
        want, mine = imputation.METHODS[method](m), np.full(m.shape, np.nan)
        for c in got:
            if c["g"] == g:
                mine[c["r"], c["c"]] = np.nan if c["filled"] is None else c["filled"]
        assert np.allclose(want, mine, rtol=1e-7, equal_nan=True)
    patterns, size = np.unique(np.isfinite(x), axis=0, return_counts=True)
    holes = (~patterns).sum(axis=1)
    blocks = sum(-(-int((holes == h).sum()) // 9) for h in range(1, 6))
    pairs = sum(int(not (~p & ~q).any() and (p & q).any()) for p in patterns if not p.all() for q in patterns[size >= 3])
    assert 0 < calls.value <= 2 * (size >= 3).sum() * blocks < 2 * pairs
