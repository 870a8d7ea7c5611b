"""As-of joins against brute force, and FDR from t and z statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestat.operators import joins, univariate


@pytest.mark.parametrize("within", [None, 3])
def test_as_of_equals_brute_force(spark, within):
    rng = random.Random(2)
    left = [(rng.choice([1, 2, None]), rng.choice([*range(20), None]), i // 2) for i in range(80)]
    right = [(rng.choice([1, 2, 3, None]), rng.choice([*range(20), None]), i, float(i)) for i in range(40)]
    a = spark.createDataFrame(left, "k int, t int, _side int").repartition(3)
    b = spark.createDataFrame(right, "k int, t int, n int, v double").repartition(2)
    got = joins.as_of(a, b, ["k"], "t", ["v"], ["n"], None if within is None else F.lit(within)).collect()
    want = []
    for k, t, s in left:
        hits = [r for r in right if r[0] == k and r[1] is not None and t is not None and r[1] <= t]
        best = max(hits, key=lambda r: (r[1], r[2])) if hits else None
        if best is not None and within is not None and best[1] + within < t:
            best = None
        want.append((k, t, s, best[3] if best else None, best[1] if best else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert joins.as_of(a.filter("t < 0"), b, ["k"], "t", ["v"]).count() == 0
    assert joins.as_of(a, b.filter("t < 0"), ["k"], "t", ["v"]).filter("last_v IS NOT NULL").count() == 0


def t_two_sided(t, dof):
    """By the density, summed by Simpson's rule."""
    c = math.gamma((dof + 1) / 2) / math.sqrt(dof * math.pi) / math.gamma(dof / 2)
    n, top = 20_000, abs(t)
    f = [(1 + (top * i / n) ** 2 / dof) ** (-(dof + 1) / 2) for i in range(n + 1)]
    return 1 - 2 * c * top / n / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))


@pytest.mark.parametrize("tails", [1, 2])
def test_fdr_of_statistics(spark, tails):
    stats = [(i, (-1) ** i * i / 4, 1 + i % 7) for i in range(20)] + [(99, None, 3)]
    df = spark.createDataFrame(stats, "id int, s double, dof int")
    for kind in ("t", "z"):
        got = {r.id: r for r in univariate.fdr_from(df, "s", kind, "dof", tails, by=[]).collect()}
        want = {}
        for i, s, dof in stats[:-1]:
            p = t_two_sided(s, dof) if kind == "t" else math.erfc(abs(s) / math.sqrt(2))
            want[i] = p if tails == 2 else (p / 2 if s > 0 else 1 - p / 2)
            assert got[i].p == pytest.approx(want[i], abs=1e-6)
        ranked = sorted(want.values())
        passing = [p for k, p in enumerate(ranked, 1) if p <= k * 0.05 / len(ranked)]
        assert {i for i in want if got[i].mask == 1} == {i for i, p in want.items() if passing and p <= max(passing)}
        assert got[99].mask == -1
