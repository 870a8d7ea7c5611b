"""Draws, numbers, ranks and medians of long tables agree with their plain definitions, by blocks and in no single task."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestat.operators import resample


@pytest.fixture
def short_blocks(monkeypatch):
    for name, value in (("BLOCK", 40), ("WIDTH", 32), ("SPAN", 64)):
        monkeypatch.setattr(resample, name, value)


def table(spark, n=400):
    rng = np.random.default_rng(1)
    return pd.DataFrame({"id": rng.permutation(n), "g": np.arange(n) % 2, "v": rng.integers(0, 60, n).astype(float)}), "id long, g int, v double"


def drawn(n, rep, tail):
    return [int(hashlib.md5(f"{rep}:{k}:{tail}".encode()).hexdigest()[:8], 16) % n for k in range(1, n + 1)]


def test_md5_words():
    k = np.array([1, 9, 10, 99, 100, 12345, 999999, 10**6])
    for tail in (b":1:0", b":1:" + b"x" * 70):
        assert resample.md5_words(b"7:", k, tail).tolist() == [int(hashlib.md5(b"7:" + str(v).encode() + tail).hexdigest()[:8], 16) for v in k.tolist()]


def test_numbers_and_ranks_by_blocks(spark, short_blocks):
    pdf, kinds = table(spark)
    df = spark.createDataFrame(pdf, kinds)
    got = resample.indexed(df, ["id"], ["g"]).toPandas().sort_values(["g", "id"])
    assert got["i"].tolist() == [*range(1, 201)] * 2
    ranks = resample.value_ranks(df, "v", "r").toPandas()
    assert np.allclose(ranks["r"], ranks["v"].rank())
    assert df.transform(lambda x: resample.indexed(x, ["id"])).select(F.spark_partition_id()).distinct().count() > 1


def test_statistics_of_draws(spark, short_blocks):
    pdf, kinds = table(spark)
    df = spark.createDataFrame(pdf, kinds)
    rows = pdf.sort_values("id")["v"].to_numpy()
    means = {r["rep"]: r["stat"] for r in resample.boot_mean(df, "v", ["id"], (), 70).collect()}
    medians = {(r["g"], r["rep"]): r["stat"] for r in resample.boot_median(df, "v", ["id"], ["g"], 70).collect()}
    assert len(means) == 70 and len(medians) == 140
    for rep in (1, 2, 70):
        assert np.isclose(means[rep], rows[drawn(400, rep, "1:0")].mean())
        for g in (0, 1):
            part = pdf[pdf["g"] == g].sort_values("id")["v"].to_numpy()
            assert medians[g, rep] == np.median(part[drawn(200, rep, f"1:0:{g}")])
