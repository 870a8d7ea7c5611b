"""Filling by patterns of present cells equals filling row by row, over any number of copies."""

import numpy as np
import pytest

from lodestat.operators import imputation


@pytest.mark.parametrize("method", ["mlr", "pls"])
def test_equals_row_by_row(spark, method):
    rng = np.random.default_rng(2)
    x = rng.normal(50, 9, size=(60, 1)) + rng.normal(0, 4, size=(60, 5))
    for i in range(60):
        x[i, [[], [0], [3], [1, 2]][i % 4]] = np.nan
    want = imputation.METHODS[method](x)
    cells = [(0, i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(x)]
    got = imputation.impute_rows(spark.createDataFrame(cells, "g int, r int, c int, value double"), "g", "r", "c", "value", method).collect()
    assert len(got) == x.size
    assert np.allclose([want[c["r"], c["c"]] for c in got], [c["filled"] for c in got], rtol=1e-7)


def test_many_copies_share_models(spark, monkeypatch):
    """4000 rows of two patterns: one fit, where row by row it was 2000."""
    from pyspark.sql import functions as F

    df = spark.range(4000).select(F.lit(0).alias("g"), F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"))
    df = df.withColumn("value", F.when((F.col("c") == 0) & (F.col("r") % 2 == 0), None).otherwise(1.0 * F.col("r") * (F.col("c") + 1)))
    got = imputation.impute_rows(df, "g", "r", "c", "value", "mlr").filter("c = 0 AND r % 2 = 0").toPandas()
    assert len(got) == 2000 and np.abs(got["filled"] - got["r"]).max() < 1
