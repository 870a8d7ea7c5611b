"""Every query with SQL gives the rows that DuckDB gives; every other one runs."""

import math

import duckdb
import pandas as pd
import pytest

from lodestat import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v != v:
            return ""
        return f"{float(v):.9g}" if isinstance(v, int | float) or hasattr(v, "as_tuple") or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries that keep rows of which there are none in the test tables.
MAY_BE_EMPTY = {"pca_kurtosis_filter"}
#: Columns that may be null throughout: no held-out rows, no standard error of a variance, no rejected test, no test of a share.
MAY_BE_NULL = {"g", "se", "t", "crit", ("boot_r2", "p")}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_values(spark, sf_dir, name):
    """Rows there are, all numbers are finite or null, no column is null throughout, no row repeats, and probabilities are such."""
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert rows or name in MAY_BE_EMPTY
    for i, (column, kind) in enumerate(df.dtypes):
        values = [r[i] for r in rows if r[i] is not None]
        assert values or not rows or column in MAY_BE_NULL or (name, column) in MAY_BE_NULL, column
        if kind in ("double", "float"):
            assert all(math.isfinite(v) for v in values), column
            if column in ("p", "responsibility", "accuracy"):
                assert all(-1e-9 <= v <= 1 + 1e-9 for v in values), column
            if column in ("ci_low",) and "ci_high" in df.columns:
                j = df.columns.index("ci_high")
                assert all(r[i] <= r[j] for r in rows if r[i] is not None and r[j] is not None)
    assert len(set(map(str, rows))) == len(rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.queries()) <= set(entry.queries())
