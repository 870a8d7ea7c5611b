"""Means and their rounding as the SQL has them, at ties too."""

import duckdb

from lodestat import plans
from lodestat.plans.series import r


def test_doubles_round_by_their_scaled_value(spark):
    values = [0.5005, 0.5015, 0.5025, -0.5005, 0.0025, 1.5, 0.0]
    got = [x.v for x in r(spark.createDataFrame([(v,) for v in values], "v double"), "v", digits=3).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 3) + 0.0", [v]).fetchall()[0][0] for v in values]


def test_means_on_ties_are_summed_in_order_of_events(spark, tmp_path):
    """Means of twenty values on ties of the third digit, over two files in another order than the events."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT range AS event_id, range % 500 AS user_id, CAST(range // 500 % 2 AS VARCHAR) AS event_type, hash(range) % 56000 / 100.0 AS value FROM range(20000)")
    (tmp_path / "events.parquet").mkdir()
    for k in (0, 1):
        con.execute(f"COPY (SELECT * FROM events WHERE event_id % 3 {'=' if k else '<>'} 0 ORDER BY event_id DESC) TO '{tmp_path}/events.parquet/{k}.parquet'")
    con.execute("SET threads = 1")
    want = sorted(con.execute(plans.oracle_sql()["fence_changes"]).fetchall())
    got = sorted(map(tuple, plans.queries()["fence_changes"](spark, str(tmp_path)).select("user_id", "event_type", "value", "next_value", "direction").collect()))
    assert got == want
