"""Queries over sets, grains, nested values and time order, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import univariate as U
from .series import r
from .tables import table


def _before(s, d):
    """Each purchase with the user's latest click at or before it."""
    e = table(s, d, "events")
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", "event_id", "value")
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    out = J.as_of(bought, clicks, ["user_id"], "ts", ["value", "event_id"], ["event_id"])
    return out.select("event_id", "user_id", F.coalesce("last_value", F.lit(-1.0)).alias("last_value"), F.coalesce("last_event_id", F.lit(-1)).alias("click_id"))


def _status_t(s, d):
    """(nation, t, dof): one-sample t of the mean order prices of the three order statuses against the mean of all nations."""
    c, o = table(s, d, "customer"), table(s, d, "orders")
    cells = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    rows = cells.crossJoin(F.broadcast(cells.agg(F.avg("v").alias("m"))))  # one row, the mean
    n = F.count("*")
    t = rows.groupBy("c_nationkey").agg(((F.avg("v") - F.first("m")) / F.try_divide(F.stddev_samp("v"), F.sqrt(n))).alias("t"), (n - 1).alias("dof"))
    return t.filter("dof = 2")


def _fdr_t(s, d):
    return r(U.fdr_from(_status_t(s, d), "t", "t", "dof", q=0.2, by=[]).select("c_nationkey", "p", "crit", "mask"), "p", "crit", digits=7)


def _fdr_z(s, d):
    """The same statistics as standard scores, upper tail."""
    return r(U.fdr_from(_status_t(s, d), "t", "z", tails=1, q=0.2, by=[]).select("c_nationkey", "p", "crit", "mask"), "p", "crit", digits=7)


def _grains(s, d):
    line = table(s, d, "lineitem")
    line.createOrReplaceTempView("lineitem_grains")
    out = s.sql("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS grain, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd FROM lineitem_grains GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
    return r(out.withColumn("grain", F.col("grain").cast("int")), "mean", "sd", digits=6)


def _props(s, d):
    e = table(s, d, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return r(e.groupBy("event_type").agg(F.count("k").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"), F.corr("k", "value").alias("r")), "r", digits=6)


QUERIES = {
    "as_of_click": _before,
    "fdr_t": _fdr_t,
    "fdr_z": _fdr_z,
    "grouping_sets": _grains,
    "json_props": _props,
    "anti_join": lambda s, d: table(s, d, "customer").join(table(s, d, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")),
    "intersect": lambda s, d: table(s, d, "lineitem").filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").intersect(table(s, d, "lineitem").filter("l_returnflag = 'A'").select("l_partkey", "l_suppkey")),
    "except_all": lambda s, d: table(s, d, "lineitem").filter("l_returnflag = 'R'").select("l_partkey").exceptAll(table(s, d, "lineitem").filter("l_returnflag = 'A'").select("l_partkey")),
}

_T = "cells AS (SELECT c_nationkey, o_orderstatus, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), t AS (SELECT c_nationkey, (avg(v) - (SELECT avg(v) FROM cells)) / (stddev_samp(v) / sqrt(count(*))) AS t FROM cells GROUP BY 1 HAVING count(*) = 3)"

SQL = {
    "as_of_click": "SELECT p.event_id, p.user_id, coalesce(c.value, -1) AS last_value, coalesce(c.event_id, -1) AS click_id FROM events p LEFT JOIN LATERAL (SELECT value, event_id FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click' AND c.ts <= p.ts ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) c ON true WHERE p.event_type = 'purchase'",
    # With two degrees of freedom the two-sided p value of t is 1 - |t| / sqrt(2 + t^2).
    "fdr_t": f"WITH {_T}, p AS (SELECT c_nationkey, 1 - abs(t) / sqrt(2 + t * t) AS p FROM t), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM p), z AS (SELECT max(CASE WHEN p <= k * 0.2 / n THEN p END) AS crit FROM k) SELECT c_nationkey, round(p, 7) AS p, round(crit, 7) AS crit, CASE WHEN p <= crit THEN 1 ELSE 0 END AS mask FROM k, z",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS INT) AS grain, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "json_props": "SELECT event_type, count(k) AS n, min(k) AS least, max(k) AS most, round(corr(k, value), 6) AS r FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY 1",
    "anti_join": "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1",
    "intersect": "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'",
    "except_all": "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'",
}
