"""Queries of multivariate kernels, imputation, clustering and plot data that SQL can express."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.stats import tied_rank, unit_norm, zscore
from ..operators import classify as C
from ..operators import clustering as K
from ..operators import imputation as I
from ..operators import linalg as L
from ..operators import multivariate as M
from ..operators import plotdata as P
from ..operators import resample as B
from ..operators import temporal as T
from .series import _daily, r
from .tables import BLOCKS, DAYS, blocks, days, table, vectors, vectors_sql

DIMS = 4
GRID = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]
WIDTHS = [2.0, 4.0, 8.0]


def _grid(s):
    return s.createDataFrame([(x,) for x in GRID], "x0 double")


def _two_class(s, d, half):
    """Vectors of labels 0 and 1, split by parity of their id."""
    v = vectors(s, d, DIMS).filter(F.col("label").isin(0, 1))
    return v.filter(F.pmod("sample_id", F.lit(2)) == half)


def _gnb(linear):
    def run(s, d):
        return C.gnb(_two_class(s, d, 0), _two_class(s, d, 1), "label", linear)

    return run


def _maps(s, d):
    """Class-mean contrast of each variable on even and on odd ids."""
    v = vectors(s, d, 32).filter(F.col("label").isin(0, 1))
    side = lambda h, c: F.avg(F.when((F.pmod("sample_id", F.lit(2)) == h) & (F.col("label") == c), F.col("value")))
    return v.groupBy("var_id").agg((side(0, 1) - side(0, 0)).alias("a"), (side(1, 1) - side(1, 0)).alias("b"))


def _stack(s, d):
    """(subject, i, j, value): for each of five user groups, covariance of daily event counts of every two event types."""
    e = table(s, d, "events").groupBy((F.col("user_id") % 5).cast("int").alias("subject"), "event_type", F.dayofmonth("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    a, b = e.withColumnsRenamed({"event_type": "i", "n": "a"}), e.withColumnsRenamed({"event_type": "j", "n": "b"})
    return a.join(b, ["subject", "day"]).groupBy("subject", "i", "j").agg(F.covar_samp("a", "b").alias("value"))


_STACK = "e AS (SELECT CAST(user_id % 5 AS INT) AS subject, event_type, day(ts) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2, 3), st AS (SELECT a.subject, a.event_type AS i, b.event_type AS j, covar_samp(a.n, b.n) AS value FROM e a JOIN e b USING (subject, day) GROUP BY 1, 2, 3), dc AS (SELECT *, value - avg(value) OVER (PARTITION BY subject, i) - avg(value) OVER (PARTITION BY subject, j) + avg(value) OVER (PARTITION BY subject) AS centered FROM st)"


def _wide(s, d):
    return table(s, d, "embeddings").filter(F.col("label").isin(0, 1)).select("vec_id", "label", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))


def _kmeans(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("x"))
    start = np.array([r_[1] for r_ in e.orderBy("vec_id").limit(3).collect()], dtype=float)
    labels, _ = K.kmeans(e, "vec_id", "x", start, rounds=3, change=0.0)
    return r(labels.select("vec_id", "cluster", "distance"), "distance")


def _kmeans_sql(rounds: int = 3) -> str:
    out = "WITH v AS (SELECT vec_id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE), CAST(embedding[4] AS DOUBLE)] AS x FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, x FROM (SELECT * FROM v ORDER BY vec_id LIMIT 3))"
    dist = " + ".join(f"power(v.x[{i}] - c.x[{i}], 2)" for i in range(1, 5))
    for i in range(rounds + 1):
        out += f", a{i} AS (SELECT vec_id, any_value(v.x) AS x, min({dist}) AS d, arg_min(c.c, ({dist}, c.c)) AS c FROM v, c{i} c GROUP BY vec_id)"
        if i < rounds:
            out += f", c{i + 1} AS (SELECT c, [avg(x[1]), avg(x[2]), avg(x[3]), avg(x[4])] AS x FROM a{i} GROUP BY c)"
    return out + f" SELECT vec_id, CAST(c AS INT) AS cluster, round(d, 6) AS distance FROM a{rounds}"


def _points(s, d):
    return table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


QUERIES = {
    "gram_matrix": lambda s, d: r(L.gram(vectors(s, d, DIMS)), "g", digits=4),
    "corr_matrix": lambda s, d: r(L.correlations(vectors(s, d, DIMS)), "r"),
    "rv_coef": lambda s, d: r(M.rv_coef(vectors(s, d, DIMS), vectors(s, d, DIMS, 5)), "rv"),
    "rc_coef": lambda s, d: r(M.rc_coef(vectors(s, d, DIMS), vectors(s, d, DIMS, 5)), "rc"),
    "rspm_map": lambda s, d: r(M.rspm(_maps(s, d), "var_id", "a", "b"), "z", "r", digits=5),
    "zscores": lambda s, d: r(vectors(s, d, DIMS).select("sample_id", "var_id", zscore("value", ["var_id"]).alias("z"), unit_norm("value", ["var_id"]).alias("u")), "z", "u", digits=5),
    "tied_ranks": lambda s, d: table(s, d, "part").select("p_partkey", tied_rank("p_size", ["p_brand"]).alias("rank")),
    "rp_optimum": lambda s, d: r(M.rp_optimum(table(s, d, "part").select("p_brand", F.col("p_partkey").alias("k"), (F.col("p_size") / 60).alias("r"), (F.col("p_retailprice") / 3000).alias("p")), ["p_brand"]), "d"),
    "plsc_matrix": lambda s, d: r(M.plsc_matrix(vectors(s, d, 3), vectors(s, d, 3, 5).drop("label").join(vectors(s, d, 1).select("sample_id", "label"), "sample_id"), "label"), "r"),
    "tensor_products": lambda s, d: r(M.tensor_products(_stack(s, d).select(F.lit(1).alias("grp"), F.col("subject").alias("subj"), F.col("i").alias("i1"), F.col("j").alias("i2"), "value"), blocks(s, d).select(F.lit(1).alias("grp"), (F.col("user_id") % 5).cast("int").alias("subj"), F.col("event_type").alias("j"), "value").groupBy("grp", "subj", "j").agg(F.avg("value").alias("value"))), "z", digits=3),
    "double_center": lambda s, d: r(M.double_centered(_stack(s, d)).select("subject", "i", "j", "centered"), "centered", digits=5),
    "distatis_rv": lambda s, d: r(M.rv_matrix(M.double_centered(_stack(s, d))), "rv"),
    "nmi_labels": lambda s, d: r(K.nmi(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"), "mi", "h_a", "h_b", "nmi"),
    "kmeans_fixed3": _kmeans,
    "gnb_linear": _gnb(True),
    "gnb_nonlinear": _gnb(False),
    "ld_classify": lambda s, d: C.apply_pair(_wide(s, d), C.discriminant_pair(_wide(s, d).filter("vec_id % 2 = 0"), "label", "a", "b"), "a", "b").select("vec_id", "label", "predicted"),
    "ld_weights": lambda s, d: r(C.discriminant_pair(_wide(s, d), "label", "a", "b"), "w_a", "w_b", "mid", digits=4),
    "qd_k2": lambda s, d: C.quadratic_pair(_wide(s, d).filter("vec_id % 2 = 0"), _wide(s, d), "label", "a", "b").select("vec_id", "label", "predicted"),
    "accuracy": lambda s, d: r(C.accuracy(_gnb(False)(s, d), "label"), "accuracy"),
    "ld_map": lambda s, d: r(C.project(vectors(s, d, DIMS), _maps(s, d).select("var_id", F.col("a").alias("weight"))), "score"),
    "impute_mean": lambda s, d: r(I.impute_mean(days(s, d), "day", "value").select("user_id", "day", "filled"), "filled", digits=5),
    "impute_median": lambda s, d: r(I.impute_median(days(s, d), "day", "value").select("user_id", "day", "filled"), "filled", digits=5),
    "impute_normal": lambda s, d: r(I.impute_normal(days(s, d), "user_id", "day", "value").select("user_id", "day", "filled"), "filled", digits=4),
    "listwise_mean": lambda s, d: r(I.column_means(days(s, d).filter("day <= 3"), "user_id", "day", "value", "listwise"), "mean", digits=5),
    "pairwise_mean": lambda s, d: r(I.column_means(days(s, d), "user_id", "day", "value"), "mean", digits=5),
    "ecm_start": lambda s, d: r(I.ecm_start(days(s, d).filter("day <= 4"), "user_id", "day", "value"), "mean_i", "cov", digits=4),
    "bias_only_als2": lambda s, d: r(I.additive(days(s, d), "user_id", "day", "value").select("user_id", "day", "filled"), "filled", digits=4),
    "impute_nearest": lambda s, d: r(I.nearest_row(days(s, d).filter("day <= 8 AND user_id <= 60"), "user_id", "day", "value").select("user_id", "day", "filled"), "filled", digits=5),
    "kernel_smooth_gauss": lambda s, d: r(P.kernel_smooth(_points(s, d), _grid(s), "x", "y", 4.0), "fit", "n_eff", digits=4),
    "kernel_smooth_box": lambda s, d: r(P.kernel_smooth(_points(s, d), _grid(s), "x", "y", 4.0, "box"), "fit", "n_eff", digits=4),
    "kernel_cv": lambda s, d: P.kernel_cv(_points(s, d), "x", "y", WIDTHS).select("h", F.round("sse", 0).alias("sse"), "n"),
    "fence_changes": lambda s, d: r(P.fence_segments(blocks(s, d), "user_id", "event_type", "value", 1.0), "value", "next_value", digits=3),
    "ellipse_params": lambda s, d: r(P.ellipse_params(table(s, d, "lineitem"), "l_quantity", "l_tax", ["l_returnflag"]), "cx", "cy", "major", "minor", "angle", digits=5),
    "ellipse_axis": lambda s, d: r(P.ellipse_axis(table(s, d, "lineitem"), "l_quantity", "l_tax", 1.0, 2.0), "cx", "cy", "along", "across", digits=5),
    "mip_projection": lambda s, d: r(P.projections(table(s, d, "lineitem").select((F.col("l_orderkey") % 7).alias("x"), (F.col("l_partkey") % 5).alias("y"), F.col("l_linenumber").cast("bigint").alias("z"), F.col("l_extendedprice").alias("v")), ["x", "y", "z"], "v"), "top", "bottom", digits=2),
    "slice_layout": lambda s, d: P.slice_layout(table(s, d, "part").select((F.col("p_partkey") % 10).alias("x"), (F.col("p_partkey") % 7).alias("y"), (F.col("p_partkey") % 12).alias("z"), F.col("p_partkey").alias("value")), 10, 7, 4),
    "error_offsets": lambda s, d: r(P.error_offsets(blocks(s, d).groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd")), "event_type", "m", "sd"), "m", "sd", "x", "low", "high", digits=5),
    "hash_draws": lambda s, d: B.draws(s, 50, 20),
    "msd_daily_lag": lambda s, d: r(T.lag_pairs(_daily(s, d), 2), "value", "ahead", digits=3),
}

_V = vectors_sql(DIMS)
_TWO = f"{_V}, tr AS (SELECT * FROM v WHERE label IN (0, 1) AND sample_id % 2 = 0), te AS (SELECT * FROM v WHERE label IN (0, 1) AND sample_id % 2 = 1), md AS (SELECT var_id, avg(value) FILTER (label = 0) AS m0, avg(value) FILTER (label = 1) AS m1, stddev_samp(value) FILTER (label = 0) AS s0, stddev_samp(value) FILTER (label = 1) AS s1 FROM tr GROUP BY 1)"
_NB = f"WITH {_TWO}, pr AS (SELECT sample_id, label, CASE WHEN sum(-ln(s1) - power(value - m1, 2) / (2 * s1 * s1) + ln(s0) + power(value - m0, 2) / (2 * s0 * s0)) > 0 THEN 1 ELSE 0 END AS predicted FROM te JOIN md USING (var_id) GROUP BY 1, 2)"
_W = "x AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings WHERE label IN (0, 1))"


def _moments(where: str) -> str:
    parts = ", ".join(f"{f} FILTER (label = {l}) AS {n}{l}" for l in (0, 1) for n, f in (("ma", "avg(a)"), ("mb", "avg(b)"), ("va", "var_samp(a)"), ("vb", "var_samp(b)"), ("c", "covar_samp(a, b)")))
    return f"mo AS (SELECT {parts} FROM x WHERE {where})"


_PAIR = "ld AS (SELECT *, ((vb0 + vb1) * (ma1 - ma0) - (c0 + c1) * (mb1 - mb0)) / ((va0 + va1) * (vb0 + vb1) - (c0 + c1) * (c0 + c1)) AS w_a, ((va0 + va1) * (mb1 - mb0) - (c0 + c1) * (ma1 - ma0)) / ((va0 + va1) * (vb0 + vb1) - (c0 + c1) * (c0 + c1)) AS w_b FROM mo), lm AS (SELECT w_a, w_b, (w_a * (ma0 + ma1) + w_b * (mb0 + mb1)) / 2 AS mid FROM ld)"


def _qd(l: int) -> str:
    det = f"(va{l} * vb{l} - c{l} * c{l})"
    return f"((vb{l} * (a - ma{l}) * (a - ma{l}) - 2 * c{l} * (a - ma{l}) * (b - mb{l}) + va{l} * (b - mb{l}) * (b - mb{l})) / {det} + ln({det}))"


def _maps_sql() -> str:
    side = lambda h, c: f"avg(value) FILTER (sample_id % 2 = {h} AND label = {c})"
    return f"{vectors_sql(32, name='v32')}, mp AS (SELECT var_id, {side(0, 1)} - {side(0, 0)} AS a, {side(1, 1)} - {side(1, 0)} AS b FROM v32 WHERE label IN (0, 1) GROUP BY 1)"


_POINTS = "pt AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)"


def _smooth(w: str) -> str:
    return f"WITH {_POINTS}, g AS (SELECT unnest({GRID}) AS x0) SELECT CAST(x0 AS DOUBLE) AS x0, round(sum({w} * y) / nullif(sum({w}), 0), 4) AS fit, round(sum({w}), 4) AS n_eff FROM pt, g GROUP BY x0"


_GAUSS = "exp(-(x - x0) * (x - x0) / 32.0)"
_NORMAL = f"sqrt(-2 * ln((CAST(('0x' || substr(md5(concat_ws(':', user_id, day, 1)), 1, 8)) AS BIGINT) + 1) / 4294967297.0)) * cos({2 * math.pi!r} * (CAST(('0x' || substr(md5(concat_ws(':', user_id, day, 2)), 1, 8)) AS BIGINT) / 4294967296.0))"

SQL = {
    "gram_matrix": f"WITH {_V} SELECT p.var_id AS i, q.var_id AS j, round(sum(p.value * q.value), 4) AS g FROM v p JOIN v q USING (sample_id) GROUP BY 1, 2",
    "corr_matrix": f"WITH {_V} SELECT p.var_id AS i, q.var_id AS j, round(corr(p.value, q.value), 6) AS r FROM v p JOIN v q USING (sample_id) GROUP BY 1, 2",
    "rv_coef": f"WITH {_V}, {vectors_sql(DIMS, 5, 'u')}, xy AS (SELECT sum(c * c) AS s FROM (SELECT covar_samp(p.value, q.value) AS c FROM v p JOIN u q USING (sample_id) GROUP BY p.var_id, q.var_id)), xx AS (SELECT sum(c * c) AS s FROM (SELECT covar_samp(p.value, q.value) AS c FROM v p JOIN v q USING (sample_id) GROUP BY p.var_id, q.var_id)), yy AS (SELECT sum(c * c) AS s FROM (SELECT covar_samp(p.value, q.value) AS c FROM u p JOIN u q USING (sample_id) GROUP BY p.var_id, q.var_id)) SELECT round(xy.s / sqrt(xx.s * yy.s), 6) AS rv FROM xy, xx, yy",
    "rc_coef": f"WITH {_V}, {vectors_sql(DIMS, 5, 'u')}, p AS (SELECT sample_id, var_id, value - avg(value) OVER (PARTITION BY var_id) AS a FROM v), q AS (SELECT sample_id, var_id, value - avg(value) OVER (PARTITION BY var_id) AS b FROM u) SELECT round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS rc FROM p JOIN q USING (sample_id, var_id)",
    "rspm_map": f"WITH {_maps_sql()}, z AS (SELECT var_id, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS za, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS zb, avg(a) OVER () / stddev_samp(a) OVER () + avg(b) OVER () / stddev_samp(b) OVER () AS m, corr(a, b) OVER () AS r FROM mp) SELECT var_id, round(((za + zb) / sqrt(2.0) + m / sqrt(2.0)) / stddev_samp((za - zb) / sqrt(2.0)) OVER (), 5) AS z, round(r, 5) AS r FROM z",
    "zscores": f"WITH {_V} SELECT sample_id, var_id, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 5) AS z, round(value / sqrt(sum(value * value) OVER w), 5) AS u FROM v WINDOW w AS (PARTITION BY var_id)",
    "tied_ranks": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank FROM part",
    "rp_optimum": "WITH x AS (SELECT p_brand, p_partkey AS k, sqrt(power(1 - p_size / 60.0, 2) + power(1 - p_retailprice / 3000.0, 2)) AS d FROM part) SELECT p_brand, arg_min(k, (d, k)) AS k, round(min(d), 6) AS d FROM x GROUP BY 1",
    "plsc_matrix": f"WITH {vectors_sql(3)}, {vectors_sql(3, 5, 'u')} SELECT p.label, p.var_id AS i, q.var_id AS j, round(corr(p.value, q.value), 6) AS r FROM v p JOIN u q USING (sample_id) GROUP BY 1, 2, 3",
    "tensor_products": f"WITH {_STACK}, {BLOCKS}, y AS (SELECT CAST(user_id % 5 AS INT) AS subject, event_type AS j, avg(value) AS b FROM b GROUP BY 1, 2) SELECT 1 AS grp, st.i AS i1, st.j AS i2, y.j AS j, round(sum(st.value * y.b), 3) AS z FROM st JOIN y USING (subject) GROUP BY 2, 3, 4",
    "double_center": f"WITH {_STACK} SELECT subject, i, j, round(centered, 5) AS centered FROM dc",
    "distatis_rv": f"WITH {_STACK}, nm AS (SELECT subject, sum(centered * centered) AS n FROM dc GROUP BY 1), cr AS (SELECT p.subject AS a, q.subject AS b, sum(p.centered * q.centered) AS s FROM dc p JOIN dc q USING (i, j) GROUP BY 1, 2) SELECT a, b, round(s / sqrt(x.n * y.n), 6) AS rv FROM cr JOIN nm x ON x.subject = a JOIN nm y ON y.subject = b",
    "nmi_labels": "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1, 2), m AS (SELECT *, sum(p) OVER (PARTITION BY a) AS pa, sum(p) OVER (PARTITION BY b) AS pb FROM c), h AS (SELECT sum(p * log2(p / (pa * pb))) AS mi FROM m), ha AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT sum(p) AS p FROM c GROUP BY a)), hb AS (SELECT -sum(p * log2(p)) AS h FROM (SELECT sum(p) AS p FROM c GROUP BY b)) SELECT round(mi, 6) AS mi, round(ha.h, 6) AS h_a, round(hb.h, 6) AS h_b, round(mi / sqrt(ha.h * hb.h), 6) AS nmi FROM h, ha, hb",
    "kmeans_fixed3": _kmeans_sql(),
    "gnb_linear": f"WITH {_TWO} SELECT sample_id, label, CASE WHEN sum(power(value - m0, 2) - power(value - m1, 2)) >= 0 THEN 1 ELSE 0 END AS predicted FROM te JOIN md USING (var_id) GROUP BY 1, 2",
    "gnb_nonlinear": f"{_NB} SELECT * FROM pr",
    "accuracy": f"{_NB} SELECT count(*) AS n, round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pr",
    "ld_classify": f"WITH {_W}, {_moments('vec_id % 2 = 0')}, {_PAIR} SELECT vec_id, label, CASE WHEN w_a * a + w_b * b > mid THEN 1 ELSE 0 END AS predicted FROM x, lm",
    "ld_weights": f"WITH {_W}, {_moments('true')}, {_PAIR} SELECT round(w_a, 4) AS w_a, round(w_b, 4) AS w_b, round(mid, 4) AS mid FROM lm",
    "qd_k2": f"WITH {_W}, {_moments('vec_id % 2 = 0')} SELECT vec_id, label, CASE WHEN {_qd(1)} < {_qd(0)} THEN 1 ELSE 0 END AS predicted FROM x, mo",
    "ld_map": f"WITH {_V}, {_maps_sql()} SELECT sample_id, round(sum(value * a), 6) AS score FROM v JOIN mp USING (var_id) GROUP BY 1",
    "impute_mean": f"WITH {DAYS} SELECT user_id, day, round(coalesce(value, avg(value) OVER (PARTITION BY day)), 5) AS filled FROM d",
    "impute_median": f"WITH {DAYS}, m AS (SELECT day, median(value) AS m FROM d GROUP BY 1) SELECT user_id, day, round(coalesce(value, m), 5) AS filled FROM d JOIN m USING (day)",
    "impute_normal": f"WITH {DAYS} SELECT user_id, day, round(coalesce(value, avg(value) OVER w + coalesce(stddev_samp(value) OVER w, 0) * {_NORMAL}), 4) AS filled FROM d WINDOW w AS (PARTITION BY day)",
    "listwise_mean": f"WITH {DAYS}, c AS (SELECT *, count(*) FILTER (value IS NULL) OVER (PARTITION BY user_id) AS bad FROM d WHERE day <= 3) SELECT day, count(value) AS n, round(avg(value), 5) AS mean FROM c WHERE bad = 0 GROUP BY day",
    "pairwise_mean": f"WITH {DAYS} SELECT day, count(value) AS n, round(avg(value), 5) AS mean FROM d GROUP BY day",
    "ecm_start": f"WITH {DAYS}, m AS (SELECT user_id, day, avg(value) OVER (PARTITION BY day) AS m, value FROM d WHERE day <= 4), e AS (SELECT user_id, day, m, coalesce(value - m, 0) AS x FROM m) SELECT p.day AS i, q.day AS j, round(max(p.m), 4) AS mean_i, round(avg(p.x * q.x), 4) AS cov FROM e p JOIN e q USING (user_id) GROUP BY 1, 2",
    "bias_only_als2": f"WITH {DAYS}, a0 AS (SELECT *, avg(value) OVER () AS mu, 0.0 AS a, 0.0 AS b FROM d), a1 AS (SELECT user_id, day, value, mu, b, avg(value - mu - b) OVER (PARTITION BY user_id) AS a FROM a0), b1 AS (SELECT user_id, day, value, mu, a, avg(value - mu - a) OVER (PARTITION BY day) AS b FROM a1), a2 AS (SELECT user_id, day, value, mu, b, avg(value - mu - b) OVER (PARTITION BY user_id) AS a FROM b1), b2 AS (SELECT user_id, day, value, mu, a, avg(value - mu - a) OVER (PARTITION BY day) AS b FROM a2) SELECT user_id, day, round(coalesce(value, mu + coalesce(a, 0) + coalesce(b, 0)), 4) AS filled FROM b2",
    "impute_nearest": f"WITH {DAYS}, x AS (SELECT * FROM d WHERE day <= 8 AND user_id <= 60), n AS (SELECT p.user_id AS r, q.user_id AS o, avg(power(p.value - q.value, 2)) AS dd FROM x p JOIN x q USING (day) WHERE p.user_id <> q.user_id AND p.value IS NOT NULL AND q.value IS NOT NULL GROUP BY 1, 2), g AS (SELECT x.user_id, x.day, arg_min(y.value, (n.dd, n.o)) AS g FROM x JOIN n ON n.r = x.user_id JOIN x y ON y.user_id = n.o AND y.day = x.day WHERE x.value IS NULL AND y.value IS NOT NULL GROUP BY 1, 2) SELECT x.user_id, x.day, round(coalesce(x.value, g.g), 5) AS filled FROM x LEFT JOIN g ON g.user_id = x.user_id AND g.day = x.day",
    "kernel_smooth_gauss": _smooth(_GAUSS),
    "kernel_smooth_box": _smooth("(CASE WHEN abs(x - x0) < 4 THEN 1.0 ELSE 0.0 END)"),
    "kernel_cv": f"WITH {_POINTS}, id AS (SELECT row_number() OVER () AS i, x, y FROM pt), h AS (SELECT CAST(unnest({WIDTHS}) AS DOUBLE) AS h), f AS (SELECT h, p.i, p.y, sum(q.y * exp(-(p.x - q.x) * (p.x - q.x) / (2 * h * h))) / sum(exp(-(p.x - q.x) * (p.x - q.x) / (2 * h * h))) AS f FROM id p, id q, h WHERE p.i <> q.i GROUP BY ALL) SELECT h, round(sum(power(y - f, 2)), 0) AS sse, count(*) AS n FROM f GROUP BY h",
    "fence_changes": f"WITH {BLOCKS}, x AS (SELECT user_id, event_type, value, lead(value) OVER (PARTITION BY user_id ORDER BY event_type) AS n FROM b) SELECT user_id, event_type, round(value, 3) AS value, round(n, 3) AS next_value, CASE WHEN n - value > 1 THEN 1 WHEN n - value < -1 THEN -1 ELSE 0 END AS direction FROM x WHERE n IS NOT NULL",
    "ellipse_params": "WITH m AS (SELECT l_returnflag, avg(l_quantity) AS cx, avg(l_tax) AS cy, var_samp(l_quantity) AS a, var_samp(l_tax) AS b, covar_samp(l_quantity, l_tax) AS c FROM lineitem GROUP BY 1) SELECT l_returnflag, round(cx, 5) AS cx, round(cy, 5) AS cy, round(sqrt((a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c)), 5) AS major, round(sqrt(greatest((a + b) / 2 - sqrt(power((a - b) / 2, 2) + c * c), 0)), 5) AS minor, round(0.5 * atan2(2 * c, a - b), 5) + 0.0 AS angle FROM m",
    "ellipse_axis": "SELECT round(avg(l_quantity), 5) AS cx, round(avg(l_tax), 5) AS cy, round(stddev_samp((l_quantity + 2 * l_tax) / sqrt(5.0)), 5) AS along, round(stddev_samp((l_tax - 2 * l_quantity) / sqrt(5.0)), 5) AS across FROM lineitem",
    "mip_projection": "WITH x AS (SELECT l_orderkey % 7 AS x, l_partkey % 5 AS y, CAST(l_linenumber AS BIGINT) AS z, l_extendedprice AS v FROM lineitem) SELECT 'x' AS axis, y AS u, z AS v, round(max(x.v), 2) AS top, round(min(x.v), 2) AS bottom FROM x GROUP BY y, z UNION ALL SELECT 'y', x, z, round(max(x.v), 2), round(min(x.v), 2) FROM x GROUP BY x, z UNION ALL SELECT 'z', x, y, round(max(x.v), 2), round(min(x.v), 2) FROM x GROUP BY x, y",
    "slice_layout": "SELECT p_partkey % 10 AS x, p_partkey % 7 AS y, p_partkey % 12 AS z, p_partkey AS value, (p_partkey % 12) % 4 * 10 + p_partkey % 10 AS px, (p_partkey % 12) // 4 * 7 + p_partkey % 7 AS py FROM part",
    "error_offsets": f"WITH {BLOCKS}, g AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM b GROUP BY 1) SELECT event_type, round(m, 5) AS m, round(sd, 5) AS sd, round(dense_rank() OVER (ORDER BY event_type) * 0.05, 5) AS x, round(m - sd, 5) AS low, round(m + sd, 5) AS high FROM g",
    "hash_draws": "SELECT rep, CAST(('0x' || substr(md5(concat_ws(':', rep, k, 1)), 1, 8)) AS BIGINT) % 50 + 1 AS i, count(*) AS times FROM (SELECT unnest(range(1, 21)) AS rep), (SELECT unnest(range(1, 51)) AS k) GROUP BY 1, 2",
}
