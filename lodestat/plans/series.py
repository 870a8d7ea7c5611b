"""Time-series queries over each user's event values."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import detrended
from ..operators import temporal as T
from .tables import SERIES, table, user_series

SCALES = [4, 8, 16]


def r(df, *names, digits=6):
    """``df`` with the named columns rounded, and -0 as 0; doubles as in DuckDB by their scaled value, not by their shortest decimal form."""

    def rounded(c):
        scale = 10.0**digits
        return F.round(F.col(c) * scale) / scale if df.schema[c].dataType.simpleString() == "double" else F.round(c, digits)

    return df.select(*[(rounded(c) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


def _by_spread(df, column):
    """(series_id, t, column) in units of the series' standard deviation."""
    spread = F.stddev_samp("value").over(Window.partitionBy("series_id"))
    return df.select("series_id", F.col("t").cast("bigint").alias("t"), (F.col(column) / spread).alias(column))


def _daily(spark, sf_dir):
    """Daily sums of value of each event type, as short series."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.sum("value").alias("value"))
    from ..functions.stats import series

    return series(e, "event_type", ["day"], "value")


def _msd(spark, sf_dir, **kind):
    """Squared displacements of daily sums, rounded to six digits and then three: ties do not hang on the order of sums."""
    out = T.msd(_daily(spark, sf_dir).withColumnRenamed("series_id", "var_id"), 5, **kind)
    return r(out.select(F.col("t").cast("bigint").alias("t"), F.round("msd", 6).alias("msd")), "msd", digits=3)


DAILY = "s AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY day) AS t, value FROM (SELECT event_type, day(ts) AS day, sum(value) AS value FROM events GROUP BY 1, 2))"

QUERIES = {
    "dfa_hurst": lambda s, d: r(T.dfa(user_series(s, d), SCALES), "hurst", "r2"),
    "dfa_fluctuation": lambda s, d: r(T.dfa_fluctuation(user_series(s, d), SCALES, both_ways=False), "f"),
    "detrend_linear": lambda s, d: r(_by_spread(detrended(user_series(s, d), "value", "t", ["series_id"]), "resid"), "resid"),
    "cumulative_profile": lambda s, d: r(_by_spread(T.cumulative_profile(user_series(s, d)).join(user_series(s, d), ["series_id", "t"]), "profile"), "profile"),
    "haar_wavedec3": lambda s, d: r(T.haar(user_series(s, d), 3), "coef"),
    "haar_dwt_l1": lambda s, d: r(T.haar(user_series(s, d), 1), "coef"),
    "wavedec_db2": lambda s, d: r(T.wavedec(user_series(s, d), 2, "db2"), "coef"),
    "waverec_db2": lambda s, d: r(T.waverec(T.wavedec(user_series(s, d), 2, "db2"), user_series(s, d).groupBy("series_id").agg(F.count("*").alias("n")), "db2"), "value"),
    "appcoef_haar": lambda s, d: r(T.appcoef(T.wavedec(user_series(s, d), 3), user_series(s, d).groupBy("series_id").agg(F.count("*").alias("n")), 1), "value"),
    "detcoef_haar": lambda s, d: r(T.detcoef(T.haar(user_series(s, d), 3), [2]), "coef"),
    "convolve_same": lambda s, d: r(T.convolve(user_series(s, d), [0.25, 0.5, 0.25], "same").withColumn("t", F.col("t").cast("bigint")), "value"),
    "keep_part_central": lambda s, d: T.keep_part(user_series(s, d), 10).select("series_id", F.col("t").cast("bigint").alias("t"), "value"),
    "upsample_convolve": lambda s, d: r(T.upsample_convolve(user_series(s, d), [0.5, 1.0, 0.5], 20).withColumn("t", F.col("t").cast("bigint")), "value"),
    "welch_psd_dft": lambda s, d: r(T.dft_power(_daily(s, d)), "freq", "power", digits=4),
    "psd_hurst_dft": lambda s, d: r(T.dft_hurst(_daily(s, d), 1.0, (0.05, 0.45)), "slope", "hurst", "r2", digits=5),
    "welch_psd": lambda s, d: r(T.welch_psd(user_series(s, d), 1.0, "hann", 32, 0.1), "freq", "power"),
    "psd_hurst": lambda s, d: r(T.psd_hurst(user_series(s, d), 1.0, (0.02, 0.4), 32), "slope", "hurst", "r2"),
    "msd_previous": lambda s, d: _msd(s, d),
    "msd_symmetric": lambda s, d: _msd(s, d, symmetric=True),
    "msd_median": lambda s, d: _msd(s, d, robust=True),
    "lag_correlation": lambda s, d: r(T.lag_pairs(user_series(s, d)).groupBy("series_id").agg(F.corr("value", "ahead").alias("r")), "r"),
}

_FLAT = "c AS (SELECT *, regr_slope(value, t) OVER w AS b, regr_intercept(value, t) OVER w AS a, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY series_id)), p AS (SELECT series_id, t, n, sum(value - a - b * t) OVER (PARTITION BY series_id ORDER BY t) AS y FROM c)"
_F = """, k AS (SELECT unnest([4, 8, 16]) AS scale), x AS ({ways}),
q AS (SELECT series_id, scale, way, seg, regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / nullif(regr_sxx(y, t), 0) AS sse FROM x WHERE seg < n // scale GROUP BY ALL),
f AS (SELECT series_id, CAST(scale AS INT) AS scale, sqrt(greatest(sum(sse) / (count(*) * scale), 0)) AS f FROM q GROUP BY series_id, scale)"""
_FRONT = "SELECT series_id, n, t, y, scale, 0 AS way, (t - 1) // scale AS seg FROM p, k WHERE scale <= n"
_BACK = "SELECT series_id, n, t, y, scale, 1 AS way, (n - t) // scale AS seg FROM p, k WHERE scale <= n"


def _haar(levels: int) -> str:
    out, parts = f"WITH {SERIES}, h0 AS (SELECT series_id, t AS k, value AS c FROM s)", []
    for j in range(1, levels + 1):
        out += f", h{j}x AS (SELECT series_id, k, c, coalesce(lead(c) OVER (PARTITION BY series_id ORDER BY k), c) AS m FROM h{j - 1}), h{j}y AS (SELECT series_id, (k + 1) // 2 AS k, (c + m) / sqrt(2.0) AS c, (c - m) / sqrt(2.0) AS d FROM h{j}x WHERE k % 2 = 1), h{j} AS (SELECT series_id, k, c FROM h{j}y)"
        parts.append(f"SELECT series_id, {j} AS level, 'd' AS kind, CAST(k - 1 AS INT) AS k, round(d, 6) AS coef FROM h{j}y")
    parts.append(f"SELECT series_id, {levels} AS level, 'a' AS kind, CAST(k - 1 AS INT) AS k, round(c, 6) AS coef FROM h{levels}")
    return out + " " + " UNION ALL ".join(parts)


_MSD = "WITH {daily}, x AS (SELECT series_id, t, CASE WHEN row_number() OVER w = 1 OR lead(t) OVER w IS NULL THEN 0.0 ELSE power(value - {centre}, 2) END AS d FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t){more}) SELECT t, round(round(sum(d), 6), 3) AS msd FROM x GROUP BY t"
_POWER = f"WITH {DAILY}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM s{{flat}}), e AS (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM n), g AS (SELECT series_id, k, n, sum(value * cos(2.0 * {math.pi!r} * k * (t - 1) / n)) AS c, sum(value * sin(2.0 * {math.pi!r} * k * (t - 1) / n)) AS z FROM e GROUP BY ALL), h AS (SELECT series_id, CAST(k AS INT) AS k, k * 1.0 / n AS freq, (CASE WHEN k = 0 OR k * 2 = n THEN 1.0 ELSE 2.0 END) * (c * c + z * z) / n AS power FROM g)"

SQL = {
    "dfa_hurst": f"WITH {SERIES}, {_FLAT}{_F.format(ways=f'{_FRONT} UNION ALL {_BACK}')} SELECT series_id, round(regr_slope(ln(f), ln(scale)), 6) AS hurst, round(regr_r2(ln(f), ln(scale)), 6) AS r2, count(*) AS n_scales FROM f WHERE f > 0 GROUP BY series_id",
    "dfa_fluctuation": f"WITH {SERIES}, {_FLAT}{_F.format(ways=_FRONT)} SELECT series_id, scale, round(f, 6) AS f FROM f",
    "detrend_linear": f"WITH {SERIES} SELECT series_id, t, round((value - regr_intercept(value, t) OVER w - regr_slope(value, t) OVER w * t) / stddev_samp(value) OVER w, 6) AS resid FROM s WINDOW w AS (PARTITION BY series_id)",
    "cumulative_profile": f"WITH {SERIES}, x AS (SELECT *, (value - avg(value) OVER (PARTITION BY series_id)) / stddev_samp(value) OVER (PARTITION BY series_id) AS v FROM s) SELECT series_id, t, round(sum(v) OVER (PARTITION BY series_id ORDER BY t), 6) + 0.0 AS profile FROM x",
    "haar_wavedec3": _haar(3),
    "haar_dwt_l1": _haar(1),
    "detcoef_haar": f"SELECT * FROM ({_haar(3)}) WHERE kind = 'd' AND level = 2",
    "waverec_db2": f"WITH {SERIES} SELECT series_id, CAST(t AS INT) AS t, round(value, 6) AS value FROM s",
    "convolve_same": f"WITH {SERIES}, x AS (SELECT series_id, t, 0.5 * value + 0.25 * coalesce(lag(value) OVER w, 0) + 0.25 * coalesce(lead(value) OVER w, 0) AS v FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, t, round(v, 6) AS value FROM x",
    "keep_part_central": f"WITH {SERIES}, x AS (SELECT *, greatest((count(*) OVER (PARTITION BY series_id) - 10) // 2, 0) AS skip FROM s) SELECT series_id, t - skip AS t, value FROM x WHERE t - skip BETWEEN 1 AND 10",
    "welch_psd_dft": _POWER.format(flat="") + " SELECT series_id, k, round(freq, 4) AS freq, round(power, 4) AS power FROM h",
    "psd_hurst_dft": _POWER.replace("FROM s{flat}", "FROM (SELECT series_id, t, value - regr_intercept(value, t) OVER w - regr_slope(value, t) OVER w * t AS value FROM s WINDOW w AS (PARTITION BY series_id))") + " SELECT series_id, round(regr_slope(ln(power), ln(freq)), 5) AS slope, round((1 - regr_slope(ln(power), ln(freq))) / 2, 5) AS hurst, round(regr_r2(ln(power), ln(freq)), 5) AS r2 FROM h WHERE freq BETWEEN 0.05 AND 0.45 AND power > 0 GROUP BY series_id",
    "msd_previous": _MSD.format(daily=DAILY, centre="avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", more=""),
    "msd_symmetric": _MSD.format(daily=DAILY, centre="(sum(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) - value) / nullif(count(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) - 1, 0)", more=""),
    "msd_median": _MSD.format(daily=DAILY, centre="median(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", more=""),
    "lag_correlation": f"WITH {SERIES}, x AS (SELECT series_id, value, lead(value) OVER (PARTITION BY series_id ORDER BY t) AS ahead FROM s) SELECT series_id, round(corr(value, ahead), 6) AS r FROM x WHERE ahead IS NOT NULL GROUP BY series_id",
}
