"""Univariate tests, bootstrap and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outliers as O
from ..operators import resample as B
from ..operators import univariate as U
from .series import r
from .tables import BLOCKS, FULL_BLOCKS, WEEKS, blocks, days, table, weeks

REPS = 100


def _line(s, d):
    return table(s, d, "lineitem")


def _supplier_p(s, d):
    """A pseudo-p for each supplier and return flag: the share of its lines with a high discount."""
    x = _line(s, d).groupBy("l_returnflag", "l_suppkey").agg(F.avg((F.col("l_discount") >= 0.05).cast("double")).alias("p"))
    return x.withColumn("p", F.pow("p", 6.0))


_P = "p AS (SELECT l_returnflag, l_suppkey, power(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS p FROM lineitem GROUP BY 1, 2)"


def _fdr(dependent: bool, compat: bool = False) -> str:
    c = "(ln(n) + 0.5772156649015329 + 1.0 / n)" if dependent else "1.0"
    top = "sum(CASE WHEN ok THEN 1 ELSE 0 END)" if compat else "max(CASE WHEN ok THEN k END)"
    return f"WITH {_P}, k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY p) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM p), o AS (SELECT *, p <= k * 0.05 / (n * {c}) AS ok FROM k), m AS (SELECT *, {top} OVER (PARTITION BY l_returnflag) AS top FROM o), z AS (SELECT *, max(CASE WHEN k = top THEN p END) OVER (PARTITION BY l_returnflag) AS crit FROM m) SELECT l_returnflag, l_suppkey, round(p, 9) AS p, round(crit, 9) AS crit, CASE WHEN p <= crit THEN 1 ELSE 0 END AS mask FROM z"


def _fdr_query(**options):
    def run(s, d):
        out = U.fdr(_supplier_p(s, d), "p", ["l_returnflag"], **options)
        return r(out.select("l_returnflag", "l_suppkey", "p", "crit", "mask"), "p", "crit", digits=9)

    return run


def _pairs(s, d):
    """Orders of each customer with a value: (customer, orders, price)."""
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("double").alias("x"), F.avg("o_totalprice").alias("y"))


_PAIRS = "q AS (SELECT o_custkey AS id, CAST(count(*) AS DOUBLE) AS x, avg(o_totalprice) AS y FROM orders GROUP BY 1)"
_DRAW = "CAST(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8)) AS BIGINT)"


def _hazen(value: str, p: float, by: str = "") -> str:
    """Scalar sub-expression over rows (k, n, value) of a ranked table."""
    at = f"least(greatest(n * {p} + 0.5, 1.0), n)"
    return f"(sum(CASE WHEN k = floor({at}) THEN {value} * (1 - ({at} - floor({at}))) END) + coalesce(sum(CASE WHEN k = floor({at}) + 1 THEN {value} * ({at} - floor({at})) END), 0))"


def _summary(rows: str, by: str = "") -> str:
    part, group = (f"PARTITION BY {by} ", f"GROUP BY {by}") if by else ("", "")
    keys = f"{by}, " if by else ""
    return f"WITH {rows}, kk AS (SELECT *, row_number() OVER ({part}ORDER BY stat) AS k, count(*) OVER ({part}) AS n FROM rep) SELECT {keys}round(avg(stat), 5) AS av, round(stddev_samp(stat), 5) AS se, round(avg(stat) / nullif(stddev_samp(stat), 0), 4) AS bsr, 2 * least(avg(CASE WHEN stat < 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN stat > 0 THEN 1.0 ELSE 0.0 END)) AS p, round({_hazen('stat', 0.025)}, 5) AS ci_low, round({_hazen('stat', 0.975)}, 5) AS ci_high FROM kk {group}"


def _boot(df):
    return df.select(*[F.round(c, 4 if c == "bsr" else 5).alias(c) if c in ("av", "se", "bsr", "ci_low", "ci_high") else F.col(c) for c in df.columns])


def _drawn(source: str, order: str) -> str:
    """SQL tables for counted draws over all rows of ``source``, in the order given: dr(rep, i, times) and ix(i, ...)."""
    return f"ix AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM {source}), nn AS (SELECT max(i) AS n FROM ix), dr AS (SELECT rep, {_DRAW.format(parts='rep, k, 1, 0')} % n + 1 AS i, count(*) AS times FROM nn, (SELECT unnest(range(1, {REPS + 1})) AS rep), LATERAL (SELECT unnest(range(1, n + 1)) AS k) GROUP BY ALL)"


_USERS = "u AS (SELECT user_id, CAST(user_id % 2 AS INT) AS grp, avg(value) - 50 AS v FROM events GROUP BY 1, 2)"


def _users(s, d):
    return table(s, d, "events").groupBy("user_id", (F.col("user_id") % 2).cast("int").alias("grp")).agg((F.avg("value") - 50).alias("v"))


_MEAN = f"{_USERS}, {_drawn('u', 'user_id')}, rep AS (SELECT rep, sum(times * v) / sum(times) AS stat FROM dr JOIN ix USING (i) GROUP BY rep)"
_SUMS = f"{_PAIRS}, {_drawn('q', 'id')}, sm AS (SELECT rep, sum(times) AS n, sum(times * x) AS sx, sum(times * y) AS sy, sum(times * x * x) AS sxx, sum(times * y * y) AS syy, sum(times * x * y) AS sxy FROM dr JOIN ix USING (i) GROUP BY rep), mo AS (SELECT *, sxx - sx * sx / n AS cxx, syy - sy * sy / n AS cyy, sxy - sx * sy / n AS cxy FROM sm)"

QUERIES = {
    "fdr_bh": _fdr_query(),
    "fdr_by": _fdr_query(dependent=True),
    "fdr_count_rule": _fdr_query(compat=True),
    "fdr_one_family": lambda s, d: r(U.fdr_one_family(_supplier_p(s, d), "p").select("l_returnflag", "l_suppkey", "p", "crit", "mask"), "p", "crit", digits=9),
    "friedman_ranks": lambda s, d: r(U.friedman_ranks(blocks(s, d), "event_type", "user_id", "value"), "mean_rank"),
    "friedman_test": lambda s, d: r(U.friedman(blocks(s, d), "event_type", "user_id", "value"), "q", "p", "critical_difference"),
    "friedman_q": lambda s, d: r(U.friedman(blocks(s, d), "event_type", "user_id", "value").select("n_blocks", "n_treatments", "q"), "q"),
    "quade_w": lambda s, d: r(U.quade(blocks(s, d), "event_type", "user_id", "value").select("n_blocks", "d1", "d2", "w"), "w"),
    "quade_test": lambda s, d: r(U.quade(blocks(s, d), "event_type", "user_id", "value"), "w", "p"),
    "anova_rm1_f": lambda s, d: r(U.anova_rm(weeks(s, d), "y", "t", "subject", "grp").select("effect", "ss", "df", "ms", "f"), "ss", "ms", "f", digits=4),
    "anova_rm1": lambda s, d: r(U.anova_rm(weeks(s, d), "y", "t", "subject", "grp"), "ss", "ms", "f", "p", digits=4),
    "gaussian_info": lambda s, d: r(U.gaussian_info(_line(s, d), "l_quantity", "l_extendedprice", "l_discount"), "ab", "ad", "bd", "mi_ab", "mi_ad", "mi_bd", "cmi_ab_d", "interaction", "total_correlation", "joint_entropy"),
    "f_map_r2": lambda s, d: r(U.f_map(_line(s, d), "l_extendedprice", "l_quantity", ["l_suppkey"]).select("l_suppkey", "n", "r2", "f"), "r2", "f", digits=4),
    "f_map": lambda s, d: r(U.f_map(_line(s, d), "l_extendedprice", "l_quantity", ["l_suppkey"]), "r2", "f", "p", digits=4),
    "f_map_many": lambda s, d: r(U.f_map_many(_line(s, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_suppkey"]), "r2", "f", "p", digits=4),
    "cooks_d_linear": lambda s, d: r(U.cooks_distance(table(s, d, "part"), "p_size", "p_retailprice").select("p_partkey", "leverage", "cook", "flagged"), "leverage", "cook", digits=8),
    "cooks_d_poly": lambda s, d: r(U.cooks_distance_poly(table(s, d, "part"), "p_size", "p_retailprice", 2, "p_brand"), "cook", digits=6),
    "regression_ols": lambda s, d: r(U.regression(_line(s, d), "l_extendedprice", ["l_quantity", "l_discount"]), "b", "se", "t", "p", digits=4),
    "partial_corr": lambda s, d: r(U.partial_corr(_line(s, d), "l_extendedprice", "l_quantity", ["l_discount"]), "r"),
    "sensitivity": lambda s, d: r(U.sensitivity(_line(s, d), "l_extendedprice", ["l_quantity"], ["l_discount", "l_tax"]), "mean", "sd"),
    "variance_partition": lambda s, d: r(U.variance_partition(_line(s, d), "l_extendedprice", ["l_quantity", "l_discount"]), "beta", "r", "pratt", "relative_weight", "averaged_beta", "inclusion"),
    "lmm_random_intercept": lambda s, d: r(U.random_intercept(weeks(s, d), "y", ["t"], "subject"), "b", "se", digits=4),
    "change_from_baseline": lambda s, d: r(U.change_from_baseline(weeks(s, d), "subject", "t", "y", "grp"), "difference"),
    "boot_mean_ci": lambda s, d: _boot(B.boot_summary(B.boot_mean(_users(s, d), "v", ["user_id"], (), REPS), "stat")),
    "boot_slope": lambda s, d: _boot(B.boot_summary(B.boot_slope(_pairs(s, d), "x", "y", ["id"], REPS), "stat")),
    "boot_corr": lambda s, d: _boot(B.boot_summary(B.boot_corr(_pairs(s, d), "x", "y", ["id"], REPS), "stat")),
    "boot_corr_spearman": lambda s, d: _boot(B.quickboot(_pairs(s, d), "corr_sp", "y", ["id"], other="x", reps=REPS)),
    "boot_r2": lambda s, d: _boot(B.quickboot(_pairs(s, d), "r2", "y", ["id"], other="x", reps=REPS)),
    "boot_diff_ci": lambda s, d: _boot(B.quickboot(_users(s, d), "diff", "v", ["user_id"], label="grp", reps=REPS)),
    "boot_diff_median": lambda s, d: _boot(B.quickboot(_users(s, d), "diffmed", "v", ["user_id"], label="grp", reps=REPS)),
    "boot_median": lambda s, d: _boot(B.quickboot(_users(s, d), "med", "v", ["user_id"], reps=REPS)),
    "boot_onesided": lambda s, d: _boot(B.quickboot(_users(s, d), "avg+", "v", ["user_id"], reps=REPS)),
    "boot_cluster_mean": lambda s, d: r(B.boot_summary(B.cluster_boot_mean(table(s, d, "events"), "user_id", "value", ["event_type"], REPS), "stat", ["event_type"]), "av", "se", "bsr", "ci_low", "ci_high", digits=4),
    "permutation_diff": lambda s, d: r(B.permuted(_users(s, d), "user_id", "grp", REPS).join(_users(s, d).select("user_id", "v"), "user_id").groupBy("rep").agg((F.avg(F.when(F.col("grp") == 1, F.col("v"))) - F.avg(F.when(F.col("grp") == 0, F.col("v")))).alias("stat")), "stat", digits=5),
    "split_half_reliability": lambda s, d: r(B.split_plan(_users(s, d), "user_id", 20).join(_users(s, d).select("user_id", "v"), "user_id").groupBy("rep").agg(F.count(F.when(F.col("half") == 1, 1)).alias("n1"), F.avg(F.when(F.col("half") == 1, F.col("v"))).alias("m1"), F.avg(F.when(F.col("half") == 2, F.col("v"))).alias("m2")), "m1", "m2", digits=5),
    "huber_location": lambda s, d: r(O.huber_location(table(s, d, "events"), ["event_type"], "value"), "location", "scale", digits=5),
    "gamma_threshold": lambda s, d: r(O.gamma_threshold(days(s, d).dropna(), "day", "user_id", "value"), "p"),
    "gen_esd": lambda s, d: r(O.gen_esd(blocks(s, d), "event_type", "user_id", "value"), "r", "lam"),
    "isolation_forest": lambda s, d: r(O.isolation_forest(blocks(s, d), "event_type", "user_id", "value", trees=20, depth=6), "height", "score"),
}

_RANKS = f"WITH {FULL_BLOCKS}, rk AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS rk, max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id) AS rg FROM f)"
_ANOVA = f"WITH {WEEKS}, m AS (SELECT *, avg(y) OVER () AS m, avg(y) OVER (PARTITION BY grp) AS mg, avg(y) OVER (PARTITION BY t) AS mt, avg(y) OVER (PARTITION BY grp, t) AS mgt, avg(y) OVER (PARTITION BY subject) AS ms FROM w), a AS (SELECT sum(power(mg - m, 2)) AS g, sum(power(ms - mg, 2)) AS s, sum(power(mt - m, 2)) AS t, sum(power(mgt - mg - mt + m, 2)) AS gt, sum(power(y - mgt - ms + mg, 2)) AS r, count(DISTINCT grp) AS ng, count(DISTINCT m.t) AS nt, count(DISTINCT subject) AS ns FROM m), e AS (SELECT 'G' AS effect, g AS ss, CAST(ng - 1 AS DOUBLE) AS df, g / (ng - 1) / (s / (ns - ng)) AS f FROM a UNION ALL SELECT 'S(G)', s, ns - ng, NULL FROM a UNION ALL SELECT 'T', t, nt - 1, t / (nt - 1) / (r / ((ns - ng) * (nt - 1))) FROM a UNION ALL SELECT 'GxT', gt, (ng - 1) * (nt - 1), gt / ((ng - 1) * (nt - 1)) / (r / ((ns - ng) * (nt - 1))) FROM a UNION ALL SELECT 'R', r, (ns - ng) * (nt - 1), NULL FROM a) SELECT effect, round(ss, 4) AS ss, df, round(ss / df, 4) AS ms, round(f, 4) AS f FROM e"
_DET = "(1 - ab * ab - ad * ad - bd * bd + 2 * ab * ad * bd)"


def _huber(rounds: int = 5, k: float = 1.5) -> str:
    alpha = 0.8663855974622838  # 2 Phi(1.5) - 1
    out = "WITH m0 AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), sc AS (SELECT event_type, 1.49 * median(abs(value - m)) AS s FROM events JOIN m0 USING (event_type) GROUP BY 1)"
    for i in range(1, rounds + 1):
        out += f", m{i} AS (SELECT event_type, max(m) + max(s) * sum(least(greatest((value - m) / s, -{k}), {k})) / (count(*) * {alpha}) AS m FROM events JOIN sc USING (event_type) JOIN m{i - 1} USING (event_type) GROUP BY 1)"
    return out + f" SELECT event_type, round(m, 5) AS location, round(s, 5) AS scale FROM m{rounds} JOIN sc USING (event_type)"


SQL = {
    "fdr_bh": _fdr(False),
    "fdr_by": _fdr(True),
    "fdr_one_family": _fdr(False).replace("PARTITION BY l_returnflag", ""),
    "fdr_count_rule": _fdr(False, True),
    "friedman_ranks": f"{_RANKS} SELECT event_type, round(avg(rk), 6) AS mean_rank, count(*) AS n_blocks, max(k) AS n_treatments FROM rk GROUP BY event_type",
    "friedman_q": f"{_RANKS}, mr AS (SELECT event_type, avg(rk) AS m, count(*) AS b, max(k) AS s FROM rk GROUP BY 1) SELECT b AS n_blocks, s AS n_treatments, round(12.0 * b / (s * (s + 1)) * sum(power(m - (s + 1) / 2.0, 2)), 6) AS q FROM mr GROUP BY b, s",
    "quade_w": f"{_RANKS}, bq AS (SELECT user_id, rank() OVER (ORDER BY rg) + (count(*) OVER (PARTITION BY rg) - 1) / 2.0 AS q FROM (SELECT user_id, max(rg) AS rg FROM rk GROUP BY 1)), sx AS (SELECT event_type, q * (rk - (k + 1) / 2.0) AS s, k FROM rk JOIN bq USING (user_id)), aj AS (SELECT event_type, sum(s) AS sj, sum(s * s) AS ss, count(*) AS b, max(k) AS k FROM sx GROUP BY 1), z AS (SELECT sum(ss) AS a, sum(sj * sj) / max(b) AS bb, max(b) AS b, max(k) AS k FROM aj) SELECT b AS n_blocks, k - 1 AS d1, (b - 1) * (k - 1) AS d2, round((b - 1) * bb / (a - bb), 6) AS w FROM z",
    "anova_rm1_f": _ANOVA,
    "gaussian_info": f"WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ad, corr(l_extendedprice, l_discount) AS bd FROM lineitem) SELECT round(ab, 6) AS ab, round(ad, 6) AS ad, round(bd, 6) AS bd, round(-0.5 * ln(1 - ab * ab), 6) AS mi_ab, round(-0.5 * ln(1 - ad * ad), 6) AS mi_ad, round(-0.5 * ln(1 - bd * bd), 6) AS mi_bd, round(-0.5 * ln({_DET} / ((1 - ad * ad) * (1 - bd * bd))), 6) AS cmi_ab_d, round(-0.5 * ln(1 - ab * ab) + 0.5 * ln({_DET} / ((1 - ad * ad) * (1 - bd * bd))), 6) + 0.0 AS interaction, round(-0.5 * ln({_DET}), 6) AS total_correlation, round(1.5 * ln(2 * pi() * exp(1.0)) + 0.5 * ln({_DET}), 6) AS joint_entropy FROM c",
    "f_map_r2": "SELECT l_suppkey, count(*) AS n, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, round(regr_r2(l_extendedprice, l_quantity) * (count(*) - 2) / nullif(1 - regr_r2(l_extendedprice, l_quantity), 0), 4) AS f FROM lineitem GROUP BY 1",
    "cooks_d_linear": "WITH g AS (SELECT count(*) AS n, avg(p_size) AS mx, regr_sxx(p_retailprice, p_size) AS sxx, regr_syy(p_retailprice, p_size) AS syy, regr_sxy(p_retailprice, p_size) AS sxy, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part), x AS (SELECT p_partkey, n, 1.0 / n + power(p_size - mx, 2) / sxx AS h, p_retailprice - a - b * p_size AS e, (syy - sxy * sxy / sxx) / (n - 2) AS mse FROM part, g) SELECT p_partkey, round(h, 8) AS leverage, round(e * e * h / (2 * mse * power(1 - h, 2)), 8) AS cook, e * e * h / (2 * mse * power(1 - h, 2)) > 4.0 / n AS flagged FROM x",
    "partial_corr": "WITH c AS (SELECT corr(l_extendedprice, l_quantity) AS xy, corr(l_extendedprice, l_discount) AS xz, corr(l_quantity, l_discount) AS yz FROM lineitem) SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r FROM c",
    "change_from_baseline": f"WITH {WEEKS}, c AS (SELECT *, y - first_value(y) OVER (PARTITION BY subject ORDER BY t) AS ch FROM w) SELECT t, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1, round(avg(ch) FILTER (grp = 1) - avg(ch) FILTER (grp = 0), 6) AS difference FROM c WHERE t > 0 GROUP BY t",
    "boot_mean_ci": _summary(_MEAN),
    "boot_slope": _summary(f"{_SUMS}, rep AS (SELECT rep, cxy / nullif(cxx, 0) AS stat FROM mo)"),
    "boot_corr": _summary(f"{_SUMS}, rep AS (SELECT rep, cxy / nullif(sqrt(cxx * cyy), 0) AS stat FROM mo)"),
    "permutation_diff": f"WITH {_USERS}, ix AS (SELECT *, row_number() OVER (ORDER BY user_id) AS i FROM u), g AS (SELECT rep, user_id, row_number() OVER (PARTITION BY rep ORDER BY {_DRAW.format(parts='rep, user_id, 1')}, user_id) AS i FROM ix, (SELECT unnest(range(1, {REPS + 1})) AS rep)), p AS (SELECT g.rep, g.user_id, ix.grp FROM g JOIN ix USING (i)) SELECT CAST(rep AS INT) AS rep, round(avg(v) FILTER (p.grp = 1) - avg(v) FILTER (p.grp = 0), 5) AS stat FROM p JOIN u USING (user_id) GROUP BY rep",
    "split_half_reliability": f"WITH {_USERS}, g AS (SELECT rep, user_id, v, row_number() OVER (PARTITION BY rep ORDER BY {_DRAW.format(parts='rep, user_id, 1')}, user_id) AS k, count(*) OVER (PARTITION BY rep) AS n FROM u, (SELECT unnest(range(1, 21)) AS rep)), h AS (SELECT *, CASE WHEN k <= round(n * 0.5) THEN 1 ELSE 2 END AS half FROM g) SELECT CAST(rep AS INT) AS rep, count(*) FILTER (half = 1) AS n1, round(avg(v) FILTER (half = 1), 5) AS m1, round(avg(v) FILTER (half = 2), 5) AS m2 FROM h GROUP BY rep",
    "huber_location": _huber(),
}
