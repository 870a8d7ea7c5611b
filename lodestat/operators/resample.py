"""Seeded resampling: draws, permutations, splits and bootstrap summaries.

A draw is a hash of (replicate, index, seed), so it is the same on any partitioning and in any engine with md5.
Statistics that are functions of sums take draws as counts; nothing is exploded beyond replicates times rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import finite, percentiles, ratio, tied_rank

#: Draws that a task makes at a time; indices of a block at least, and blocks at most; bins of a median.
SPAN, WIDTH, WIDEST, BINS = 262_144, 4096, 512, 256
#: Rows of a range that is numbered in one task, and ranges at most.
BLOCK, MOST_BLOCKS = 50_000, 128
#: Replicates whose draw counts are held at a time.
AT_ONCE = 64
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def hash_int(*parts: Column | str | int) -> Column:
    """First 32 bits of the md5 of the parts joined by colons, as bigint."""
    columns = [F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def draws(spark: SparkSession, n: int, reps: int, seed: int = 1) -> DataFrame:
    """(rep, i, times): how often index i of 1..n is drawn, with replacement, in each of ``reps`` replicates."""
    grid = spark.range(reps).select((F.col("id") + 1).alias("rep")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return grid.select("rep", (hash_int("rep", "k", seed) % n + 1).alias("i")).groupBy("rep", "i").agg(F.count("*").alias("times"))


def group_draws(indexed: DataFrame, by: Sequence[str], reps: int, seed: int = 1) -> DataFrame:
    """(by..., rep, i, times) for each group of ``indexed``, which has (by..., i) with i running from 1."""

    def kernel(pdf: pd.DataFrame, times: np.ndarray, numbers: np.ndarray, _: tuple) -> dict[str, object]:
        r, at = np.nonzero(times)
        return {"rep": numbers[r], "i": pdf["i"].to_numpy()[at], "times": times[r, at]}

    return _over_draws(indexed, by, reps, seed, kernel, ["i"], "i int, times bigint")


def md5_words(head: bytes, k: np.ndarray, tail: bytes) -> np.ndarray:
    """First 32 bits of the md5 of head, each number of ``k`` in decimal, and tail, as ``hash_int`` has them, for a whole array at once."""
    out, digits = np.empty(len(k), dtype=np.uint32), np.searchsorted(10 ** np.arange(1, 19), k, side="right") + 1
    for d in np.unique(digits):
        at = digits == d
        n, size = k[at], len(head) + int(d) + len(tail)
        if size > 55:  # more than one block of md5
            out[at] = [int.from_bytes(hashlib.md5(head + str(v).encode() + tail).digest()[:4]) for v in n.tolist()]
            continue
        block = np.zeros(64, dtype=np.uint8)
        block[:size] = np.frombuffer(head + b"\0" * int(d) + tail, dtype=np.uint8)
        block[size] = 128
        block[56:58] = size * 8 % 256, size * 8 // 256
        words: list = [int(w) for w in block.view("<u4")]
        for j in range(int(d)):
            place = len(head) + j
            digit = (n // 10 ** (int(d) - 1 - j) % 10 + 48).astype(np.uint32) << np.uint32(8 * (place % 4))
            old = words[place // 4]
            words[place // 4] = digit + (old if isinstance(old, np.ndarray) else np.uint32(old))
        x, y, z, w = (np.full(len(n), v, dtype=np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for i in range(64):
            if i < 16:
                f, g = w ^ (y & (z ^ w)), i
            elif i < 32:
                f, g = z ^ (w & (y ^ z)), (5 * i + 1) % 16
            elif i < 48:
                f, g = y ^ z ^ w, (3 * i + 5) % 16
            else:
                f, g = z ^ (y | ~w), 7 * i % 16
            m = words[g]
            f += x
            f += m + np.uint32(_SINES[i]) if isinstance(m, np.ndarray) else np.uint32((m + _SINES[i]) % 2**32)
            turn = _TURNS[i // 16][i % 4]
            x, w, z, y = w, z, y, y + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
        out[at] = (x + np.uint32(0x67452301)).byteswap()
    return out


def _block_draws(rows: DataFrame, by: Sequence[str], reps: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (by..., i, ...) with their block of indices and place in it, and (by..., _blk, rep, at): draws as packed places, by blocks.

    Draw k of a replicate is ``hash_int(rep, k, seed, *by) % n + 1``; runs of draws are dealt to all tasks.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    sizes = rows.groupBy(*by).agg(F.max("i").cast("bigint").alias("_n"))
    sizes = sizes.withColumn("_width", F.greatest(F.lit(WIDTH), F.ceil(F.col("_n") / WIDEST)).cast("bigint"))
    runs = sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / SPAN).cast("int"))))
    runs = runs.withColumn("_tail", F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by])).repartition(tasks, *by, "rep", "_run")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, n, width, rep, run, tail in zip(range(len(pdf)), pdf["_n"], pdf["_width"], pdf["rep"], pdf["_run"], pdf["_tail"], strict=True):
                k = np.arange(run * SPAN + 1, min((run + 1) * SPAN, n) + 1)
                parts = [md5_words(f"{rep}:".encode(), k[lo : lo + 16384], f":{tail}".encode()) for lo in range(0, len(k), 16384)]
                i = np.sort(np.concatenate(parts).astype(np.int64) % n)
                blocks = np.arange(i[0] // width, i[-1] // width + 1)
                cuts = np.searchsorted(i, blocks[1:] * width)
                packed = [x.astype(np.uint16 if width <= 65536 else np.uint32).tobytes() for x in np.split(i % width, cuts)]
                out = pdf.iloc[[row] * len(blocks)][list(by)].reset_index(drop=True)
                yield out.assign(_blk=blocks, _wide=bool(width > 65536), rep=int(rep), at=packed)

    draws = runs.mapInPandas(draw, f"{kinds}, _blk bigint, _wide boolean, rep int, at binary")
    same = [F.col(c).eqNullSafe(F.col(f"_s{k}")) for k, c in enumerate(by)]
    placed = rows.join(sizes.select(*[F.col(c).alias(f"_s{k}") for k, c in enumerate(by)], "_width"), same).drop(*[f"_s{k}" for k in range(len(by))])
    return placed.withColumns({"_blk": F.floor((F.col("i") - 1) / F.col("_width")), "_at": ((F.col("i") - 1) % F.col("_width")).cast("int"), "_width": F.col("_width")}), draws


def _over_draws(rows: DataFrame, by: Sequence[str], reps: int, seed: int, kernel: Callable[[pd.DataFrame, np.ndarray, np.ndarray, tuple], dict[str, object]], columns: Sequence[str], fields: str, parts: Sequence[str] = ()) -> DataFrame:
    """(by..., parts..., rep, fields): what ``kernel(rows, times, reps, (by...))`` gives for the rows of each block and part, and how often each replicate drew each row."""
    placed, draws = _block_draws(rows, by, reps, seed)
    placed = placed.select(*by, "_blk", "_at", "_width", *parts, *columns)
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in [*by, *parts])

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = int(left["_width"].iloc[0])
            groups = [((), left)] if not parts else [(k, g) for k, g in left.groupby(list(parts), dropna=False, sort=False)]
            right = right.sort_values("rep", kind="stable")
            numbers, first = np.unique(right["rep"].to_numpy(), return_index=True)
            packed = [np.frombuffer(v, dtype=np.uint32 if wide else np.uint16).astype(np.int64) for v, wide in zip(right["at"], right["_wide"], strict=True)]
            for lo in range(0, len(numbers), AT_ONCE):
                some = numbers[lo : lo + AT_ONCE]
                ends = [*first[lo : lo + AT_ONCE], first[lo + AT_ONCE] if lo + AT_ONCE < len(first) else len(packed)]
                times = np.array([np.bincount(np.concatenate(packed[x:y]), minlength=width) for x, y in zip(ends, ends[1:], strict=False)])
                for names, g in groups:
                    found = kernel(g, times[:, g["_at"].to_numpy()], some, key[: len(by)])
                    out.append(pd.DataFrame({**dict(zip(by, key, strict=False)), **dict(zip(parts, names, strict=True)), **found}))
        out = [x for x in out if len(x)]
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in [*by, *parts, "rep", *[f.split()[0] for f in fields.split(", ")]]})

    return placed.groupBy(*by, "_blk").cogroup(draws.groupBy(*by, "_blk")).applyInPandas(run, f"{kinds}rep int, {fields}")


def resampled_sums(rows: DataFrame, by: Sequence[str], columns: Sequence[str], reps: int, seed: int = 1, parts: Sequence[str] = ()) -> DataFrame:
    """(by..., parts..., rep, n, columns...): in each replicate the drawn rows of ``rows`` (by..., i, parts..., columns...) and the sums of the columns over them."""
    names = list(columns)

    def kernel(pdf: pd.DataFrame, times: np.ndarray, numbers: np.ndarray, _: tuple) -> dict[str, object]:
        return {"rep": numbers, "n": times.sum(axis=1), "s": list(times.astype(float) @ pdf[names].to_numpy(float))}

    part = _over_draws(rows, by, reps, seed, kernel, names, "n bigint, s array<double>", parts)
    return part.groupBy(*by, *parts, "rep").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(c) for j, c in enumerate(names)])


def _in_blocks(df: DataFrame, order: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, DataFrame] | None:
    """``df`` with ``_block``, a range of the order about BLOCK rows long, and (by..., _block, _before) with the rows of the group before it.

    Bounds are keys of a hash sample; a row's block follows from its own keys.  None where one block is enough.
    """
    df = df.persist()
    n = df.count()
    blocks = min(-(-n // BLOCK), MOST_BLOCKS)
    if blocks < 2:
        return None
    key = F.struct(*[F.col(o) for o in order])
    sample = df.select(key.alias("k")).filter(F.pmod(F.xxhash64("k"), F.lit(max(1, n // (blocks * 20)))) == 0).distinct().orderBy("k").collect()  # some 20 keys a block
    bounds = [sample[len(sample) * j // blocks].k for j in range(1, blocks)] if sample else []
    if not bounds:
        return None
    kinds = [df.schema[o].dataType for o in order]
    at = F.array(*[F.struct(*[F.lit(v).cast(t).alias(o) for v, t, o in zip(k, kinds, order, strict=True)]) for k in bounds])
    dealt = df.withColumn("_block", F.size(F.filter(at, lambda b: b <= key)))
    counts = dealt.groupBy(*by, "_block").agg(F.count("*").alias("_c"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return dealt, counts.select(*by, "_block", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))


def _joined(dealt: DataFrame, before: DataFrame, by: Sequence[str]) -> DataFrame:
    other = before.select(*[F.col(c).alias(f"_b{k}") for k, c in enumerate([*by, "_block"])], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate([*by, "_block"])]
    return dealt.join(other, same).drop(*[f"_b{k}" for k in range(len(by) + 1)])


def indexed(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``i`` = 1, 2, ... within each group; long groups are numbered by ranges of the order."""
    found = _in_blocks(df, order, by)
    if found is None:
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        return df.withColumn("i", F.row_number().over(w.orderBy(*order)))
    place = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*order))
    return _joined(found[0].withColumn("_at", place), found[1], by).withColumn("i", (F.col("_at") + F.col("_before")).cast("int")).drop("_block", "_at", "_before")


def value_ranks(df: DataFrame, x: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the tied rank of ``x``, which is not null, within each group; long groups are ranked by ranges of values."""
    found = _in_blocks(df, [x], by)
    if found is None:
        keys = list(by) or ["_all"]
        return df.withColumn("_all", F.lit(0)).withColumn(out, tied_rank(x, keys)).drop("_all")
    return _joined(found[0].withColumn(out, tied_rank(x, [*by, "_block"])), found[1], by).withColumn(out, F.col(out) + F.col("_before")).drop("_block", "_before")


def split_plan(df: DataFrame, id_col: str, reps: int, seed: int = 1, strata: Sequence[str] = (), share: float = 0.5) -> DataFrame:
    """(rep, id, strata..., half): a random ``share`` of the distinct ids is half 1, the rest half 2, within each stratum."""
    ids = df.select(id_col, *strata).distinct().withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    w = Window.partitionBy("rep", *strata)
    place = F.row_number().over(w.orderBy(hash_int("rep", id_col, seed), id_col))
    return ids.withColumn("half", F.when(place <= F.round(F.count("*").over(w) * share), 1).otherwise(2))


def permuted(df: DataFrame, id_col: str, label: str, reps: int, seed: int = 1, within: Sequence[str] = ()) -> DataFrame:
    """(rep, within..., id, label) with labels shuffled among the ids, within groups where given."""
    by = list(within)
    base = indexed(df.select(id_col, label, *by), [id_col], by)
    grid = base.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    order = F.row_number().over(Window.partitionBy("rep", *by).orderBy(hash_int("rep", id_col, seed), id_col))
    return grid.select("rep", *by, id_col, order.alias("i")).join(base.select(*by, "i", label), [*by, "i"]).select("rep", *by, id_col, label)


def boot_summary(reps: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """By group: mean, standard error, 2.5 and 97.5 percentiles, mean / se, and 2 * min(share < 0, share > 0)."""
    reps = reps.persist()  # a row for each replicate, read twice
    core = reps.groupBy(*by).agg(
        F.avg(value).alias("av"), F.stddev_samp(value).alias("se"), ratio(F.avg(value), F.stddev_samp(value)).alias("bsr"),
        (2 * F.least(F.avg((F.col(value) < 0).cast("double")), F.avg((F.col(value) > 0).cast("double")))).alias("p"))
    ci = percentiles(reps, value, {"ci_low": 0.025, "ci_high": 0.975}, by)
    return core.join(ci, list(by)) if by else core.crossJoin(F.broadcast(ci))  # one row each


def boot_mean(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), reps: int = 2000, seed: int = 1) -> DataFrame:
    """(by..., rep, stat): replicate means, from counted draws."""
    rows = indexed(df.select(*by, finite(value).alias("v"), *[o for o in order if o not in by]).filter("v IS NOT NULL"), order, by).select(*by, "i", "v")
    if not by:
        rows = rows.withColumn("_g", F.lit(0))
    keys = list(by) or ["_g"]
    return resampled_sums(rows, keys, ["v"], reps, seed).select(*by, "rep", (F.col("v") / F.col("n")).alias("stat"))


def boot_median(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), reps: int = 2000, seed: int = 1) -> DataFrame:
    """(by..., rep, stat): replicate medians.

    Draws are counted by ``BINS`` bins of ranks first; only those of the bins that hold a replicate's middle are then put in order.
    The bins of the middle, a row for each group and replicate, pass through the driver.
    """
    rows = indexed(df.select(*by, finite(value).alias("v"), *[o for o in order if o not in by]).filter("v IS NOT NULL"), order, by).select(*by, "i", "v").withColumn("_g", F.lit(0))
    keys = ["_g", *by]
    placed = indexed(rows.withColumnRenamed("i", "_i"), ["v", "_i"], keys).withColumnsRenamed({"i": "_p", "_i": "i"})
    same = [F.col(c).eqNullSafe(F.col(f"_m{k}")) for k, c in enumerate(keys)]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_m")).withColumnsRenamed({c: f"_m{k}" for k, c in enumerate(keys)})
    binned = placed.join(sizes, same).select(*keys, "i", "v", F.floor((F.col("_p") - 1) * BINS / F.col("_m")).cast("int").alias("bin")).persist()

    def count(pdf: pd.DataFrame, times: np.ndarray, numbers: np.ndarray, _: tuple) -> dict[str, object]:
        return {"rep": numbers, "c": [np.bincount(pdf["bin"], weights=t, minlength=BINS).astype(np.int64) for t in times]}

    counts = _over_draws(binned, keys, reps, seed, count, ["bin"], "c array<bigint>").groupBy(*keys, "rep").agg(F.array(*[F.sum(F.col("c")[j]) for j in range(BINS)]).alias("c"))
    middle: dict[tuple, tuple[int, int, int]] = {}
    for row in counts.collect():  # a row for each group and replicate
        upto = np.cumsum(row.c)
        low, high = (int(upto[-1]) + 1) // 2, (int(upto[-1]) + 2) // 2
        first, last = int(np.searchsorted(upto, low)), int(np.searchsorted(upto, high))
        middle[(*row[: len(keys)], row.rep)] = first, last, int(upto[first]) - int(row.c[first])

    def near(pdf: pd.DataFrame, times: np.ndarray, numbers: np.ndarray, key: tuple) -> dict[str, object]:
        bins, v = pdf["bin"].to_numpy(), pdf["v"].to_numpy()
        first, last, before = np.array([middle[(*key, int(rep))] for rep in numbers]).T
        # Ranks start above what lies below the first bin; bins between the two have no draws.
        r, at = np.nonzero(((bins == first[:, None]) | (bins == last[:, None])) & (times > 0))
        return {"rep": numbers[r], "v": v[at], "times": times[r, at], "n": before[r]}

    found = _over_draws(binned, keys, reps, seed, near, ["v", "bin"], "v double, times bigint, n bigint")
    w = Window.partitionBy(*keys, "rep").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.groupBy(*keys, "rep", "v", "n").agg(F.sum("times").alias("times"))
    found = found.withColumn("_upto", F.col("n") + F.sum("times").over(w))
    ends = counts.select(*keys, "rep", F.aggregate("c", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("_all")).withColumnsRenamed({c: f"_e{k}" for k, c in enumerate([*keys, "rep"])})
    at = found.join(ends, [F.col(c).eqNullSafe(F.col(f"_e{k}")) for k, c in enumerate([*keys, "rep"])])
    holds = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("times") < rank)
    low, high = (F.max(F.when(holds(F.floor((F.col("_all") + j) / 2)), F.col("v"))) for j in (1, 2))
    return at.groupBy(*by, "rep").agg(((low + high) / 2).alias("stat"))


def _moments(df: DataFrame, x: str, y: str, order: Sequence[str], reps: int, seed: int, by: Sequence[str]) -> DataFrame:
    rows = df.select(*by, finite(x).alias("x"), finite(y).alias("y"), *[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)]).filter("x IS NOT NULL AND y IS NOT NULL")
    rows = indexed(rows, [f"_o{k}" for k in range(len(order))], by).select(*by, "i", "x", "y").withColumn("_g", F.lit(0))
    keys = ["_g", *by]
    rows = rows.select(*keys, "i", F.col("x").alias("sx"), F.col("y").alias("sy"), F.expr("x * x AS sxx"), F.expr("y * y AS syy"), F.expr("x * y AS sxy"))
    sums = resampled_sums(rows, keys, ["sx", "sy", "sxx", "syy", "sxy"], reps, seed).select(*by, "rep", "n", "sx", "sy", "sxx", "syy", "sxy")
    return sums.withColumns({"cxx": F.expr("sxx - sx * sx / n"), "cyy": F.expr("syy - sy * sy / n"), "cxy": F.expr("sxy - sx * sy / n")})


def boot_corr(df: DataFrame, x: str, y: str, order: Sequence[str], reps: int = 2000, seed: int = 1, by: Sequence[str] = (), ranked: bool = False) -> DataFrame:
    """(by..., rep, stat): replicate correlations, Pearson's or, if ``ranked``, Spearman's."""
    if ranked:
        df = df.filter(finite(x).isNotNull() & finite(y).isNotNull())
        df = value_ranks(value_ranks(df, x, "_rx", by), y, "_ry", by)
        x, y = "_rx", "_ry"
    m = _moments(df, x, y, order, reps, seed, by)
    return m.select(*by, "rep", ratio(F.col("cxy"), F.sqrt(F.greatest(F.col("cxx") * F.col("cyy"), F.lit(0.0)))).alias("stat"))


def boot_slope(df: DataFrame, x: str, y: str, order: Sequence[str], reps: int = 2000, seed: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(by..., rep, stat, intercept, r2): replicate least-squares lines of y on x."""
    m = _moments(df, x, y, order, reps, seed, by).withColumn("stat", ratio(F.col("cxy"), F.col("cxx")))
    return m.select(*by, "rep", "stat", F.expr("(sy - stat * sx) / n").alias("intercept"), ratio(F.col("cxy") * F.col("cxy"), F.col("cxx") * F.col("cyy")).alias("r2"))


def boot_diff(df: DataFrame, value: str, label: str, order: Sequence[str], reps: int = 2000, seed: int = 1, median: bool = False) -> DataFrame:
    """(rep, stat): mean (or median) of the class labelled 1 less that of the class labelled 0, resampled apart."""
    stat = (boot_median if median else boot_mean)(df.filter(F.col(label).isin(0, 1)), value, order, [label], reps, seed)
    return stat.groupBy("rep").agg((F.max(F.when(F.col(label) == 1, F.col("stat"))) - F.max(F.when(F.col(label) == 0, F.col("stat")))).alias("stat"))


def one_sided(reps: DataFrame, value: str, upper: bool) -> DataFrame:
    """av, se, one-sided 5 % bound and one-tailed p of a replicate table, for a mean above (``upper``) or below 0."""
    reps = reps.persist()
    side = F.col(value) <= 0 if upper else F.col(value) >= 0
    core = reps.agg(F.avg(value).alias("av"), F.stddev_samp(value).alias("se"), F.avg(side.cast("double")).alias("p"))
    return core.crossJoin(F.broadcast(percentiles(reps, value, {"ci_low" if upper else "ci_high": 0.05 if upper else 0.95})))  # one row each


def quickboot(df: DataFrame, mode: str, value: str, order: Sequence[str], other: str | None = None, label: str | None = None, reps: int = 2000, seed: int = 1) -> DataFrame:
    """Bootstrap dispatcher: one row with av, se, p and confidence bounds.

    Modes: avg, avg+, avg-, med, med+, med- of ``value``; corr_pe, corr_sp, r2, reg of ``value`` on ``other``; diff, diff+, diff-, diffmed,
    diffmed+, diffmed- of class 1 less class 0 of ``label``; diffpair of ``value`` less ``other`` row by row.  Signed modes are one-sided.
    """
    core, sign = mode.rstrip("+-"), mode[-1:] if mode[-1:] in "+-" else ""
    if core == "diffpair":
        df, core, value = df.withColumn("_d", F.col(value) - F.col(other)), "avg", "_d"
    if core in ("avg", "med"):
        rows = (boot_mean if core == "avg" else boot_median)(df, value, order, (), reps, seed)
    elif core in ("corr_pe", "corr_sp"):
        rows = boot_corr(df, other, value, order, reps, seed, ranked=core == "corr_sp")
    elif core == "reg":
        rows = boot_slope(df, other, value, order, reps, seed)
    elif core == "r2":
        rows = boot_slope(df, other, value, order, reps, seed).select("rep", F.col("r2").alias("stat"))
    elif core in ("diff", "diffmed"):
        rows = boot_diff(df, value, label, order, reps, seed, core == "diffmed")
    else:
        raise ValueError(f"unknown mode {mode}")
    out = one_sided(rows, "stat", sign == "+") if sign else boot_summary(rows, "stat")
    return out.withColumn("p", F.lit(None).cast("double")) if core == "r2" else out


def cluster_boot_mean(df: DataFrame, cluster: str, value: str, by: Sequence[str] = (), reps: int = 1000, seed: int = 1) -> DataFrame:
    """(by..., rep, stat): replicate means where whole clusters are drawn; each clone counts as a cluster of its own."""
    sums = df.filter(finite(value).isNotNull()).groupBy(cluster, *by).agg(F.sum(finite(value)).alias("s"), F.count("*").alias("c"))
    ids = indexed(df.select(cluster).distinct(), [cluster]).withColumn("_g", F.lit(0))
    drawn = resampled_sums(ids.join(sums, cluster).select("_g", "i", *by, "s", "c"), ["_g"], ["s", "c"], reps, seed, parts=by)
    return drawn.filter("n > 0").select(*by, "rep", (F.col("s") / F.col("c")).alias("stat"))
