"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a seeded hash of its documents.  A source's quota is an
exact number of block draws: whole passes over its blocks, then the first blocks of the permutation up
to the words still wanted, then single documents of the blocks at the edge, and, while words are wanted that a later document
could fill, the documents of later blocks that fit, in turns.  A binary tree splits
the vector of quotas among the output shards: each node draws how many blocks of each source go left from
the multivariate hypergeometric distribution, so that shards have equally many blocks and quotas stay exact.
Each shard takes its own disjoint range of every source's permuted draws, and is shuffled within itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, WORD, checkpointed

BLOCK_DOCS = 16
#: Blocks from the edge on from which the nearest sum of documents is taken in one turn.
EDGE_BLOCKS = 4
SUPER_BLOCKS = 512
WORDS_PER_SHARD = 20_000_000
MIN_SHARDS, MAX_SHARDS = 16, 4096
#: Words of a shard that one task shuffles, and the partitions of a mix above which its slices grow instead.
SLICE_WORDS, MOST_SLICES = 2_000_000, 200_000
#: Sources whose quotas are split by one tree, in one task.
TREE_SOURCES = 256
#: One in so many rows makes a source hot, if the table of sources is too large to send to every executor.
HOT_SHARE = 1000


def level(per: DataFrame, total: int, max_repeat: float) -> float:
    """What a unit of weight takes, so that ``total`` is shared by weight and no source takes over ``max_repeat`` times its size.

    ``per`` has (w, weight) of each source.  What sources can't take raises the level for the others, until none is above its bound.
    """
    reached, capped = 0.0, -1
    while True:
        full = F.lit(reached) * F.col("weight") > F.lit(float(max_repeat)) * F.col("w")
        row = per.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("w"))).alias("w"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if row.n == capped or not row.weight:
            return reached
        capped, reached = row.n, (total - max_repeat * (row.w or 0)) / row.weight


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources table of block counts whose columns sum to ``quotas`` and whose rows differ by one at most."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        total = int(counts.sum())
        go_left = total * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(counts, go_left, method="marginals") if go_left else np.zeros_like(counts)
        split(left, lo, mid)
        split(counts - left, mid, hi)

    split(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def placements(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (5, 2, 1),
    max_repeat: int = 3,
    seed: int = 17,
    shards: int | None = None,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_copies`` and ``mix_places``.

    ``mix_places`` has one (epoch, shard, place) for each copy that the mix takes; a document outside the
    mix has none.  ``weights`` repeat over the sources in code-point order, null last.  A null text has no
    words; null ids and sources are ordinary values; rows equal in id, source and size are taken together;
    an empty table gives an empty one.  Other
    columns stay, but ``docs`` may have none with a name given here or beginning with ``p_``; ``mix`` has no such limit.  Reruns agree: every
    choice follows from the seed and the rows, not from partitions.
    """
    return _placed(docs, id_col, source_col, text_col, weights, max_repeat, seed, shards, block_docs)[0]


def _placed(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3, seed: int = 17, shards: int | None = None, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, int, int]:
    """Placements, the number of shards, and all words.  The plan of sources is a table like any other; the driver sees sums of it."""
    row_hash = F.xxhash64(F.lit(seed), F.col(source_col), F.col(id_col), F.col("mix_size"))
    sized = docs.withColumn("mix_size", word_count(text_col))
    base = checkpointed(sized.select(F.col(source_col).alias("s"), F.col("mix_size").alias("w"), row_hash.alias("h")))

    per = _ranked(base.groupBy("s").agg(F.count("*").alias("n"), F.sum("w").alias("w")))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    count, total = per.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    target = F.least(F.lit(level(per, total, max_repeat)) * F.col("weight"), (max_repeat * F.col("w")).cast("double"))
    per = per.withColumn("target", target).withColumn("blocks", F.ceil(F.col("n") / block_docs))
    per = per.withColumn("passes", F.coalesce(F.floor(F.try_divide("target", F.col("w").cast("double"))), F.lit(0)).cast("int"))
    per = per.withColumn("wanted", F.round(F.col("target") - F.col("passes") * F.col("w")).cast("bigint"))

    rows = base.count()
    in_block = _with_source(base, per.select(F.col("s").alias("s2"), "n", "blocks", "wanted"), "s2", count * 64, rows)
    in_block = in_block.select("s", "w", "h", "wanted", F.pmod("h", F.col("blocks")).alias("block"))
    edges = checkpointed(_edges(in_block, SUPER_BLOCKS))
    extra = _extras(in_block, edges)
    named = edges.join(extra, edges.s.eqNullSafe(extra.s3), "left").select(F.col("s").alias("s2"), F.col("block").alias("edge"), "picks", "ranges")
    per = per.join(named, per.s.eqNullSafe(named.s2), "left").drop("s2").withColumns({"picks": F.coalesce("picks", F.array().cast("array<bigint>")), "ranges": F.coalesce("ranges", F.array().cast(RANGES))})
    # A range that goes on to the end ends with the source's blocks.
    per = per.withColumn("ranges", F.transform("ranges", lambda x: F.struct(x["lo"].alias("lo"), F.least(x["to"], F.col("blocks").cast("bigint")).alias("to"), x["most"].alias("most"))))
    per = per.withColumn("first", F.coalesce("edge", F.when(F.col("wanted") == 0, 0).otherwise(F.col("blocks"))))
    last = F.greatest(F.col("first") + (F.size("picks") > 0).cast("int"), F.coalesce(F.array_max(F.transform("ranges", lambda x: x["to"])), F.lit(0)))
    per = per.withColumn("draws", F.col("passes") * F.col("blocks") + last)

    if shards is None:
        shards = min(MAX_SHARDS, max(MIN_SHARDS, -(-total // WORDS_PER_SHARD)))
    kind = docs.schema[source_col].dataType.simpleString()

    def split(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        draws = group["draws"].to_numpy()
        rng = np.random.default_rng([seed, int(group["tree"][0].as_py())])
        bounds = np.cumsum(splitting_tree(draws, shards, rng), axis=0).T
        steps = [_permutation(int(n), rng) for n in draws]
        out = group.select(["s", "n", "w", "target", "blocks", "passes", "first", "picks", "ranges", "draws"])
        ranges = pa.array(out["ranges"].to_pylist(), pa.list_(pa.struct([(x, pa.int64()) for x in ("lo", "to", "most")])))
        out = out.set_column(out.schema.get_field_index("ranges"), "ranges", ranges)
        return out.append_column("step", pa.array([x for x, _ in steps], pa.int64())).append_column("shift", pa.array([x for _, x in steps], pa.int64())).append_column("bounds", pa.array(list(bounds), pa.list_(pa.int64())))

    columns = per.select("s", "rank", "n", "w", "target", "blocks", "passes", "first", "picks", "ranges", F.col("draws").cast("bigint").alias("draws"), F.floor(F.col("rank") / TREE_SOURCES).cast("bigint").alias("tree"))
    columns = columns.withColumns({"blocks": F.col("blocks").cast("bigint"), "first": F.col("first").cast("bigint")})
    plan = columns.groupBy("tree").applyInArrow(split, f"s {kind}, n bigint, w bigint, target double, blocks bigint, passes int, first bigint, picks array<bigint>, ranges {RANGES}, draws bigint, step bigint, shift bigint, bounds array<bigint>")
    plan = checkpointed(plan).select(F.col("s").alias("p_source"), F.col("n").alias("n"), F.col("w").alias("mix_source_size"), F.col("target").alias("mix_target"), *[F.col(c).alias(f"p_{c}") for c in ("blocks", "passes", "first", "picks", "ranges", "draws", "step", "shift", "bounds")])

    drawn = _with_source(sized, plan.withColumnRenamed("n", "p_n"), "p_source", count * (8 * shards + 512), rows, source_col, "p_n")
    drawn = drawn.withColumn("p_hash", row_hash).withColumn("p_block", F.pmod("p_hash", F.col("p_blocks")))
    drawn = drawn.withColumn("p_ranged", F.exists("p_ranges", lambda x: (F.col("p_block") >= x["lo"]) & (F.col("p_block") < x["to"]) & (F.col("mix_size") > 0) & (F.col("mix_size") <= x["most"])))
    extra = (F.col("p_block") < F.col("p_first")) | F.col("p_ranged") | F.array_contains("p_picks", F.col("p_hash"))
    drawn = drawn.withColumn("mix_copies", F.col("p_passes") + extra.cast("int"))
    place = f"""
        transform(filter(sequence(0, {max_repeat}), e -> e < mix_copies), e -> struct(
            e AS epoch,
            cast(size(filter(p_bounds, b -> b <= pmod((e * p_blocks + if(e = p_passes AND NOT p_ranged, least(p_block, p_first), p_block)) * p_step + p_shift, greatest(p_draws, 1)))) AS int) AS shard,
            xxhash64({seed}, p_hash, e) AS place))
    """
    kept = [*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_places"]
    return drawn.withColumn("mix_places", F.expr(place)).select(*kept), shards, total


def _ranked(per: DataFrame) -> DataFrame:
    """``per`` with ``rank``, from 0, by source in code-point order, null last; no task sees all sources."""
    at = F.spark_partition_id()
    dealt = checkpointed(per.orderBy(F.col("s").asc_nulls_last()).withColumns({"part": at, "nth": F.monotonically_increasing_id() - F.shiftleft(at.cast("bigint"), 33)}))
    before, starts = 0, []
    for r in dealt.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        starts.append((r.part, before))
        before += r.n
    start = F.broadcast(per.sparkSession.createDataFrame(starts, "part int, start bigint"))
    return checkpointed(dealt.join(start, "part").select("s", "n", "w", (F.col("start") + F.col("nth")).alias("rank")))


def _with_source(rows: DataFrame, plan: DataFrame, key: str, plan_bytes: int, count: int, source: str = "s", n: str = "n") -> DataFrame:
    """``rows`` with the plan of their source, whose own key is ``key`` and whose number of rows is ``n``.

    If the plan is too large to send to every executor, only that of hot sources is, of which there are at most HOT_SHARE.
    """
    same = F.col(source).eqNullSafe(F.col(key))
    if plan_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(plan), same)
    hot = F.col(n) * HOT_SHARE > count
    few = F.broadcast(plan.filter(hot))
    return rows.join(few, same).unionByName(rows.join(few.select(key), same, "left_anti").join(plan.filter(~hot), same))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options: object) -> DataFrame:
    """The mix itself: the rows of ``docs`` once for each copy taken, then ``mix_epoch``, ``mix_shard`` and ``mix_place``.

    Rows are dealt to partitions by shard and range of place, and ordered by place, which is the shard's local shuffle.
    """
    whole = docs.select(F.col(id_col).alias("i"), F.col(source_col).alias("s"), F.col(text_col).alias("t"), F.struct(*docs.columns).alias("row"))
    placed, shards, total = _placed(whole, "i", "s", "t", **options)  # type: ignore[arg-type]
    rows = placed.select("row", F.explode("mix_places").alias("at")).select("row", F.col("at.epoch").alias("epoch"), F.col("at.shard").alias("shard"), F.col("at.place").alias("place"))
    slices = max(1, -(-total // max(SLICE_WORDS * shards, total * shards // MOST_SLICES)))
    part = F.floor((F.col("place") / 2.0**64 + 0.5) * slices)
    part = (F.col("shard") * slices + F.greatest(F.least(part, F.lit(slices - 1)), F.lit(0))).cast("int")
    dealt = rows.repartitionById(shards * slices, part).sortWithinPartitions("shard", "place")
    return dealt.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("epoch").alias("mix_epoch"), F.col("shard").alias("mix_shard"), F.col("place").alias("mix_place"))


def _edges(in_block: DataFrame, fan: int) -> DataFrame:
    """For each source the first block at whose end the running words exceed ``wanted``: (s, block, before).

    Running sums go through groups of ``fan`` blocks, so that no task sees all blocks of a source.
    """
    per_block = in_block.groupBy("s", "block", "wanted").agg(F.sum("w").alias("w")).withColumn("super", F.floor(F.col("block") / fan))
    supers = per_block.groupBy("s", "super").agg(F.sum("w").alias("super_w"))
    upto = Window.partitionBy("s").orderBy("super")
    supers = supers.withColumn("start", F.sum("super_w").over(upto) - F.col("super_w")).select(F.col("s").alias("s2"), F.col("super").alias("super2"), "start", "super_w")
    within = Window.partitionBy("s", "super").orderBy("block")
    run = per_block.join(supers, per_block.s.eqNullSafe(F.col("s2")) & (F.col("super") == F.col("super2")))
    run = run.filter((F.col("start") <= F.col("wanted")) & (F.col("start") + F.col("super_w") > F.col("wanted")))
    run = run.withColumn("before", F.col("start") + F.sum("w").over(within) - F.col("w"))
    hit = run.filter((F.col("before") <= F.col("wanted")) & (F.col("before") + F.col("w") > F.col("wanted")))
    return hit.groupBy("s").agg(F.min(F.struct("block", "before")).alias("x")).select("s", "x.block", "x.before")


def _picks(in_block: DataFrame, edges: DataFrame) -> DataFrame:
    """(s3, picks, reached): documents from each source's edge on whose words come nearest to those still wanted, and their words.

    The blocks from the edge on hold about EDGE_BLOCKS * BLOCK_DOCS documents of a source, in one task.
    """
    at = edges.select(F.col("s").alias("s2"), F.explode(F.sequence("block", F.col("block") + EDGE_BLOCKS - 1)).alias("block2"), "before")
    rows = in_block.join(F.broadcast(at) if at.count() * 40 <= BROADCAST_BYTES else at, in_block.s.eqNullSafe(at.s2) & (in_block.block == at.block2))
    rows = rows.groupBy("s", "h").agg(F.sum("w").alias("w"), F.first(F.col("wanted") - F.col("before")).alias("goal")).filter("w > 0")

    def nearest(group: pa.Table) -> pa.Table:
        group = group.sort_by("h")
        sizes = dict(zip(group["h"].to_pylist(), group["w"].to_pylist(), strict=True))
        picks = nearest_subset(list(sizes.items()), group["goal"][0].as_py())
        return group.select(["s"]).slice(0, 1).append_column("picks", pa.array([picks], pa.list_(pa.int64()))).append_column("reached", pa.array([sum(sizes[h] for h in picks)], pa.int64()))

    return rows.groupBy("s").applyInArrow(nearest, f"s {in_block.schema['s'].dataType.simpleString()}, picks array<bigint>, reached bigint").withColumnRenamed("s", "s3")


#: Blocks from ``lo`` before ``to`` whose documents of ``most`` words at most are taken.
RANGES = "array<struct<lo:bigint,to:bigint,most:bigint>>"


def _extras(in_block: DataFrame, edges: DataFrame) -> DataFrame:
    """(s3, picks, ranges): what is taken from the edge block of each source on.

    A turn takes the nearest sum of documents of some blocks.  If words are still wanted then, no document left in them fits, and the
    next turn goes through the later blocks' documents of that size at most: those before the new edge are a range.
    A turn leaves fewer words than the smallest document that did not fit; it ends when no later document fits.
    """
    none = F.array().cast(RANGES)
    goal = edges.join(in_block.groupBy(F.col("s").alias("s4")).agg(F.first("wanted").alias("wanted")), F.col("s").eqNullSafe(F.col("s4"))).select("s", "block", (F.col("wanted") - F.col("before")).alias("goal"))
    picks = _picks(in_block, edges)
    joined = goal.join(picks, F.col("s").eqNullSafe(F.col("s3")), "left")
    turn = checkpointed(joined.select("s", F.coalesce("picks", F.array().cast("array<bigint>")).alias("picks"), none.alias("ranges"), (F.col("block") + EDGE_BLOCKS).alias("lo"), (F.col("goal") - F.coalesce("reached", F.lit(0))).cast("bigint").alias("left")))
    found = turn.select("s", "picks", "ranges")
    while True:
        open_ = turn.filter("left > 0").select(F.col("s").alias("s4"), "lo", "left")
        rows = in_block.join(open_, F.col("s").eqNullSafe(F.col("s4")) & (F.col("block") >= F.col("lo")) & (F.col("w") > 0) & (F.col("w") <= F.col("left")))
        rows = checkpointed(rows.select("s", "w", "h", F.col("left").alias("wanted"), "block", "lo"))
        if rows.isEmpty():
            break
        some = rows.groupBy("s").agg(F.first("wanted").alias("most"), F.first("lo").alias("lo"))
        next_ = checkpointed(_edges(rows, SUPER_BLOCKS))
        picks = _picks(rows, next_)
        named = next_.select(F.col("s").alias("e_s"), F.col("block").alias("to"), "before").join(picks, F.col("e_s").eqNullSafe(F.col("s3")), "left")
        joined = some.join(named, F.col("s").eqNullSafe(F.col("e_s")), "left")
        end = F.coalesce("to", F.lit(2**62)).cast("bigint")
        left = F.when(F.col("to").isNull(), 0).otherwise(F.col("most") - F.col("before") - F.coalesce("reached", F.lit(0))).cast("bigint")
        ranges = F.array(F.struct(F.col("lo").cast("bigint").alias("lo"), end.alias("to"), F.col("most").cast("bigint").alias("most"))).cast(RANGES)
        turn = checkpointed(joined.select("s", F.coalesce("picks", F.array().cast("array<bigint>")).alias("picks"), ranges.alias("ranges"), (end + EDGE_BLOCKS).alias("lo"), left.alias("left")))
        more = turn.select(F.col("s").alias("m_s"), F.col("picks").alias("m_picks"), F.col("ranges").alias("m_ranges"))
        both = found.join(more, F.col("s").eqNullSafe(F.col("m_s")), "left")
        found = checkpointed(both.select("s", F.concat("picks", F.coalesce("m_picks", F.array().cast("array<bigint>"))).alias("picks"), F.concat("ranges", F.coalesce("m_ranges", none)).alias("ranges")))
    return found.select(F.col("s").alias("s3"), "picks", "ranges")


def nearest_subset(items: list[tuple[int, int]], target: int) -> list[int]:
    """Keys of the items whose sizes sum nearest to ``target``, early items first among equals.

    Sums reached are bits of one integer; targets beyond 2**22 are taken in coarser units.
    """
    unit = max(1, target >> 22)
    goal, reached = target // unit, [1]
    items = [x for x in items if x[1] <= 2 * target]  # what is beyond twice the target is farther from it than nothing
    mask = (1 << 2 * goal + 1) - 1
    for _, w in items:
        reached.append((reached[-1] | reached[-1] << w // unit) & mask)
    below = (reached[-1] & ((1 << goal + 1) - 1)).bit_length() - 1
    above = reached[-1] >> goal + 1
    over = (above & -above).bit_length() + goal if above else None
    at = over if over is not None and over - goal < goal - below else below
    out = []
    for i in range(len(items), 0, -1):
        if not reached[i - 1] >> at & 1:
            out.append(items[i - 1][0])
            at -= items[i - 1][1] // unit
    return out[::-1]


def _permutation(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """(step, shift) of d -> (d * step + shift) mod n, a permutation of 0..n-1; step stays under 2**20."""
    if n <= 1:
        return 1, 0
    step = int(rng.integers(1, min(n, 1 << 20)))
    while math.gcd(step, n) != 1:
        step = step % min(n, 1 << 20) + 1
    return step, int(rng.integers(0, n))
