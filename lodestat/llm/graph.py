"""Links within posting lists, and connected components, without all pairs of a list and without the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_or_shuffled


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each moves edges towards the least neighbour, until
    every component is a star.  A node with very many edges costs partial minima and a join that can be split.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = checkpointed(small)
        # Stars: no centre is a leaf, and no leaf has two centres.
        ends = edges.select("u", F.lit(1).alias("n")).unionAll(edges.select("v", F.lit(0)).distinct())
        if ends.groupBy("u").agg(F.count("*").alias("c"), F.sum("n").alias("n")).filter("n > 0 AND c > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct())


#: Members that a list may have left outside its first centre's component before they are all tested against the list.
LEFT = 32
#: Fresh centres of a crowded list in one turn, and turns at most; a list goes on only while a turn halves what is left.
CENTRES, TURNS = 16, 3
#: Rows of a list in one task of the last join; longer lists are dealt over several by salt.
LIST_ROWS = 4096


def link_lists(
    posts: DataFrame,
    test: Callable[[DataFrame, DataFrame], DataFrame],
    fetch: Callable[[DataFrame], DataFrame],
    near: Callable[[str, str], Column] | None = None,
    cheap: Sequence[str] = (),
) -> DataFrame:
    """(node, component) such that all members of posting lists that ``test`` links are in one component.

    ``posts`` has (key, id, own): a list joins its ``own`` members with all its members; an own member's rows
    are members too, and rows may repeat.  First every member is tested against one centre of its list, chosen
    by hash.  What is then in one component needs no further test.  A list with more than LEFT members outside
    the centre's component takes CENTRES of them as fresh centres, for TURNS turns at most; then the members still outside, but
    for those that were centres, are tested against all others of their list.  Each step tests a fixed multiple of the rows
    of a list at most, but for the last one in lists whose members are linked with scarcely any others; that one
    is dealt over as many tasks as the list is long.  No link between components is missed.

    ``fetch`` gives (id, ...) rows for the distinct ids of lists with two members or more; ``test`` maps pairs (a, b) and those
    rows to the linked pairs; ``near(suffix_a, suffix_b)`` is a necessary condition on the ``cheap`` columns,
    checked inside the join.
    """
    centres = posts.filter("own").groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("c"), (F.min("id") < F.max("id")).alias("many"))
    centres = centres.select("key", F.col("c.id").alias("centre"), "many")
    matched = checkpointed(posts.join(centres, "key").filter("many OR id <> centre"))
    known = fetch(matched.select("id").unionAll(matched.select("centre")).distinct())
    star = matched.filter("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    comps = checkpointed(components(test(star, known)))

    lists = matched.filter("many AND id <> centre").groupBy("key", "id").agg(F.max("own").alias("own"), F.first("centre").alias("centre"))
    lists = lists.withColumns({"settled": F.lit(False), "before": F.lit(2**31 - 1)})
    if cheap:
        lists = lists.join(known.select("id", *cheap), "id")
    lists = checkpointed(_unfinished(_labelled(lists, comps)))
    for turn in range(TURNS):
        crowded = lists.groupBy("key").agg(F.sum(F.col("todo").cast("int")).cast("int").alias("left"), F.first("before").alias("was"))
        crowded = checkpointed(crowded.filter((F.col("left") > LEFT) & (2 * F.col("left").cast("bigint") <= F.col("was"))).select("key", "left"))
        if crowded.isEmpty():
            break
        here = lists.join(crowded, "key").drop("before").withColumnRenamed("left", "before")
        seat = F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(CENTRES)).alias("seat")
        fresh = here.filter("todo").groupBy("key", seat).agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "comp", *cheap)).alias("c"))
        fresh = checkpointed(fresh.select(F.col("key").alias("key_b"), *[F.col(f"c.{c}").alias(f"{c}_b") for c in ("id", "comp", *cheap)]))
        comps = joined(comps, test(_meet(here.filter("NOT settled"), fresh, near, ()), known))
        done = fresh.select(F.col("key_b").alias("key"), F.col("id_b").alias("id"), F.lit(True).alias("was"))
        here = here.join(done, ["key", "id"], "left").withColumn("settled", F.col("settled") | F.col("was").isNotNull()).drop("was")
        lists = lists.join(crowded, "key", "left_anti").unionByName(here)
        lists = checkpointed(_unfinished(_labelled(lists.drop("comp", "todo"), comps)))
    if lists.isEmpty():
        return comps

    hot = lists.groupBy("key").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("salts")).filter("salts > 1")
    lists = lists.filter("NOT settled").join(small_or_shuffled(checkpointed(hot), 12), "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    dealt = lists.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    copied = lists.filter("todo").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    copied = copied.select(*[F.col(c).alias(f"{c}_b") for c in ("key", "salt", "id", "own", "comp", *cheap)])
    last = _meet(dealt, copied, near, ("salt",), (F.col("own") | F.col("own_b")) & (~F.col("todo") | (F.col("id") < F.col("id_b"))))
    return joined(comps, test(last, known))


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components of those known and of new links (a, b) between their nodes or others.

    Links are first drawn between components, so that what is to be done follows the new links alone.
    """
    drawn = checkpointed(_ends(links, comps).filter("comp_a <> comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct())
    if drawn.isEmpty():
        return comps
    moved = checkpointed(components(drawn))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = comps.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return checkpointed(known.unionAll(moved.join(comps, "node", "left_anti").select("node", "component")))


def _labelled(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """``lists`` with the component of each member, and whether it is ``todo``: not the first centre's, and no centre itself so far."""
    label = comps.select(F.col("node").alias("id"), F.col("component").alias("comp"))
    of_centre = comps.select(F.col("node").alias("centre"), F.col("component").alias("centre_comp"))
    lists = lists.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    lists = lists.join(of_centre, "centre", "left").withColumn("centre_comp", F.coalesce("centre_comp", "centre"))
    return lists.withColumn("todo", (F.col("comp") != F.col("centre_comp")) & ~F.col("settled")).drop("centre_comp")


def _unfinished(lists: DataFrame) -> DataFrame:
    """Rows of the lists that have an own member and one still to be tested."""
    some = lists.groupBy("key").agg(F.max("todo").alias("any"), F.max("own").alias("some")).filter("any AND some").select("key")
    return lists.join(some, "key", "left_semi")


def _meet(members: DataFrame, others: DataFrame, near: Callable[[str, str], Column] | None, by: Sequence[str], also: Column | None = None) -> DataFrame:
    """Distinct pairs (a, b) of members and others of one list that are in different components."""
    on = F.col("comp") != F.col("comp_b")
    for k in ("key", *by):
        on = on & (F.col(k) == F.col(f"{k}_b"))
    if near is not None:
        on = on & near("", "_b")
    pairs = members.join(others, on if also is None else on & also)
    return pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()


def _ends(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (a, b) with the components of both ends; a node outside ``comps`` is its own."""
    for x in "ab":
        named = comps.select(F.col("node").alias(x), F.col("component").alias(f"comp_{x}"))
        pairs = pairs.join(named, x, "left").withColumn(f"comp_{x}", F.coalesce(f"comp_{x}", x))
    return pairs
