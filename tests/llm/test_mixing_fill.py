"""Quotas are filled from any block, and shards take disjoint draws."""

import collections

import pytest

from lodestat.llm import mixing


def taken(placed):
    return {r.source: r.n for r in placed.selectExpr("source", "mix_size * size(mix_places) AS n").groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_words_beyond_the_edge_are_found(spark, seed):
    rows = [(i, "a", "w " * 30) for i in range(300)] + [(1000 + i, "a", "w " * 20_000) for i in range(2)] + [(2000 + i, "b", "w " * 100) for i in range(285)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)
    placed = mixing.placements(docs, weights=(2, 3), seed=seed).cache()
    goal = placed.filter("source = 'a'").first().mix_target
    assert goal == pytest.approx(31_000, abs=1)
    assert taken(placed)["a"] == 29_000  # all short texts and one long: the nearest sum that there is
    assert max(r.mix_copies for r in placed.collect()) <= 3


def test_many_turns_and_disjoint_draws(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EDGE_BLOCKS", 1)
    rows = [(i, "ab"[i % 2], "w " * (1 + (i * i * 7919) % 997)) for i in range(1500)] + [(5000, None, "w " * 5000), (5001, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(4)
    placed = mixing.placements(docs, block_docs=2, shards=7).cache()
    got = taken(placed)
    for s, target in placed.select("source", "mix_target").distinct().collect():
        assert abs(got[s] - target) <= max(1, target / 100)  # windows of two texts: the nearest sum may be above
    places = [(r.doc_id, p.epoch, p.shard, p.place) for r in placed.collect() for p in r.mix_places]
    assert len({(d, e) for d, e, _, _ in places}) == len(places) and {p[2] for p in places} <= set(range(7))
    again = mixing.placements(docs.repartition(2), block_docs=2, shards=7)
    assert collections.Counter(places) == collections.Counter((r.doc_id, p.epoch, p.shard, p.place) for r in again.collect() for p in r.mix_places)
