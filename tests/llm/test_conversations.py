"""Conversation repair against SQL, exhaustive search and the edge cases."""

import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestat.llm import conversations, queries

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def made(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            role, text = rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None]), rng.choice(["a b.", "a b", "", " \n", "what?", "no! ", None, "é.", "\xa0", "x" * 50 + "."])
            rows.append((c if c else None, rng.choice([t, t, t, t + 1, None, t * 2]), role, text, 1, "z"))
    return rows


def same(got, want):
    assert sorted(map(str, got[COLUMNS].itertuples(index=False, name=None))) == sorted(map(str, want[COLUMNS].itertuples(index=False, name=None)))


def test_crc32_of_sql():
    from lodestat.llm.sql import crc32

    for text in ("1:2", "-40: ", "123456789:0"):
        assert duckdb.connect().execute(f"SELECT {crc32(chr(39) + text + chr(39))}").fetchone()[0] == zlib.crc32(text.encode())


@pytest.mark.parametrize("layers", [64, 3])
def test_repair_equals_sql_on_odd_rows(spark, tmp_path, monkeypatch, layers):
    monkeypatch.setattr(conversations, "LAYERS", layers)
    rows = made(random.Random(5), 250) + [(7, 1, "user", "again.", 1, "z")] * 9
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, id int, times string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversations(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got.conv_id = got.conv_id.astype("Int64")
    want = con.execute(queries.oracle_sql()["op11_conversations"]).df()
    want.conv_id = want.conv_id.astype("Int64")
    assert len(got) == 250
    same(got, want)


def test_search_equals_exhaustion():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.choice("bdt--"), 1) for _ in range(rng.randint(0, 4))]
        best = None
        # All ways to edit each row, with up to two inserted turns in each place.
        for edits in itertools.product("KRrD", repeat=len(rows)):
            if any(f in "bd" and e != "D" for (_, f, _), e in zip(rows, edits, strict=True)):
                continue
            base = sum({"K": 0, "R": 3, "r": 3, "D": 4}[e] + 3 * (f == "t" and e != "D") for (_, f, _), e in zip(rows, edits, strict=True))
            for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
                roles = audit = ""
                for i, g in enumerate(gaps):
                    roles, audit = roles + g, audit + "I" * len(g)
                    if i < len(rows):
                        roles += {"K": rows[i][0], "R": "u", "r": "a", "D": ""}[edits[i]]
                        audit += edits[i].upper()
                if GRAMMAR.match(roles):
                    key = base + 3 * sum(map(len, gaps)), audit
                    best = key if best is None else min(best, key)
        assert conversations.cheapest([conversations.row_layer(r) for r in rows]) == best


def test_long_conversation_over_many_ranges(spark):
    rng = random.Random(11)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "again."])) for t in range(3000)] + [(2, 0, "user", "hi."), (2, 1, "assistant", "yes.")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r for r in conversations.repair(df).collect()}
    layers, seen = [], set()
    for _, _, role, text in rows[:3000]:
        layers.append(conversations.row_layer((role[0], "d" if (role, text) in seen else "-" if text.endswith(".") else "t", 1)))
        seen.add((role, text))
    state = {0: (0, "")}  # least keys layer by layer, without a search
    for layer in [None, *layers]:
        new = {} if layer else dict(state)
        for s, (cost, audit) in state.items() if layer else ():
            for t, c, x in layer[s]:
                new[t] = min(new.get(t, (1 << 60, "")), (cost + c, audit + x))
        for s, t in [(0, 2), (1, 2), (3, 2), (2, 3), (3, 2)]:
            if s in new:
                new[t] = min(new.get(t, (1 << 60, "")), (new[s][0] + 3, new[s][1] + "I"))
        state = new
    assert (got[1].cost, got[1].audit) == min(state[s] for s in (0, 3) if s in state)
    assert got[2].cost == 0 and got[2].audit == "KK"


def test_turns_follow_the_grammar_and_empty_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    broken = conversations.damaged(df)
    turns = conversations.repaired_turns(broken, times=F.col("times")).toPandas()
    for _, t in turns.sort_values("place").groupby("conv_id"):
        assert GRAMMAR.match("".join(r[0] for r in t.role)) and list(t.place) == list(range(len(t)))
    assert conversations.repair(df.filter("1 = 0")).count() == 0
    assert conversations.repaired_turns(df.filter("1 = 0")).count() == 0
    got = conversations.repair(df.limit(0).unionByName(spark.createDataFrame([(1, 1, "user", "a.")], df.schema)), times=F.lit(0)).collect()
    assert [tuple(r)[1:8] for r in got] == [(0, 0, 0, 0, 0, 0, "")]
    assert pd.notna(got[0].repaired_sha256)
