"""Rows that must not be lost: ids that are null, long labelled texts, records beside damaged ones."""

import gzip

import numpy as np
from pyspark.sql import functions as F

from lodestat.llm import langid, minhash, warc


def test_rows_without_an_id_keep_their_links(spark):
    words = [f"v{i}" for i in range(60)]
    texts = [(None, " ".join(words)), (5, " ".join([*words, "x"])), (7, " ".join([*words, "y"])), (None, "another text of its own " * 3), (9, " ".join(words[::-1]))]
    for kind in ("bigint", "string"):
        rows = [(None if i is None else i if kind == "bigint" else f"{i:0>300}", t) for i, t in texts]
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
        got = {t: (i, r.component_id, r.kept) for (i, t), r in zip(rows, sorted(minhash.near_duplicates(docs, size=4).collect(), key=lambda r: [x for x, _ in texts].index(r.doc_id if r.doc_id is None or kind == "bigint" else int(r.doc_id))), strict=False)}
        found = minhash.near_duplicates(docs, size=4).collect()
        ids = {r.doc_id: (r.component_id, r.kept) for r in found if r.doc_id is not None}
        assert len(found) == 5 and len(got) == 5
        assert {ids[rows[1][0]][0], ids[rows[2][0]][0]} == {rows[1][0]}
        none = sorted((str(r.component_id), r.kept) for r in found if r.doc_id is None)
        assert none == sorted([(str(rows[1][0]), False), ("None", True)])


def test_long_labelled_texts_are_learnt_like_short_ones(spark):
    rng = np.random.default_rng(4)
    long = [(i, " ".join(rng.choice(["the", "house", "stands", "here", f"n{i}"], 2000)), "en") for i in range(50)]
    short = [(100 + i, f"la maison est ici {i}", "fr") for i in range(50)]
    huge = [(300, "".join(chr(97 + i % 26) for i in range(300_000)), "xx")]
    docs = spark.createDataFrame([*long, *short, *huge], "doc_id bigint, text string, lang string")
    got = langid.train(docs, F.lit(True))
    assert len(got["en"]) == len(got["fr"]) == langid.TRAIN_ROWS
    assert set(got["en"]) <= {t.encode() for _, t, _ in long}
    (piece,) = got["xx"]
    parts = piece.decode().split("\n")
    assert [len(p) for p in parts] == [langid.TRAIN_PIECE_CHARS] * langid.TRAIN_PIECES and huge[0][1].startswith(parts[0]) and huge[0][1].endswith(parts[-1])


def test_records_beside_damaged_ones_are_read(spark, tmp_path):
    good = [warc.response(i, f"http://x/{i}", f"<p>page {i}</p>") for i in range(3)]
    more = good[0].replace(b"Content-Length: ", b"Content-Length: 9", 1)  # beyond the end of all
    some = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n\r\n" % (len(good[1]) // 2)  # into the next record
    df = spark.createDataFrame([("a", more + good[1] + good[2]), ("b", some + good[1] + good[2]), ("c", good[0] + good[1])], "id string, record binary")
    uris = sorted((r.id, r.target_uri) for r in warc.derivatives(df).filter("kind = 'conversion'").collect())
    assert uris == [("a", "http://x/1"), ("a", "http://x/2"), ("b", "http://x/1"), ("b", "http://x/2"), ("c", "http://x/0"), ("c", "http://x/1")]
    assert {(r.id, r.fault) for r in warc.malformed(df).collect()} == {("a", "truncated block"), ("b", "block beyond its record")}
    whole = b"".join(gzip.compress(r) for r in good)
    (tmp_path / "cut.warc.gz").write_bytes(whole[:-30])
    (tmp_path / "whole.warc.gz").write_bytes(whole)
    (tmp_path / "damaged.warc.gz").write_bytes(gzip.compress(good[0]) + b"\x1f\x8b\x08\x00" + b"\xff" * 50)
    by_file = {name: n for name, n in warc.derivatives(warc.read_records(spark, str(tmp_path))).groupBy(F.regexp_extract("id", r"(\w+)\.warc", 1)).count().collect()}
    assert by_file["whole"] == 6 and by_file["cut"] in (4, 6) and by_file["damaged"] == 2


def test_charsets_that_cannot_be_read():
    for name in ("idna", "undefined", "base64", "no-such", "utf-16", "x" * 200):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={name}\r\n\r\n<p>text</p>".encode()
        assert {r["kind"] for r in warc.derive({"warc-record-id": "<urn:x>"}, block)} == {"metadata", "conversion"}
