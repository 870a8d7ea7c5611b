"""Operators of lodestat.llm against brute force, and their edge cases."""

import collections
import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lodestat.llm import fingerprints, flatgraph, graph, kernels, langid, linear, lines, minhash, mixing, piece_bpe, queries, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
#: Null and empty texts, white space only, one word, ties, repeated rows, a very long text, a null id, odd characters.
EDGE = [(1, None, "a", "en"), (2, "", None, None), (3, " \t\n", "a", "en"), (4, "one", "b", None), (5, "The cat sat on the mat and then it ran far away home.", "b", "en"),
        (5, "The cat sat on the mat and then it ran far away home.", "b", "en"), (6, "the cat sat on the mat and then it ran far away home.", "a", "fr"), (7, LONG, "a", "en"), (8, LONG + " end", "c", "en"),
        (None, "no id here at all, none", "a", "en"), (9, "\x00 ▁ 🙂 ñandú\n\n中文字符\r\nx", "é", "es"), (10, "1234 5678 !!", "a", "en")]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, s, l, None if t is None else len(t), "extra", 1, "x") for i, t, s, l in EDGE]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint, node string, id int, score string").repartition(3)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.filter("1 = 0")


def shingle_set(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def closure(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(rng, groups=6, members=5, words=60):
    out, vocabulary = [], [f"v{i}" for i in range(3000)]
    for _ in range(groups):
        base = [vocabulary[i] for i in rng.integers(0, len(vocabulary), words)]
        for m in range(members):
            w = list(base)
            for _ in range(m):
                w[rng.integers(0, words)] = vocabulary[rng.integers(0, len(vocabulary))]
            out.append(" ".join(w))
    return out


# Kernels


def test_words_and_hashes_agree_wherever_they_stand():
    texts = ["ab cd  ab", "", "cd\tab\x0b", " ", "é ab"]
    data, offsets = kernels.text_buffers(pa.array([*texts, None]))
    starts, ends, bounds = kernels.words(data, offsets)
    h = kernels.span_hash(kernels.prefix_hash(data), starts, ends)
    found = [WORD.findall(t) for t in [*texts, ""]]
    assert [len(f) for f in found] == list(np.diff(bounds))
    by = collections.defaultdict(set)
    for w, x in zip([w for f in found for w in f], h, strict=True):
        by[w].add(int(x))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = closure({x for e in edges for x in e}, edges)
    assert got == want
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 1


def brute_vectors(rows, bound=0.95):
    unit = {}
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v], dtype=float) if v else np.zeros(0)
        if len(x) and np.isfinite(x).all() and x.any():
            unit[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= bound]
    return links, closure([i for i, _ in rows], links)


def test_flat_graph_finds_all_links(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    for g in range(8):
        base = np.array(rows[g][1])
        rows += [(1000 + 40 * g + k, [float(x) for x in base + rng.normal(size=16) * 0.1]) for k in range(30)]
    rows += [(5000, rows[0][1]), (5001, rows[0][1]), (5002, None), (5003, [0.0] * 16), (5004, [float("nan")] * 16), (5005, [1.0, None] * 8), (5006, []), (5007, [float("inf")] * 16)]
    links, comp = brute_vectors(rows)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, node string")
    f32 = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    links, comp = brute_vectors(f32)
    got = {r.vec_id: r for r in flatgraph.near_vectors(df).collect()}
    count = collections.Counter(x for l in links for x in l)
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    assert found >= 0.99 * 2 * len(links) and all(got[i].n_links <= count[i] for i in got)
    assert sum(got[i].component_id == comp[i] for i in got) >= 0.99 * len(got)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(5002, 5008))
    assert all(r.audit_recall is None or r.audit_recall >= 0.9 for r in got.values())


def test_flat_graph_blocks_of_an_oversized_shard(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    nodes = list(range(90))
    units = [(v := base + rng.normal(size=8) * 0.05) / np.linalg.norm(v) for _ in nodes]
    lists = [[] for _ in nodes]
    blocks = [i % 3 for i in nodes]
    for b in range(3):
        at = [i for i in nodes if blocks[i] == b]
        for i, near in zip(at, flatgraph.robust_graph(np.array([units[i] for i in at], dtype=np.float32)), strict=True):
            lists[i] = [at[j] for j in near]
    total = np.zeros(90)
    for i in range(3):
        for j in range(i, 3):
            at = [x for x in nodes if blocks[x] in (i, j)]
            count, _ = flatgraph.shard_links(4, i != j, at, [units[x].tobytes() for x in at], [1] * len(at), [[4]] * len(at), [lists[x] for x in at], [blocks[x] for x in at], 0.95)
            for k, c in count.items():
                total[k] += c
    u = np.array(units)
    assert np.array_equal(total, (u @ u.T >= 0.95).sum(axis=1) - 1)


def test_flat_graph_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert flatgraph.near_vectors(df).count() == 0


# 2


def test_language_by_cross_parsing(spark):
    rng = np.random.default_rng(3)
    stock = {"xx": ["lorem", "ipsum", "dolor", "amet"], "yy": ["vier", "acht", "zwolf", "nacht"]}
    rows = [(i, " ".join(rng.choice(stock[l], 30)), l) for i, l in enumerate(["xx", "yy"] * 60)]
    rows += [(900, None, "xx"), (901, "123 456", "yy"), (902, "", None), (903, "lorem " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == l for i, _, l in rows[:120]) and got[903].lang_pred == "xx"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    none = langid.train(docs.filter("lang = 'zz'"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.filter("doc_id < 0"), model).count() == 0


def phrase_count(source, query):
    at = n = 0
    while at < len(query):
        k = 1
        while at + k < len(query) and query[at : at + k + 1] in source and query[at : at + k] in source:
            k += 1
        at, n = at + k, n + 1
    return n


def test_cross_parse_counts_longest_phrases_of_whole_texts():
    rng = np.random.default_rng(24)
    words = [b"abracadabra", b"banana", b"cadabraq", b"zz", b"nab"]
    train = b" ".join(words[i] for i in rng.integers(0, 5, 200))
    model = langid.build({"l": [train], "m": [train[::-1]]})
    queries_ = [b"abrabanananazz cadabraq", b"", b"x", train, b"banana" * 300, b" ".join(words[i] for i in rng.integers(0, 5, 400)), bytes(rng.choice(list(b"abcn rdqz"), 3000).astype(np.uint8)).replace(b"  ", b" "), b"q" * 256, b"ab" * 128 + b"r"]
    queries_ = [re.sub(b" +", b" ", q) for q in queries_]
    offsets = np.cumsum([0, *map(len, queries_)])
    counts, sizes = model.phrases(np.frombuffer(b"".join(queries_), dtype=np.uint8), offsets)
    for column, source in enumerate((train, train[::-1])):
        assert [round(c) for c in counts[:, column] / model.bits[column]] == [phrase_count(source, q) for q in queries_]
    assert list(sizes) == list(map(len, queries_))


def test_languages_in_groups_and_whole_rows(spark, monkeypatch):
    rng = np.random.default_rng(25)
    stock = {f"l{k}": [f"{a}{k}{b}" for a, b in zip(rng.choice(list("abcdefgh"), 6), rng.choice(list("mnopqrst"), 6), strict=True)] for k in "uvwxyz"}
    rows = [(i, " ".join(rng.choice(stock[l], 40)), l) for i, l in enumerate(sorted(stock) * 20)]
    rows += [(2000 + i, rows[0][1], "lu") for i in range(300)] + [(None, "ein sehr langer text " * 500, "long"), (1, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    samples = langid.train(docs, F.lit(True), rows=8)
    assert set(samples) == {*stock, "long"} and all(len(t) <= 8 for t in samples.values()) and samples["long"] == [("ein sehr langer text " * 500).encode()]
    whole = {t for _, t, _ in rows}
    assert all(x.decode() in whole for t in samples.values() for x in t) and len(set(samples["lu"])) == len(samples["lu"])
    assert samples == langid.train(docs.repartition(2), F.lit(True), rows=8)
    at_once = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, samples).collect()}
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", 2)
    assert {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, samples).collect()} == at_once
    assert all(p == l for i, p, _ in at_once for j, _, l in rows[:120] if i == j and i != 1)


# 3


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def mutated(rng, s, k):
    s = bytearray(s)
    for _ in range(k):
        kind, i = rng.integers(0, 3), int(rng.integers(0, len(s) + 1))
        if kind == 0 or not s:
            s.insert(i, int(rng.choice(list(b"abcdefgh"))))
        elif kind == 1:
            del s[min(i, len(s) - 1)]
        else:
            s[min(i, len(s) - 1)] = int(rng.choice(list(b"abcdefgh")))
    return bytes(s)


def test_banded_distance():
    rng = np.random.default_rng(5)
    a = [bytes(rng.choice(list(b"abc"), rng.integers(0, 40)).astype(np.uint8)) for _ in range(800)]
    b = [mutated(rng, x, int(rng.integers(0, 5))) for x in a]
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if abs(len(x) - len(y)) <= 2]
    got = lines.banded_distance(*map(list, zip(*pairs, strict=True)), 2)
    assert list(got) == [min(3, distance(x, y)) for x, y in pairs]


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    pool = [bytes(rng.choice(list(b"abcdefgh "), rng.integers(10, 90)).astype(np.uint8)).strip() or b"q" for _ in range(60)]
    rows = []
    for d in range(40):
        picked = [mutated(rng, pool[int(rng.integers(0, 60))], int(rng.integers(0, 3))).decode().strip() for _ in range(6)]
        rows.append((d, "\n".join(picked)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.line_no): r for r in lines.line_decisions(docs).collect()}
    at = [(d, n, x.strip(" \t\r\x0b\x0c").encode()) for d, t in rows for n, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
    kinds = sorted({x for _, _, x in at})
    links = []
    for i, x in enumerate(kinds):
        for j in range(i):
            y = kinds[j]
            t = int(lines.tolerance(np.array([min(len(x), len(y))]))[0])
            if t and abs(len(x) - len(y)) <= t and distance(x, y) <= t:
                links.append((j, i))
    comp = closure(range(len(kinds)), links)
    where = {x: comp[i] for i, x in enumerate(kinds)}
    first = {}
    for d, n, x in sorted(at, key=lambda r: r[:2]):
        first.setdefault(where[x], (d, n))
    assert len(got) == len(at) and links
    for d, n, x in at:
        assert got[d, n].kept == (first[where[x]] == (d, n))
        assert got[d, n].n_copies == sum(where[y] == where[x] for _, _, y in at)


def test_line_dedup_edges(spark, edge, empty):
    out = lines.dedup_lines(edge)
    assert out.columns == edge.columns
    kept = out.collect()
    assert sum(r.doc_id == 5 for r in kept) == 2 and any(r.doc_id is None for r in kept)
    assert {r.doc_id for r in kept} >= {1, 2, 3, 4, 7, 8, 9}
    assert all(r.text is None or r.n_chars == len(r.text) for r in kept)
    assert lines.dedup_lines(empty).count() == 0
    docs = spark.createDataFrame([(1, "a line that is long enough\n\nshort\nsecond line of this text"), (2, "short\na line that is long enough\nnew here, not seen before"), (3, "second line of this text")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == {1: docs.first().text, 2: "new here, not seen before"}


def test_short_lines_are_deduplicated_exactly(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "Les.\nAnd ornd.\nLes.\n\nx", 0), (2, "x\nless.\n Les. \n\nLes", 0), (3, "Les.\nx", 0), (4, "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = [(d, n, x.strip(" ")) for d, t, _ in rows for n, x in enumerate(t.split("\n")) if x.strip(" ")]
    first = {}
    for d, n, x in at:
        first.setdefault(x, (d, n))
    got = {(r.doc_id, r.line_no): (r.kept, r.n_copies) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(d, n): (first[x] == (d, n), sum(y == x for _, _, y in at)) for d, n, x in at}
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()}
    assert left == {1: "Les.\nAnd ornd.\n\nx", 2: "less.\n\nLes", 4: "y"}


# 4


def test_pieces_equal_the_library(spark, edge, empty):
    path = piece_bpe.default_model()
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.codec(path)
    rng = np.random.default_rng(7)
    letters = list("  abcdetr\n\t▁éÉ中🙂\x01Ω<s>")
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(2000)] + [t for _, t, *_ in EDGE if t] + ["", " ", "a" * 3000, "<s></s><unk><0x41>"]
    for t in texts:
        ids = lib.encode(t)
        n, joined, back = codec.digest(t)
        assert codec.encode(t) == ids and joined == ",".join(map(str, ids)) and n == len(ids)
        assert codec.decode(ids) == lib.decode(ids) == back
    wild = [int(x) for x in rng.integers(3, 32000, 300)] + [codec.byte_ids[b] for b in b"\xff\xe4\xb8a"]
    assert codec.decode(wild) == lib.decode(wild)
    got = piece_bpe.encode_documents(edge, with_ids=True, with_text=True)
    assert got.count() == len(EDGE) and piece_bpe.encode_documents(empty).count() == 0
    for r in got.collect():
        text = next(t or "" for i, t, *_ in EDGE if i == r.doc_id)
        assert r.ids == lib.encode(text) and r.n_tokens == len(r.ids) and r.decoded == lib.decode(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(r.ids).encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in piece_bpe.decode_documents(got).collect()}
    assert back == {r.doc_id: r.decoded for r in got.collect()}


# 5 and 10


def test_classifiers_learn_and_score_edges(spark, sf_dir, edge, empty):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    for label, fit in (("quality", linear.fit_quality), ("toxic", linear.fit_toxicity)):
        sample = linear.labelled_sample(docs, labels, label, F.lit(True), 200)
        model = linear.fitted(sample, fit)
        rows = sorted(sample.select("i", "t", "y").collect())
        alike = fit([r.t for r in rows], np.array([float(r.y) for r in rows]))
        assert np.array_equal(alike.weights, model.weights) and alike.bias == model.bias
        data, offsets = kernels.text_buffers(pa.array([r.t for r in rows]))
        s = model.scores(data, offsets)
        assert ((s >= 0.5) == np.array([r.y == 1 for r in rows])).mean() > 0.9
        scores = {(r.doc_id, round(r.score, 12)) for r in linear.score(edge, model).collect()}
        assert len(scores) == len({i for i, *_ in EDGE}) and all(0 <= x <= 1 for _, x in scores)
        assert linear.score(empty, model).count() == 0
        assert linear.keep_below(edge, model, 2.0).count() == len(EDGE)


def test_nothing_is_learnt_without_both_classes(spark, edge, empty):
    import corpus_pipeline

    for rows in ([], [(4, 1), (5, 1)], [(4, 0), (None, 1)], [(77, 0), (78, 1)]):
        labels = spark.createDataFrame([(i, y, y) for i, y in rows], "doc_id bigint, quality int, toxic int")
        for label, fit in (("quality", linear.fit_quality), ("toxic", linear.fit_toxicity)):
            model = linear.fitted(linear.labelled_sample(edge, labels, label, F.lit(True), 10), fit)
            assert {r.score for r in linear.score(edge, model).collect()} == {0.0}
            assert linear.keep_below(edge, model, 0.5).count() == len(EDGE)


def test_sample_has_one_text_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n"), (2, None), (2, "c"), (3, "z"), (3, "z")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, 1), (3, 7), (None, 1), (9, 1)], "doc_id bigint, toxic int")
    got = sorted((r.i, r.y, r.t) for r in linear.labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect())
    assert got == [(1, 1, "a"), (2, 0, ""), (3, 1, "z")]


def test_ftrl_and_log_count_ratios_equal_plain_python():
    rng = np.random.default_rng(26)
    rows = [(np.unique(rng.integers(0, 30, 8)).astype(np.int32), None) for _ in range(40)]
    rows = [(i, rng.random(len(i))) for i, _ in rows]
    y = rng.integers(0, 2, 40).astype(float)
    ratio = linear.log_count_ratios(rows, y, 30)
    for f in range(30):
        p = 1 + sum(f in set(i) for (i, _), k in zip(rows, y, strict=True) if k)
        q = 1 + sum(f in set(i) for (i, _), k in zip(rows, y, strict=True) if not k)
        assert ratio[f] == pytest.approx(np.log((p / (1 + y.sum())) / (q / (1 + (1 - y).sum()))))
    alpha, l1, l2, beta = 0.3, 0.02, 0.5, 1.0
    got, bias = linear.ftrl(rows, y, 30, alpha, l1, l2, 3)
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    balance = {k: len(y) / (2 * (y == k).sum()) for k in (0, 1)}

    def weight(f):
        sharp = 0.0 if f == "bias" else l1
        return 0.0 if abs(z[f]) <= sharp else -(z[f] - np.sign(z[f]) * sharp) / ((beta + n[f] ** 0.5) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(3):
        for r in order.permutation(40):
            x = dict(zip(rows[r][0].tolist(), rows[r][1], strict=True)) | {"bias": 1.0}
            w = {f: weight(f) for f in x}
            p = 1 / (1 + np.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - y[r]) * balance[int(y[r])] * v
                sigma = ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha
                z[f] += g - sigma * w[f]
                n[f] += g * g
    assert np.allclose(got, [weight(f) for f in range(30)]) and bias == pytest.approx(weight("bias"))


def test_margins_do_not_depend_on_batches():
    rng = np.random.default_rng(8)
    for f in (linear.WordNgrams(bits=10), linear.CharNgrams(bits=12)):
        model = linear.LinearModel(f, rng.normal(size=1 << f.bits).astype(np.float32), 0.1, 2.0)
        texts = ["", "A", "AB CD cd!!", "x" * 5, "the the the", None, LONG[:5000], "é中"]
        together = model.margins(*kernels.text_buffers(pa.array(texts)))
        alone = [model.margins(*kernels.text_buffers(pa.array([t], pa.string())))[0] for t in texts]
        assert np.allclose(together, alone)


def test_bag_of_ngrams_by_hand():
    f = linear.CharNgrams(bits=20, sizes=(4,))
    data, offsets = kernels.text_buffers(pa.array(["ABCD abcd"]))
    index, bounds, _ = next(f.features(data, offsets))
    assert len(index) == bounds[1] == 6 and index[0] == index[5]


# 6


def test_fingerprints(spark, edge, empty):
    got = fingerprints.fingerprints(edge).collect()
    assert len(got) == len(EDGE) and fingerprints.fingerprints(empty).count() == 0
    order = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0))
    for r in got:
        at = [k for k, e in enumerate(order) if e[0] == r.doc_id]
        shas = set()
        for k in at:
            text, nxt = order[k][1] or "", order[(k + 1) % len(order)][1] or ""
            cut = len(text) // 4
            shas.add(hashlib.sha256((text[: len(text) - cut] + nxt[:cut]).encode()).hexdigest())
            assert r.n_chars == len(text)
        assert r.edited_sha256 in shas and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == by[6].fingerprint and by[1].fingerprint == by[2].fingerprint == by[3].fingerprint
    assert by[7].near_next > 0.9 and by[4].near_next == 0
    one = spark.createDataFrame([(3, "a b c d e f g h")], "doc_id bigint, text string")
    assert fingerprints.fingerprints(one).first().near_next == 1.0


def brute_sketch(spark, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    if not words:
        return (), frozenset()
    sequence = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or [tuple(words)]
    return tuple(sequence), frozenset(sequence)


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_fingerprints_equal_brute_force_for_ids_of_any_kind(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprints, "RANGE_DOCS", (7, 9))
    monkeypatch.setattr(fingerprints, "FAN", 4)
    rng = np.random.default_rng(29)
    ids = [None, None, *range(40), *[5] * 30, 10**15, -(10**12)]
    texts = near_copies(rng, 5, 3) + ["", "a b", "a  b", None]
    rows = [(None if i is None else {"bigint": int, "string": "k{}".format, "double": float}[kind](i), texts[int(rng.integers(0, len(texts)))]) for i in ids]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3), fraction=1).collect()
    assert len(got) == len(rows)
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, hashes[r[1]]))

    def likeness(a, b):
        if a[0] == b[0]:
            return 1.0
        return len(a[1] & b[1]) / len(a[1] | b[1]) if a[1] | b[1] else 0.0

    want = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own = brute_sketch(spark, text)
        want.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(own, brute_sketch(spark, edited)), 9), round(likeness(own, brute_sketch(spark, after)), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def test_sketches_estimate_and_merge(spark):
    rng = np.random.default_rng(9)
    w = [f"t{i}" for i in rng.integers(0, 10**6, 4000)]
    df = spark.createDataFrame([(" ".join(w), " ".join(w[:400]), " ".join(w[:2000]), " ".join(w[1996:]))], "a string, b string, c string, d string")
    s = df.select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "abcd"])
    row = s.select(fingerprints.containment(F.col("b"), F.col("a")).alias("x"), fingerprints.likeness(F.col("a"), F.col("c")).alias("y"), (fingerprints.merged(F.col("c"), F.col("d")) == F.col("a.kept")).alias("z")).first()
    assert row.x == 1.0 and abs(row.y - 0.5) < 0.08 and row.z


# 7


def shares(sizes, weights, total, bound=3.0):
    """Targets by filling and sharing the excess anew."""
    targets, left = [None] * len(sizes), total
    while None in targets:
        open_ = [i for i, t in enumerate(targets) if t is None]
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > bound * sizes[i]]
        for i in full or open_:
            targets[i] = bound * sizes[i] if full else unit * weights[i]
            left -= targets[i] if full else 0
    return targets


def test_level_shares_by_weight_below_the_bound(spark):
    rng = np.random.default_rng(27)
    for sizes in ([10, 10], [1, 100, 100], [0, 5], [0, 0], [], [int(x) for x in rng.zipf(1.3, 200) % 100_000]):
        w = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
        per = spark.createDataFrame(list(zip(sizes, w, strict=True)), "w bigint, weight double")
        unit = mixing.level(per, sum(sizes), 3)
        assert [min(unit * x, 3 * s) for x, s in zip(w, sizes, strict=True)] == pytest.approx(shares(sizes, w, sum(sizes)))


def test_many_sources_are_mixed_alike(spark, monkeypatch):
    rng = np.random.default_rng(28)
    names = [None, *[f"s{i:04d}" for i in range(700)]]
    rows = [(i, names[0 if i % 3 == 0 else int(k)], " ".join(["w"] * int(n))) for i, (k, n) in enumerate(zip(rng.integers(0, 701, 4000), rng.integers(0, 40, 4000), strict=True))]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(6)
    a = {r.doc_id: (r.mix_target, r.mix_copies, r.mix_places) for r in mixing.placements(docs).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert {r.doc_id: (r.mix_target, r.mix_copies, r.mix_places) for r in mixing.placements(docs.repartition(3)).collect()} == a
    size = collections.Counter()
    for _, s, t in rows:
        size[s] += len(WORD.findall(t))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    want = dict(zip(order, shares([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], sum(size.values())), strict=True))
    taken, draws = collections.Counter(), collections.Counter()
    for i, s, t in rows:
        assert a[i][0] == pytest.approx(want[s]) and a[i][1] == len(a[i][2]) <= 3
        taken[s] += len(WORD.findall(t)) * a[i][1]
        draws.update(p.shard for p in a[i][2])
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 40 for s in order)
    assert len(draws) == 16 and max(draws.values()) <= 2 * min(draws.values())


def test_nearest_subset_equals_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(60):
        items = [(k, int(w)) for k, w in enumerate(rng.integers(1, 60, rng.integers(0, 9)))]
        target = int(rng.integers(0, 120))
        sums = [sum(w for k, w in items if m >> k & 1) for m in range(1 << len(items))]
        got = sum(dict(items)[k] for k in mixing.nearest_subset(items, target))
        assert abs(got - target) == min(abs(s - target) for s in sums)
    assert mixing.nearest_subset([(1, 10**12), (2, 10**9)], 10**9 + 5) == [2]


def test_splitting_tree_keeps_quotas():
    q = np.array([17, 0, 5, 300])
    t = mixing.splitting_tree(q, 7, np.random.default_rng(1))
    assert np.array_equal(t.sum(axis=0), q) and np.ptp(t.sum(axis=1)) <= 2 and (t >= 0).all()


def test_mix_reaches_targets_and_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    a = queries.op7_mixing(spark, sf_dir).toPandas()
    b = mixing.placements(docs.repartition(5)).select("doc_id", F.size("mix_places").alias("n")).toPandas()
    both = a.merge(b, on="doc_id")
    assert (both.taken == both["size"] * both.n).all() and len(a) == docs.count() and (a.taken <= 3 * a["size"]).all()
    x = a.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source").agg(t=("target", "first"), k=("taken", "sum"), s=("size", "sum"), n=("size", "count"), ss=("source_size", "first"))
    assert (x.s == x.ss).all() and x.t.sum() == pytest.approx(x.s.sum())
    assert (abs(x.k - x.t) <= 0.02 * x.t + 40).all()


def test_mix_edges(spark, edge, empty):
    got = mixing.mix(edge)
    assert got.columns[: len(edge.columns)] == edge.columns and mixing.mix(empty).count() == 0
    assert got.filter("mix_epoch > 2").count() == 0
    sizes = {r.doc_id: r.mix_size for r in mixing.placements(edge.select("doc_id", "source", "text")).collect()}
    assert all(sizes[i] == len(WORD.findall(t or "")) for i, t, *_ in EDGE)


# 8


def test_minhash_equals_brute_force(spark):
    rng = np.random.default_rng(10)
    texts = near_copies(rng, 12, 12)
    rows = list(enumerate(texts)) + [(900 + i, texts[0].upper()) for i in range(30)] + [(990, None), (991, " "), (992, "a b"), (993, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit("x"))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, size=4).collect()}
    sets = {i: shingle_set(t, 4) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = closure(sets, links)
    assert {i: r.component_id for i, r in got.items()} == comp
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == comp[i]) for i, r in got.items())


def test_minhash_of_a_family_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 16)
    monkeypatch.setattr(minhash, "PIVOTS", 4)
    monkeypatch.setattr(graph, "LEFT", 3)
    monkeypatch.setattr(graph, "CENTRES", 2)
    monkeypatch.setattr(graph, "TURNS", 2)
    monkeypatch.setattr(graph, "LIST_ROWS", 20)
    rng = np.random.default_rng(21)
    texts = near_copies(rng, 2, 9, 150)
    rows = [(i, t) for i, t in enumerate(texts)]
    for _ in range(110):  # chains and stars of edited copies, some only loosely alike
        w = rows[int(rng.integers(0, len(rows)))][1].split()
        for _ in range(int(rng.integers(1, 9))):
            w[int(rng.integers(0, len(w)))] = f"n{rng.integers(0, 10**6)}"
        rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, size=4).collect()}
    sets = {i: shingle_set(t, 4) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = closure(sets, links)
    assert got == comp and 10 < len(set(comp.values())) < 110


def test_families_hold_pairs_at_exactly_the_match_threshold(spark):
    rng = np.random.default_rng(22)
    for coordinates, matches in ((48, 24), (48, 20)):
        rows = []
        for k, shared in enumerate((matches - 1, matches, matches + 1)):
            a = rng.integers(0, 2**32, coordinates, dtype=np.uint32)
            b = rng.integers(0, 2**32, coordinates, dtype=np.uint32)
            b[:shared] = a[:shared]
            rows += [(10 * k, a), (10 * k + 1, b)]
        low = [[int(x) for x in col] for col in minhash.low_bits(np.array([np.resize(s, minhash.COORDINATES) for _, s in rows]))]
        data = [(i, bytes(s.tobytes()), *[c[j] for c in low]) for j, (i, s) in enumerate(rows)]
        df = spark.createDataFrame(data, "node bigint, sig binary, " + ", ".join(f"{x} bigint" for x in minhash.LOW))
        got = {r.node for r in minhash.families(df, coordinates, matches).collect()}
        assert got == {10, 11, 20, 21}


def test_lists_lose_no_link_in_any_turn(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEFT", 2)
    monkeypatch.setattr(graph, "CENTRES", 2)
    monkeypatch.setattr(graph, "LIST_ROWS", 8)
    rng = np.random.default_rng(23)
    for turns in (0, 3):
        monkeypatch.setattr(graph, "TURNS", turns)
        value = {i: int(rng.integers(0, 400)) for i in range(120)}
        posts = [(int(k), i, bool(own)) for i in value for k, own in zip(rng.integers(0, 4, 2), rng.integers(0, 2, 2), strict=True)]
        members = collections.defaultdict(set)
        owns = collections.defaultdict(set)
        for k, i, own in posts:
            members[k].add(i)
            if own:
                owns[k].add(i)
        near = lambda a, b: abs(value[a] - value[b]) <= 2
        links = [(a, b) for k in members for a in owns[k] for b in members[k] if a != b and near(a, b)]
        table = spark.createDataFrame(list(value.items()), "id bigint, v int")

        def test(pairs, known):
            a, b = (known.select(F.col("id").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")
            return pairs.join(a, "a").join(b, "b").filter("abs(va - vb) <= 2").select("a", "b")

        got = graph.link_lists(spark.createDataFrame(posts, "key bigint, id bigint, own boolean"), test, lambda ids, t=table: t.join(ids, "id"), lambda a, b: F.expr(f"abs(v{a} - v{b}) <= 3"), ["v"])
        comp = {r.node: r.component for r in got.collect()}
        want = closure(value, links)
        full = closure(value, [(a, b) for k in members for a in members[k] for b in members[k] if a < b and near(a, b)])
        assert all(comp.get(a, a) == comp.get(b, b) for a, b in links)
        assert all(full[a] == full[b] for a, b in comp.items()) and want


def test_spanning_links_of_a_large_block():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k % 7 :], rng.integers(0, 2**63, k % 9, dtype=np.uint64)])) for k in range(60)]
    got = minhash.spanning_links(np.arange(60), sets, 80)
    links = [(a, b) for a in range(60) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert closure(range(60), got) == closure(range(60), links)


def test_minhash_edges(edge, empty):
    got = minhash.near_duplicates(edge).collect()
    assert len(got) == len(EDGE) and minhash.near_duplicates(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == by[6].component_id == 5 and by[8].component_id == 7 and by[None].kept
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (1, 2, 3))


def test_pipeline_keeps_one_row_a_group_of_near_duplicates(spark):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    a, b, c, d, e, f = (near_copies(rng, 1, 3) for _ in range(6))
    rows = [(None, a[0]), (3, a[1]), (None, b[0]), (7, c[0]), (7, d[0]), (8, d[1]), (2, d[2]), (None, e[0]), (None, e[1]), (9, f[0]), (9, f[0]), (9, f[0])]
    rows += [(4, "one and two"), (4, "three and four"), (None, None), (None, None), (5, " "), (5, " ")]
    rows = [(i, t, s, None) for (i, t), s in zip(rows, "xyxyxyxyxyzzxyxxxx", strict=True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").repartition(3)
    sets = [shingle_set(t, 5) for _, t, _, _ in rows]
    links = [(i, j) for j in range(len(rows)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = closure(range(len(rows)), links)
    groups = collections.defaultdict(list)
    for i, k in comp.items():
        groups[k].append(rows[i])
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    left = collections.Counter(tuple(r) for r in out.collect())
    assert links and left.total() == len(groups)
    for members in groups.values():
        assert sum(left[r] > 0 for r in set(members)) == 1
        known = [r[0] for r in members if r[0] is not None]
        assert {r[0] for r in members if left[r]} == {min(known) if known else None}


# 9


def test_warc_derivatives_refer_to_their_source(spark):
    pages = [(1, "http://a.example/x y", "<html><head><title>A &amp; B</title><style>p{}</style></head><body><p>One<br>two <b>three</b></p><script>if (a < b) {}</script><a href='/n?a=1&amp;b=2'>next</a><!-- no --></body>"),
             (2, None, None), (3, "http://b.example", ""), (3, "http://b.example", ""), (4, "http://c.example", "<a" * 5000 + "<p>x " * 100)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("record", F.lit(5))
    sources = warc.responses(df)
    got = warc.derivatives(sources).collect()
    assert len(got) == 2 * len(pages) and warc.derivatives(sources.filter("1 = 0")).count() == 0
    response_ids = {}
    for r in sources.collect():
        (headers, block), = warc.parse(io.BytesIO(bytes(r.record)))
        assert headers["warc-block-digest"] == warc.digest(block) and headers["warc-payload-digest"] == warc.digest(block.partition(b"\r\n\r\n")[2])
        response_ids[r.id] = headers
    for r in got:
        (headers, block), = warc.parse(io.BytesIO(bytes(r.record)))
        src = response_ids[r.id]
        assert headers["warc-refers-to"] == src["warc-record-id"] == r.refers_to and headers["warc-type"] == r.kind
        assert headers["warc-block-digest"] == warc.digest(block) == r.block_digest and int(headers["content-length"]) == len(block) == r.content_length
        assert r.source_payload_digest == src["warc-payload-digest"] and headers.get("warc-target-uri") == src.get("warc-target-uri")
    one = {r.kind: bytes(r.record).decode() for r in got if r.id == "1"}
    assert "A & B\nOne\ntwo three" in one["conversion"] and "a < b" not in one["conversion"]
    assert "outlink: /n?a=1&b=2" in one["metadata"] and "source-header-content-type: text/html; charset=utf-8" in one["metadata"]


def test_warc_leaves_out_what_is_no_record(spark):
    good = warc.response(1, "http://x/1", "<p>one</p>")
    short = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 900\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nblock\r\n\r\n"
    cases = [("a", b"garbage\r\nmore\r\n" + good), ("b", bad + good), ("c", good + short), ("d", None), ("e", b""), ("f", good + b"WARC/1.1\r\n\r\n" + good), ("g", good)]
    df = spark.createDataFrame(cases, "id string, record binary").withColumn("kind", F.lit(1))
    got = collections.Counter(r.id for r in warc.derivatives(df).collect())
    assert got == {"a": 2, "b": 2, "c": 2, "f": 4, "g": 2}
    faults = {(r.id, r.fault): r.n for r in warc.malformed(df).collect()}
    assert faults == {("a", "no version line"): 1, ("b", "no content length"): 1, ("b", "no version line"): 1, ("c", "truncated block"): 1, ("f", "no content length"): 1}


def test_warc_reads_coded_payloads():
    import gzip

    page = b"<p>caf\xc3\xa9</p><a href=x>y</a>"
    packed = gzip.compress(page)
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    for fields, payload in ((b"", page), (b"Content-Encoding: gzip\r\n", packed), (b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n", chunked), (b"Content-Encoding: deflate\r\n", zlib.compress(page)), (b"Content-Encoding: gzip\r\n", page)):
        block = b"HTTP/1.1 200 OK\r\n" + fields + b"\r\n" + payload
        made = {r["kind"]: r for r in warc.derive({"warc-record-id": "<urn:x>"}, block)}
        assert "caf\u00e9\ny".encode() in made["conversion"]["record"] and made["metadata"]["n_links"] == 1
        assert made["metadata"]["source_payload_digest"] == warc.digest(payload)


def test_warc_files_read_back(spark, tmp_path):
    import gzip

    raw = b"".join(gzip.compress(warc.response(i, f"http://x/{i}", "<p>t</p>")) for i in range(3))
    (tmp_path / "a.warc.gz").write_bytes(raw)
    records = warc.read_records(spark, str(tmp_path))
    assert records.count() == 3 and warc.derivatives(records).count() == 6


# Queries and pipeline


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_contract_columns(spark, sf_dir):
    q = queries.queries()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, columns, mod, held in (("op2_language", ["doc_id", "held_out", "lang_pred", "score"], 4, 2), ("op5_quality", ["doc_id", "held_out", "score", "predicted"], 3, 1), ("op10_toxicity", ["doc_id", "held_out", "score", "predicted"], 5, 0)):
        got = q[name](spark, sf_dir)
        assert got.columns == columns
        rows = got.collect()
        assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) for r in rows)


def test_pipeline_equals_its_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns
        rows = docs.collect()
        assert rows
        docs = spark.createDataFrame(rows, before.schema)
        if name == "near_dedup":
            left = minhash.near_duplicates(docs)
            assert left.filter("NOT kept").count() == 0
    want = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want
