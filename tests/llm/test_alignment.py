"""Alignment of two tokenizers against brute force over the libraries, and its edge cases."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestat.llm import alignment
from lodestat.llm.piece_bpe import default_model

SIDE_A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SIDE_A.encode_special_tokens = True
SIDE_B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)}
ENTRY = {i: t for t, i in SIDE_A.get_vocab().items()}


def piece(i):
    t = SIDE_B.id_to_piece(i)
    return bytes([int(t[1:-1], 16)]) if SIDE_B.is_byte(i) else t.replace("▁", " ").encode()


def brute(rows):
    made, count = [], collections.Counter()
    for doc, text in rows:
        a, b = SIDE_A.encode(" " + (text or ""), add_special_tokens=False).ids, SIDE_B.encode(text or "")
        left, right = [bytes(BYTE[c] for c in ENTRY[i]) for i in a], [piece(i) for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(left) != whole or b"".join(right) != whole:
            made.append((doc, 0, 0, [], collections.Counter()))
            continue
        groups, links, i, j, at_a, at_b = [], collections.Counter(), 0, 0, 0, 0
        ga, gb = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                ga.append(a[i])
                at_a += len(left[i])
                i += 1
            else:
                gb.append(b[j])
                at_b += len(right[j])
                j += 1
            if at_a == at_b and ga and gb:
                groups.append((ga, gb))
                links.update((x, y) for x in ga for y in gb)
                ga, gb = [], []
        made.append((doc, len(a), len(b), groups, links))
        count.update(links.keys())
    best = collections.Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc, n_a, n_b, groups, links in made:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        hit = sum(m for p, m in links.items() if count[p] == best[p[0]])
        out.append((doc, n_a, n_b, len(groups), sum(links.values()), hit, sum(m * count[p] for p, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


ALPHABET = list("abcdeE ,.'\n\t\r0129-=_<|>/") + ["  ", "\n\n", " \n", "é", "ß", "中", "\U0001f642", " ", "　", "\x1c", "\x85", "<|endoftext|>", "</s>", "<0x41>", "the ", "'ll ", "====", "́", "\x00", "ال"]


def fuzzed(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(1, 60))) for _ in range(n)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, block int, a string")


def test_both_sides_equal_the_libraries_on_odd_texts():
    found = alignment.aligner(alignment.byte_bpe_path(), default_model())
    texts = [*fuzzed(1, 3000), " " * 300_000 + "x", "=" * 5000, "ab " * 4000]
    for i, ids in found.encoded(texts):
        a, b = SIDE_A.encode(" " + texts[i], add_special_tokens=False).ids, SIDE_B.encode(texts[i])
        whole = (" " + texts[i]).encode()
        if b"".join(map(piece, b)) != whole:
            assert ids is None, texts[i][:80]
        else:
            assert ids[0].tolist() == a and ids[1].tolist() == b, texts[i][:80]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, splits, hand-outs and fresh tables
        for name, value in {"BLOCK_BYTES": 200, "TASK_POSTINGS": 300, "HELD_DOCUMENTS": 2, "UNITS": 20, "GROUPS": 4}.items():
            monkeypatch.setattr(alignment, name, value)
    rows = [(i, t) for i, t in enumerate(fuzzed(2, 150))] + [(None, "the end"), (None, "the end"), (7, None), (7, ""), (8, "a ▁ b"), (9, " "), (10, "=" * 700 + " " * 90 + "-" * 333), (11, "the cat sat, the cat ran\nthe end.")]
    assert got(alignment.align(frame(spark, rows).repartition(3))) == brute(rows)


def test_hot_ids_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(alignment, "TASK_POSTINGS", 50)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 64)
    rows = [(i, "the the the" if i % 3 else f"word {i}") for i in range(400)]
    assert got(alignment.align(frame(spark, rows).repartition(4))) == brute(rows)
    assert got(alignment.align(frame(spark, rows).filter("1 = 0"))) == []
