"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a text the table keeps the last token of the prefix's only BPE
encoding.  An Aho-Corasick automaton lists the pieces that end at each position; of these
exactly one forms a compatible pair with the last token of the prefix before it, where a pair is
compatible if the merge rules leave the two pieces side by side.  Following the table from the end
recovers the ids backwards, in time linear in the text.

Pieces never hold a word mark after another character, so a text falls apart at its word
marks and each part is encoded alone; frequent parts are kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: Entries that the caches of one Python worker, which outlive a task, hold at most; they start afresh when full.
CACHE_ENTRIES = 200_000
#: Longer parts are not kept in the cache.
CACHE_PART_CHARS = 48


class PieceCodec:
    """Encoder and decoder for one SentencePiece BPE model file (identity normaliser, byte fallback)."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.treat_whitespace_as_suffix or USER_DEFINED in kinds:
            raise ValueError("a BPE model with the identity normaliser and without user-defined pieces is needed")
        self.dummy_prefix = norm.add_dummy_prefix
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.splittable = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score)
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            if self.merged(piece) == [piece]:  # the rules reach it
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.encoded, self.odd = _Words(self), {}
        self.line_feed = f"{self.byte_ids.get(10, self.unknown)},"
        self.id_text = {p: str(i) for p, i in self.ids.items()}

    def merged(self, text: str) -> list[str]:
        """The merge rules applied one by one; only for pieces and pairs of pieces."""
        symbols, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHE_ENTRIES:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def part_pieces(self, part: str) -> list[str]:
        """Pieces of one part, through the table of last tokens."""
        last: list[str] = list(part)  # a character that no piece covers stays alone
        pairs, done = self.pairs, -1
        for end, (piece, length) in self.automaton.iter(part):  # by end, longest first
            if end != done:
                if length > end:
                    last[end], done = piece, end
                    continue
                fits = pairs.get((before := last[end - length], piece))
                if fits if fits is not None else self.compatible(before, piece):
                    last[end], done = piece, end
        out, at = [], len(part) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        out.reverse()
        return out

    def part_ids(self, part: str) -> list[int]:
        out: list[int] = []
        for piece in self.part_pieces(part):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return out

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        text = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text) if self.splittable else [text]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in self.part_ids(part)]

    def join_pieces(self, ids: list[int]) -> str:
        """Text of the ids with marks turned to spaces; runs of byte pieces are read as UTF-8."""
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == BYTE:
                run.append(int(self.pieces[i][1:-1], 16))
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i < 0 or self.kinds[i] == CONTROL:
                continue
            out.append(" ⁇ " if self.kinds[i] == UNKNOWN else self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.join_pieces(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by commas, the text that decoding gives); words come from the cache."""
        if not text:
            return 0, "", ""
        if self.splittable and self.dummy_prefix and MARK not in text:
            words = text.replace("\n", " \n").split(" ")  # no piece holds a line feed, so parts begin there too
            if "" not in words:
                encoded = self.encoded
                ids = ",".join([encoded[w] for w in words])
                # Decoding a word gives the word back, but for those in `odd`: each was decoded when it was first seen.
                back = text if not self.odd else "".join([self.odd.get(w) or (w if w[0] == "\n" else " " + w) for w in words])[1:]
                return ids.count(",") + 1, ids, back
        found = [self.part_ids(p) for p in self.parts(text)]
        ids = ",".join([str(i) for part in found for i in part])
        back = "".join([self.join_pieces(part) for part in found])
        return ids.count(",") + 1, ids, back[1:] if self.dummy_prefix and back[:1] == " " else back


class _Words(dict):
    """Ids, joined by commas, of a word with a mark before it, or of one that begins with a line feed.

    The codec's ``odd`` has texts that decode otherwise.
    """

    def __init__(self, owner: PieceCodec):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> str:
        c = self.owner
        line = word[0] == "\n"
        pieces = c.part_pieces(word[1:] if line else MARK + word)
        try:
            value = ",".join([c.id_text[p] for p in pieces])
            back = "".join(pieces).replace(MARK, " ")
            if line:
                value, back = (c.line_feed + value).rstrip(","), "\n" + back
        except KeyError:
            ids = c.part_ids(word if line else MARK + word)
            value, back = ",".join(map(str, ids)), c.join_pieces(ids)
        if back != (word if line else " " + word):
            c.odd[word] = back
        if len(word) <= CACHE_PART_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value


def _utf8(run: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that fits no character."""
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    """One codec for each Python worker and model."""
    made = PieceCodec(model_path)

    def empty() -> None:
        made.encoded.clear()
        made.pairs.clear()

    K.CACHES.append(empty)
    return made


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_path: str | None = None, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode each whole text and decode it again.

    Returns one row per row of ``docs``: the id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by
    commas) and ``decoded_sha256``; ``with_ids`` adds ``ids`` (array), ``with_text`` adds ``decoded`` (string).
    A null text counts as empty: no ids, decoded to the empty text.  Repeated rows give
    repeated rows, an empty table an empty one, and other columns are not read.
    The work is a map: nothing is shuffled and a lost task is simply run again.
    """
    path = model_path or default_model()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        K.trim()  # words in the cache stay for the next task
        for batch in batches:
            n, ids, texts, ids_sha, text_sha = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                count, joined, back = c.digest(text or "")
                n.append(count)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    ids.append(np.fromstring(joined, dtype=np.int32, sep=",") if joined else np.zeros(0, dtype=np.int32))
                if with_text:
                    texts.append(back)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32))))
            if with_text:
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        K.trim()

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_path: str | None = None, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, ``decoded``): the text of each row's ids; a null list gives null, an empty one the empty text."""
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else codec(path).decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "decoded"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, decoded string").withColumnRenamed("id", id_col)
