"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text.  A text is cut, from left to right, into the longest
phrases that occur in that labelled text; the fewer phrases a byte of text needs, the nearer the
language (Ziv and Merhav, 1993).  The language with the fewest phrases, normalised by length, wins.

Automata become flat tables whose missing transitions already lead to the start of the next phrase,
so that many windows of text are parsed in step by array lookups, each as if a phrase began with it.  Phrases that run
on from the window before are then followed until both parses begin a phrase at the same byte, from
where they are one.  So the count is that of one parse from end to end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpointed

#: Labelled texts of a language that an automaton is built from, whatever their length, and the pieces and characters that each of them gives
#: at most: a longer text gives so many pieces at even distances from its beginning to its end.
TRAIN_ROWS, TRAIN_PIECES, TRAIN_PIECE_CHARS = 24, 16, 4096
#: Languages whose automata a Python worker holds at once; with more, the texts go round again for each group.
LANGUAGES_AT_ONCE = 16
WINDOW = 256
UNDETERMINED = "und"

#: A-Z as a-z; any run of other ASCII bytes counts as one space.
NORMAL = K.ASCII_LOWER.copy()
NORMAL[:128][~np.isin(np.arange(128), [*range(65, 91), *range(97, 123)])] = 32


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and offsets, with repeated spaces of a text removed."""
    low = NORMAL[data]
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[offsets[:-1][offsets[:-1] < len(low)]] = True
    count = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], count[offsets]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton (Blumer et al., 1985); state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return step


@dataclass
class LanguageModel:
    languages: list[str]
    classes: np.ndarray  # byte -> class; 0 is the pad, 1 any byte outside the labelled text
    width: int
    bits: np.ndarray  # log2 of the labelled bytes: what a phrase costs
    tables: list[np.ndarray]  # [state * width + class] -> 2 * next state * width + (1 where a phrase begins)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages phrase counts, each times the bits of a phrase; bytes parsed of each text)."""
        counts = np.zeros((len(offsets) - 1, len(self.languages)))
        sizes = np.zeros(len(offsets) - 1, dtype=np.int64)
        for lo, hi, part, off in K.chunks(data, offsets, 1 << 20):
            low, bounds = normalised(part, off)
            code = self.classes[low]
            length = np.diff(bounds)
            sizes[lo:hi] = length
            windows = -(-length // WINDOW)
            text = np.repeat(np.arange(len(length)), windows)
            if not len(text):
                continue
            first = np.concatenate([[0], np.cumsum(windows)])[:-1]
            start = bounds[:-1][text] + WINDOW * (np.arange(len(text)) - first[text])
            room = np.minimum(bounds[1:][text] - start, WINDOW)
            order = np.argsort(-room, kind="stable")  # full windows first: those still open are a prefix
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            after = np.full(len(order), -1)  # the window that goes on from this one
            follows = np.flatnonzero(text[1:] == text[:-1])
            after[rank[follows]] = rank[follows + 1]
            start, room, text = start[order], room[order], text[order]
            for l, table in enumerate(self.tables):
                total = parse(table, code, start, room, after)
                counts[lo:hi, l] = np.bincount(text, weights=total, minlength=len(length))
        return counts * self.bits, sizes


def parse(table: np.ndarray, code: np.ndarray, start: np.ndarray, room: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Phrases that begin in each window (longest windows first); ``after`` has the window that goes on from each, or -1."""
    n, longest = len(start), int(room[0])
    begins = np.zeros((longest, n), dtype=bool)
    state = np.zeros(n, dtype=table.dtype)
    open_ = np.searchsorted(-room, -np.arange(1, longest + 1), side="right")
    for j in range(longest):
        k = open_[j]
        found = table[state[:k] + code[start[:k] + j]]
        begins[j, :k] = found & 1
        state[:k] = found >> 1
    upto = np.cumsum(begins, axis=0, dtype=np.int16)
    alone, ends = upto[-1].astype(np.int64), state.copy()
    total = alone.copy()
    before = np.flatnonzero(after >= 0)
    while len(before):  # windows whose predecessor ends in another state than was last assumed
        here = after[before]
        now, count, live = ends[before], np.zeros(len(here), dtype=np.int64), np.arange(len(here))
        kept = ends[here].copy()
        for j in range(int(room[here].max())):
            live = live[room[here[live]] > j]
            at = here[live]
            found = table[now[live] + code[start[at] + j]]
            new = (found & 1).astype(bool)
            now[live] = found >> 1
            count[live] += new
            met = new & begins[j, at]
            if met.any():
                done = live[met]
                count[done] += alone[here[done]] - upto[j, here[done]]
                now[done] = state[here[done]]
                live = live[~met]
            if not len(live):
                break
        total[here], ends[here] = count, now
        before = here[(ends[here] != kept) & (after[here] >= 0)]
    return total


def build(samples: dict[str, list[bytes]]) -> LanguageModel:
    """Automata of the normalised bytes of each language's texts, in the order given."""
    languages = sorted(samples)
    texts = []
    for language in languages:
        joined = b"\n".join(samples[language])
        data, _ = normalised(np.frombuffer(joined, dtype=np.uint8), np.array([0, len(joined)]))
        texts.append(data)
    seen = np.unique(np.concatenate(texts)) if texts else np.zeros(0, dtype=np.uint8)
    classes = np.ones(256, dtype=np.int32)
    classes[seen] = np.arange(2, len(seen) + 2)
    width = len(seen) + 2
    tables = []
    for data in texts:
        steps = suffix_automaton(classes[data].tolist())
        restart = np.ones(width, dtype=np.int64)  # an unknown byte is a phrase of its own
        for c, s in steps[0].items():
            restart[c] = 2 * s * width + 1
        table = np.tile(restart, len(steps))
        at = np.array([s * width + c for s, step in enumerate(steps) for c in step], dtype=np.int64)
        to = np.array([t for step in steps for t in step.values()], dtype=np.int64)
        table[at] = 2 * to * width
        table[:width] = restart  # from the start any byte begins a phrase
        tables.append(table.astype(np.int32) if len(table) < 2**30 else table)
    return LanguageModel(languages, classes, width, np.log2(np.array([len(t) for t in texts]) + 2.0), tables)


@lru_cache(maxsize=1)
def _built(samples: tuple[tuple[str, tuple[bytes, ...]], ...]) -> LanguageModel:
    """The model of one group of languages, once for each Python worker."""
    return build({l: list(t) for l, t in samples})


K.CACHES.append(_built.cache_clear)


def _learnt(text: Column) -> Column:
    """The text, or evenly spaced pieces of one that is longer than they are together."""
    size, pieces = F.length(text), F.sequence(F.lit(0), F.lit(TRAIN_PIECES - 1))
    at = lambda i: (1 + F.floor(i * (size - TRAIN_PIECE_CHARS) / (TRAIN_PIECES - 1))).cast("int")
    cut = F.array_join(F.transform(pieces, lambda i: F.substring(text, at(i), F.lit(TRAIN_PIECE_CHARS))), "\n")
    return F.when(size > TRAIN_PIECES * TRAIN_PIECE_CHARS, cut).otherwise(text)


def train(docs: DataFrame, learnable: Column, lang_col: str = "lang", text_col: str = "text", rows: int = TRAIN_ROWS, seed: int = 3) -> dict[str, list[bytes]]:
    """What is learnt: ``rows`` labelled texts a language at most, drawn by a hash of the text whatever their length.

    Each gives at most TRAIN_PIECES pieces, spread evenly over the whole text.  Null languages
    and texts, and texts without a letter, are left out; equal texts count once; the choice does not depend on partitions.
    """
    known = docs.filter(learnable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(lang_col).alias("l"), _learnt(F.col(text_col)).alias("t"), F.xxhash64(F.lit(seed), text_col).alias("h"))
    found = known.groupBy("l").agg(F.approx_count_distinct("h").alias("n"), F.min(F.pmod("h", F.lit(1 << 30))).alias("least")).collect()  # one row a language
    if not found:
        return {}
    plan = [(r.l, max(int(min(1.0, 2 * rows / r.n) * (1 << 30)), r.least + 1)) for r in found]
    rates = F.broadcast(docs.sparkSession.createDataFrame(plan, f"l {known.schema['l'].dataType.simpleString()}, below bigint"))
    near = F.pmod("h", F.lit(1 << 30))
    chosen = known.join(rates, "l").filter(near < F.col("below"))
    texts: dict[str, list[bytes]] = {}
    for r in sorted(chosen.groupBy("l", near.alias("near")).agg(F.min("t").alias("t")).collect(), key=lambda r: (r.near, r.t)):  # about 2 * rows texts a language
        texts.setdefault(r.l, []).append(r.t.encode())
    return {l: t[:rows] for l, t in texts.items()}


def identify(docs: DataFrame, samples: dict[str, list[bytes]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``lang_pred``, ``score``) of every row, from its whole text, by the labelled texts of each language.

    A text that is null or has no letter is ``und`` with score 0, and so is any text where there is nothing to learn
    from.  The score is the winner's share of the inverse phrase rates.  Ties go to the first language by name.  Repeated rows and
    null ids are treated like any other, and an empty table gives an empty one.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(text_col).rlike(r"\p{L}").alias("letters"))
    state = source.withColumns({"best": F.lit(float("inf")), "lang_pred": F.lit(UNDETERMINED), "total": F.lit(0.0)})
    names = sorted(samples)
    for lo in range(0, len(names), LANGUAGES_AT_ONCE):
        group = tuple((l, tuple(samples[l])) for l in names[lo : lo + LANGUAGES_AT_ONCE])
        state = (state if lo == 0 else checkpointed(state)).mapInArrow(_compared(docs.sparkSession.sparkContext.broadcast(group)), state.schema)  # TRAIN_ROWS texts of each language
    known = F.coalesce("letters", F.lit(False)) & (F.col("total") > 0)
    score = F.when(known, 1.0 / (F.greatest("best", F.lit(1.0)) * F.col("total"))).otherwise(0.0)
    return state.select(F.col("id").alias(id_col), F.when(known, F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"), score.alias("score"))


def _compared(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _built(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, _ = model.phrases(*K.text_buffers(batch.column(1)))
            at = counts.argmin(axis=1)
            least, before = counts[np.arange(len(at)), at], np.asarray(batch.column(3))
            name = [model.languages[i] if x < y else z for i, x, y, z in zip(at, least, before, batch.column(4).to_pylist(), strict=True)]
            total = np.asarray(batch.column(5)) + (1.0 / np.maximum(counts, 1.0)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.minimum(least, before)), pa.array(name, pa.string()), pa.array(total)], names=batch.schema.names)

    return run
