"""Line dedup by a segment-partition edit join.

A line of l bytes is cut into tolerance(l) + 1 even segments; a line within that edit distance keeps at least one of them
whole (Li et al., Pass-Join, 2011).  Segments are posted under their line's length, their number and their hash; a line
probes, for every length it may meet, the substrings that can stand for each segment.  Lines that meet are
verified by banded bit-parallel edit distance.  Equal lines are one class throughout.

Distances are over the UTF-8 bytes of lines stripped of white space at both ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_BYTES, checkpointed, small_or_shuffled
from .graph import link_lists

U64 = np.uint64
#: Greatest edit distance, and the least line lengths (bytes) for a distance of 1, of 2, ...
TOLERANCE = 2
LEAST_BYTES = (24, 48)
#: Rows of a class that are too many for the tasks of one shuffled join.
HOT = 4096


def tolerance(length: np.ndarray) -> np.ndarray:
    """Edit distance allowed to a line of so many bytes, the shorter one of a pair."""
    return np.searchsorted(np.array(LEAST_BYTES), length, side="right")


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, start, end) of each line; starts and ends leave out white space at either end."""
    if len(data) == 0:
        zero = np.zeros(0, dtype=np.int64)
        return zero, zero, zero, zero
    feed = np.flatnonzero(data == 10)
    full = offsets[1:] > offsets[:-1]
    starts = np.sort(np.concatenate([offsets[:-1][full], feed + 1]))
    starts = starts[starts < len(data)]
    starts = np.unique(starts)
    text = np.searchsorted(offsets, starts, side="right") - 1
    stops = np.concatenate([starts[1:], [len(data)]])
    first = np.searchsorted(text, np.arange(len(offsets) - 1))
    number = np.arange(len(starts)) - first[text]
    black = np.flatnonzero(~K.IS_SPACE[data])
    lo, hi = np.searchsorted(black, starts), np.searchsorted(black, stops)
    some = hi > lo
    text, number, lo, hi = text[some], number[some], lo[some], hi[some]
    return text, number, black[lo], black[hi - 1] + 1


def line_ids(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return K.span_hash(prefix, starts, ends).view(np.int64)


def segment(length: np.ndarray, pieces: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment i of an even partition whose later segments are the longer ones."""
    base = length // pieces
    shorter = pieces - length % pieces
    return base * i + np.maximum(i - shorter, 0), base + (i >= shorter)


def keys(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(indexes of lines, their keys, whether these are the lines' own segments)."""
    total = ends - starts
    for shorter in range(TOLERANCE + 1):
        length = total - shorter
        allowed = tolerance(length)
        for i in range(TOLERANCE + 1):
            at, size = segment(np.maximum(length, 1), allowed + 1, i)
            for shift in range(-TOLERANCE, TOLERANCE + 1):
                fits = (allowed > 0) & (shorter <= allowed) & (i <= allowed) & (abs(shift) <= i) & (np.abs(shift - shorter) <= allowed - i)
                p = at + shift
                fits &= (p >= 0) & (p + size <= total)
                which = np.flatnonzero(fits)
                if len(which):
                    begin = starts[which] + p[which]
                    h = K.span_hash(prefix, begin, begin + size[which])
                    yield which, K.mix(h ^ K.mix(length[which].astype(U64) * U64(8) + U64(i))).view(np.int64), shorter == 0 and shift == 0


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, line, id) of every line that is not blank; ``row`` tells texts of one doc apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(2))
            for lo, hi, part, off in K.chunks(data, offsets):
                text, number, starts, ends = line_spans(part, off)
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(at), batch.column(1).slice(lo, hi - lo).take(at), pa.array(number, pa.int32()), pa.array(line_ids(K.prefix_hash(part), starts, ends))], names=["doc", "row", "line", "id"])

    source = _source(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc {source.schema['doc'].dataType.simpleString()}, row bigint, line int, id bigint")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, own) of the distinct lines of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        seen: set[int] = set()
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(2))
            for _, _, part, off in K.chunks(data, offsets):
                _, _, starts, ends = line_spans(part, off)
                prefix = K.prefix_hash(part)
                ids = line_ids(prefix, starts, ends)
                new = _unseen(ids, seen)
                ids, starts, ends = ids[new], starts[new], ends[new]
                for which, key, own in keys(prefix, starts, ends):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[which]), pa.array(np.full(len(which), own))], names=["key", "id", "own"])

    return _source(docs, id_col, text_col).mapInArrow(run, "key bigint, id bigint, own boolean")


def lines_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, sk) of the lines with the given ids; ``sk`` counts bytes by class, modulo 16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        seen: set[int] = set()
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(2))
            for _, _, part, off in K.chunks(data, offsets):
                _, _, starts, ends = line_spans(part, off)
                ids = line_ids(K.prefix_hash(part), starts, ends)
                new = _unseen(ids, seen)
                ids, starts, ends = ids[new], starts[new], ends[new]
                size = ends - starts
                own = np.repeat(np.arange(len(size)), size)
                at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(len(own))
                kind = (part[at].astype(np.int64) * 0x9E3B >> 9) & 15
                count = np.bincount(own * 16 + kind, minlength=16 * len(size)).reshape(-1, 16).astype(U64) & U64(15)
                sk = (count << (U64(4) * np.arange(16, dtype=U64))).sum(axis=1, dtype=U64)
                raw = part.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()), pa.array(sk.view(np.int64))], names=["id", "line", "sk"])

    found = _source(docs, id_col, text_col).mapInArrow(run, "id bigint, line binary, sk bigint")
    return found.join(small_or_shuffled(ids, 16), "id").dropDuplicates(["id"])


def banded_distance(a: list[bytes], b: list[bytes], bound: int) -> np.ndarray:
    """Edit distances of pairs whose lengths differ by ``bound`` at most, or bound + 1 where greater.

    The vertical differences of the 2 * bound + 1 diagonals about the main one are bits of one word, which slides down
    the longer line; additions carry matches along the band (Hyyrö, 2003).  All pairs go in step.
    """
    longer = [x if len(x) >= len(y) else y for x, y in zip(a, b, strict=True)]
    shorter = [y if len(x) >= len(y) else x for x, y in zip(a, b, strict=True)]
    n, m = np.array([len(x) for x in longer]), np.array([len(x) for x in shorter])
    out = np.zeros(len(a), dtype=np.int64)
    order = np.argsort(-m, kind="stable")
    lo = 0
    while lo < len(order):
        wide = int(n[order[lo]]) + 2 * bound + 2
        hi = min(len(order), lo + max(1, (8 << 20) // wide))
        pick = order[lo:hi]
        width = int(n[pick].max()) + 2 * bound + 2
        text = np.zeros((len(pick), int(m[pick].max()) + 1), dtype=np.int16)
        word = np.full((len(pick), width), -1, dtype=np.int16)  # bound + 1 pads before the line
        for r, i in enumerate(pick):
            text[r, : m[i]] = np.frombuffer(shorter[i], dtype=np.uint8)
            word[r, bound + 1 : bound + 1 + n[i]] = np.frombuffer(longer[i], dtype=np.uint8)
        out[pick] = _in_step(np.ascontiguousarray(word.T), np.ascontiguousarray(text.T), n[pick], m[pick], bound)
        lo = hi
    return np.minimum(out, bound + 1)


def _in_step(word: np.ndarray, text: np.ndarray, n: np.ndarray, m: np.ndarray, bound: int) -> np.ndarray:
    top = U64(1 << 63)
    vp = np.full(len(n), U64((2**64 - 1) << (64 - bound - 1) & (2**64 - 1)), dtype=U64)
    vn = np.zeros(len(n), dtype=U64)
    dist = np.minimum(n, bound)
    row = U64(1) << (62 - np.maximum(bound - n, 0)).astype(U64)
    active = np.searchsorted(-m, -np.arange(1, int(m.max(initial=0)) + 1), side="right")
    for j in range(len(active)):
        k = active[j]
        p, v, d = vp[:k], vn[:k], text[j, :k]
        match = np.zeros(k, dtype=U64)
        for s in range(2 * bound + 1):  # bit 63 - s is the longer line's byte j + bound - s
            at = j + bound - s + bound + 1
            if 0 <= at < len(word):
                match |= (word[at, :k] == d).astype(U64) << U64(63 - s)
        d0 = (((match & p) + p) ^ p) | match | v
        hp = v | ~(d0 | p)
        hn = d0 & p
        slanted = j < n[:k] - bound
        dist[:k] += np.where(slanted, (d0 & top) == 0, ((hp & row[:k]) != 0).astype(np.int64) - ((hn & row[:k]) != 0))
        row[:k] = np.where(slanted, row[:k], row[:k] >> U64(1))
        vp[:k] = hn | ~((d0 >> U64(1)) | hp)
        vn[:k] = (d0 >> U64(1)) & hp
    return dist


def near_counts(a: str, b: str) -> Column:
    """Whether two byte-class counts may belong to lines within the tolerance: each edit moves two counts by one."""
    terms = []
    for k in range(16):
        diff = f"(((shiftrightunsigned(sk{a}, {4 * k}) & 15) - (shiftrightunsigned(sk{b}, {4 * k}) & 15) + 16) & 15)"
        terms.append(f"least({diff}, 16 - {diff})")
    return F.expr(f"({' + '.join(terms)}) <= {2 * TOLERANCE}")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component) of the distinct lines that are linked to another one."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            allowed = tolerance(np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype=np.int64))
            yield batch.filter(pa.array(banded_distance(a, b, TOLERANCE) <= allowed)).select([0, 1])

    def test(pairs: DataFrame, known: DataFrame) -> DataFrame:
        left, right = (known.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}"), F.col("sk").alias(f"sk_{x}")) for x in "ab")
        both = pairs.join(left, "a").join(right, "b").filter(near_counts("_a", "_b"))
        return both.select("a", "b", "line_a", "line_b").mapInArrow(verify, "a bigint, b bigint")

    return link_lists(postings(docs, id_col, text_col), test, lambda ids: checkpointed(lines_of(docs, ids, id_col, text_col)), near_counts, ["sk"])


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line that is not blank: (id, ``row_hash``, ``line_no`` from 0, ``class_id``, ``n_copies``, ``kept``).

    Lines are linked where they are equal or within the edit distance that the shorter one's length allows (none under
    24 bytes, 1 from 24, 2 from 48); ``class_id`` names a component of links, ``n_copies`` counts its lines in
    all texts, and the first by (id, line number) is kept.  A null text has no lines; null ids come first; repeated rows count as one text and are treated alike; an empty table gives an empty one.
    """
    found = checkpointed(occurrences(docs, id_col, text_col))
    classes = checkpointed(line_classes(docs, id_col, text_col).select(F.col("node").alias("id"), "component"))
    named = found.join(small_or_shuffled(classes, 32), "id", "left").withColumn("class_id", F.coalesce("component", "id"))
    named = named.select("doc", "row", "line", "class_id")
    order = F.struct("doc", "line", "row")
    many = checkpointed(named.groupBy("class_id").agg(F.min(order).alias("first"), F.count("*").alias("n_copies")).filter("n_copies > 1"))
    out = with_many(named, many)
    kept = F.col("first").isNull() | order.eqNullSafe(F.col("first"))
    return out.select(F.col("doc").alias(id_col), F.col("row").alias("row_hash"), F.col("line").alias("line_no"), "class_id", F.coalesce("n_copies", F.lit(1).cast("bigint")).alias("n_copies"), kept.alias("kept"))


def with_many(rows: DataFrame, many: DataFrame, key: str = "class_id", count: str = "n_copies") -> DataFrame:
    """``rows`` left-joined with a row for each class that has several; classes of more than HOT rows are not shuffled by their key.

    There are at most one HOT-th as many of those as rows, and they are sent to every executor if that fits.
    """
    n = many.count()
    if n * 64 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(many), key, "left")
    hot = checkpointed(many.filter(F.col(count) > HOT))
    hot = small_or_shuffled(hot, 64)
    rest = rows.join(hot.select(key), key, "left_anti").join(many.filter(F.col(count) <= HOT), key, "left")
    return rows.join(hot, key).unionByName(rest)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` without the lines that ``line_decisions`` rejects; a text that loses all its lines goes as a row.

    Other lines stay as they are, blank ones too.  ``chars_col``, where present, is counted anew.
    """
    gone = line_decisions(docs, id_col, text_col).filter("NOT kept").distinct().groupBy(F.col(id_col).alias("__g_id"), F.col("row_hash").alias("__g_row")).agg(F.collect_list("line_no").alias("__g_lines"))
    row = F.xxhash64(text_col)
    kept = docs.withColumn("__g_own", row).join(gone, F.col(id_col).eqNullSafe(F.col("__g_id")) & (F.col("__g_own") == F.col("__g_row")), "left")
    parts = F.split(F.col(text_col), "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__g_lines")
    text = F.when(F.col("__g_lines").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(rest, lambda i: F.get(parts, i)), "\n"))
    kept = kept.withColumn("__g_text", text).filter(F.col("__g_lines").isNull() | F.col("__g_text").rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.col("__g_text").alias(c) if c == text_col else F.char_length("__g_text").cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(c) for c in docs.columns]
    return kept.select(*columns)


def _unseen(ids: np.ndarray, seen: set[int]) -> np.ndarray:
    """Places of the first occurrence of each id that is not in ``seen``; they are added to it."""
    out = []
    for i, x in enumerate(ids.tolist()):
        if x not in seen:
            seen.add(x)
            out.append(i)
    return np.array(out, dtype=np.int64)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
