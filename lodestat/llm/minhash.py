"""MinHash near-duplicates by a signature-coordinate inverted join.

A document is posted under each pair of signature coordinate and value.  Two documents whose sets are alike
share at least MATCHES of the COORDINATES values, so they meet in all but MATCHES - 1 of either's values, the rarest
first (prefix); documents without that many shared values are skipped.  Collisions are counted
over whole signatures and pairs with MATCHES or more retained; they form families, in which
links are confirmed on the full shingle sets.  A family of one block is compared whole in a task.  The blocks of a
larger one are compared each within itself and with the family's pivots; what is then outside the family's largest component
is compared with all its blocks.  Only spanning links are given out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpointed, small_or_shuffled
from .graph import components, joined, link_lists

COORDINATES = 48
#: Of COORDINATES values, pairs at the similarity bound share fewer than this with probability below 1e-5.
MATCHES = 24
#: Bounds on the documents and shingles of a block in which sets are compared.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_000_000
#: Sets of a large family that are compared with all its blocks.
PIVOTS = 48
_RNG = np.random.default_rng(20240229)
MULTIPLIERS = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def text_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and n+1 bounds."""
    starts, ends, bounds = K.words(data, offsets)
    low = K.ASCII_LOWER[data]
    hashes, at = K.shingles(K.span_hash(K.prefix_hash(low), starts, ends), bounds, size)
    sets = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    return (np.concatenate(sets) if sets else hashes), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """texts x COORDINATES table of 32-bit minima; texts without shingles have the greatest value."""
    out = np.empty((len(bounds) - 1, COORDINATES), dtype=np.uint32)
    for k in range(COORDINATES):
        out[:, k] = K.segment_min(((hashes * MULTIPLIERS[k] + SHIFTS[k]) >> np.uint64(32)).astype(np.uint32), bounds, 2**32 - 1)
    return out


LOW = tuple(f"low{i}" for i in range(COORDINATES // 16))


def low_bits(sig: np.ndarray) -> list[np.ndarray]:
    """The lowest four bits of sixteen coordinates at a time, packed into one word."""
    shifts = np.arange(0, 64, 4, dtype=np.uint64)
    return [((sig[:, i : i + 16].astype(np.uint64) & np.uint64(15)) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64) for i in range(0, COORDINATES, 16)]


def may_agree(a: str, b: str) -> Column:
    """Whether the lowest bits of at least MATCHES coordinates agree, as they do where the values themselves do."""
    terms = []
    for low in LOW:
        x = f"({low}{a} ^ {low}{b})"
        terms.append(f"16 - bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L)")
    return F.expr(f"{' + '.join(terms)} >= {MATCHES}")


def digests(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each set."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(K.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return K.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc, n, node, sig, low0..low2): number of shingles, digest of the set, signature, and its values' lowest four bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for lo, hi, part, off in K.chunks(data, offsets):
                hashes, bounds = text_shingles(part, off, size)
                sig = signatures(hashes, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(digests(hashes, bounds)), _binary(sig.ravel(), np.arange(hi - lo + 1) * COORDINATES), *[pa.array(x) for x in low_bits(sig)]], names=["doc", "n", "node", "sig", *LOW])

    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc {source.schema['doc'].dataType.simpleString()}, n bigint, node bigint, sig binary, " + ", ".join(f"{x} bigint" for x in LOW))


def families(classes: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(node, component) of sets that could be linked: all linked sets are in one component."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = (np.arange(coordinates, dtype=np.int64) + 1) << 32
        for batch in batches:
            n = batch.num_rows
            if n:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(n, coordinates)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), coordinates)), pa.array((sig.astype(np.int64) | high).ravel())], names=["id", "key"])

    posts = classes.select("node", "sig").mapInArrow(keys, "id bigint, key bigint")
    shared = posts.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    by_doc = posts.join(shared, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("x"))  # at most `coordinates` entries
    prefix = by_doc.filter(F.size("x") >= matches).select("id", F.explode(F.expr(f"slice(x, 1, size(x) - {matches - 1})")).alias("e"))
    chosen = prefix.select(F.col("e.key").alias("key"), "id", F.lit(True).alias("own"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(n, coordinates) for i in (2, 3))
                yield batch.filter(pa.array((a == b).sum(axis=1) >= matches)).select([0, 1])

    def test(pairs: DataFrame, known: DataFrame) -> DataFrame:
        sig_a, sig_b = (known.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
        return pairs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(agree, "a bigint, b bigint")

    return link_lists(chosen, test, lambda ids: classes.withColumnRenamed("node", "id"), may_agree, LOW)


def _firsts(labels: np.ndarray) -> np.ndarray:
    """For each place the first place with the same label."""
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    return first[inverse]


def spanning_links(nodes: np.ndarray, sets: list[np.ndarray], percent: int, comps: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the given sets, each confirmed on the sets themselves.

    Sets of one known component in ``comps`` are taken as linked.
    """
    n = len(nodes)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if n < 2:
        return []
    if n <= 24:
        common = np.zeros((n, n), dtype=np.int64)
        for i in range(n):
            for j in range(i + 1, n):
                if 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                    common[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        whole, row = np.concatenate(sets), np.repeat(np.arange(n), size)
        kinds, inverse, count = np.unique(whole, return_inverse=True, return_counts=True)
        column = np.full(len(kinds), -1, dtype=np.int64)
        column[count > 1] = np.arange((count > 1).sum())
        at = column[inverse]
        row, at = row[at >= 0], at[at >= 0]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        inter = np.zeros((n, n), dtype=np.float32)  # counts below 2**24 are exact
        step = max(64, (4 << 20) // n)
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, step):
            here = slice(*np.searchsorted(at, [lo, lo + step]))
            x = np.zeros((n, step), dtype=np.float32)
            x[row[here], at[here] - lo] = 1.0
            inter += x @ x.T
        common = np.triu(inter, 1).astype(np.int64)
    union = size[:, None] + size[None, :] - common
    root = np.arange(n) if comps is None else _firsts(comps)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*np.nonzero((common > 0) & (100 * common >= percent * union)), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(nodes, their sets, their components) of each block, from rows sorted by block and node."""
    key, nodes, kept, comps = None, [], [], []
    for batch in batches:
        for fam, i, j, node, hashes, comp in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (fam, i, j) != key:
                if nodes:
                    yield np.array(nodes), kept, np.array(comps)
                key, nodes, kept, comps = (fam, i, j), [], [], []
            if not nodes or nodes[-1] != node:  # else a repeated text of a class, or a node placed twice
                nodes.append(node)
                kept.append(np.frombuffer(hashes, dtype=np.uint64))
                comps.append(comp)
    if nodes:
        yield np.array(nodes), kept, np.array(comps)


def _apart(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(node, fam, i, j, comp): places of members outside their family's largest component beside all others.

    They are dealt to groups of a block's size; each is placed with every block, and every block with each group.
    """
    large = members.filter("blocks > 1").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    most = large.groupBy("fam", "comp").agg(F.count("*").alias("c")).groupBy("fam").agg(F.max(F.struct("c", "comp")).alias("most"))
    large = large.join(most, "fam").withColumn("out", F.col("comp") != F.col("most.comp"))
    groups = large.filter("out").groupBy("fam").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("groups"))
    large = large.join(groups, "fam")
    inside = large.select("node", "fam", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("j"), "comp")
    outside = large.filter("out").select("node", "fam", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64(F.lit(5), "node"), F.col("groups")).cast("int").alias("j"), "comp")
    return inside.unionByName(outside)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked where 100 * intersection >= percent * union of their sets of ``size``-word shingles
    (words lower-cased in A-Z; with fewer words the whole sequence is one shingle).  ``component_id`` is the least id
    reachable by links, and ``kept`` marks the document that has it.  Texts that are null or without words are linked
    with nothing.  Equal sets are one class throughout, so copies are never paired.  Repeated rows get equal rows, a
    null id counts as greater than all others, and an empty table gives an empty one.
    """
    rows = checkpointed(sketches(docs, id_col, text_col, size))
    full = rows.filter("n > 0")
    classes = checkpointed(full.groupBy("node").agg(F.min("doc").alias("rep"), F.min("n").alias("n"), F.first("sig").alias("sig"), *[F.min(x).alias(x) for x in LOW]))
    family = checkpointed(families(classes))

    members = family.withColumnRenamed("component", "fam").join(classes.select("node", "rep", "n"), "node")
    sizes = members.groupBy("fam").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    sizes = sizes.select("fam", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = checkpointed(members.join(sizes, "fam").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0))
            for _, _, part, off in K.chunks(data, offsets):
                hashes, bounds = text_shingles(part, off, size)
                yield pa.RecordBatch.from_arrays([pa.array(digests(hashes, bounds)), _binary(hashes, bounds)], names=["node", "hashes"])

    def sets_of(reps: DataFrame) -> DataFrame:
        """(node, hashes) of the texts with the given ids, once for each text."""
        few = small_or_shuffled(reps.select("rep").distinct(), wide)
        texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("t")).join(few, F.col("doc").eqNullSafe(F.col("rep")), "left_semi")
        return texts.select("t").mapInArrow(sets, "node bigint, hashes binary")

    wide = 16
    if docs.schema[id_col].dataType.typeName() in ("string", "binary", "struct", "array", "map"):  # of any length
        wide += classes.agg(F.max(F.octet_length(F.col("rep").cast("string")))).first()[0] or 0
    seat = F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(PIVOTS)).alias("seat")
    pivots = members.filter("blocks > 1").groupBy("fam", seat).agg(F.min(F.struct(F.xxhash64(F.lit(8), "node").alias("h"), "node", "blocks")).alias("c"))
    pivots = pivots.select("c.node", "fam", F.explode(F.sequence(F.lit(0), F.col("c.blocks") - 1)).alias("i"))
    whole = members.select("node", "fam", F.col("block").alias("i")).unionByName(pivots)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, kept, known in _blocks(batches):
            links = spanning_links(nodes, kept, percent, known)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def confirmed(place: DataFrame, reps: DataFrame) -> DataFrame:
        tasks = sets_of(reps).join(small_or_shuffled(checkpointed(place), 48), "node").repartition("fam", "i", "j").sortWithinPartitions("fam", "i", "j", "node")
        return tasks.select("fam", "i", "j", "node", "hashes", "comp").mapInArrow(confirm, "a bigint, b bigint")

    comps = checkpointed(components(confirmed(whole.withColumns({"j": F.lit(0), "comp": F.col("node")}), members)))
    apart = checkpointed(_apart(members, comps))
    if not apart.isEmpty():
        comps = joined(comps, confirmed(apart, members.join(apart.select("fam").distinct(), "fam", "left_semi")))
    named = classes.select("node", "rep").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    out = full.select("doc", "n", "node").join(named, "node").select("doc", "n", "component_id")
    out = out.unionAll(rows.filter("n = 0").select("doc", "n", F.col("doc").alias("component_id")))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates, the first by id (null last) and then by row hash.

    Decisions are on rows: each has its id and a 64-bit hash of all its columns, so that null and repeated ids are told apart.
    Of equal rows one stays.  Texts that are null or without words are linked with nothing, and all stay.
    """
    mark = F.xxhash64(*[x for c in docs.columns for x in (F.col(c), F.col(c).isNull())])
    rows = docs.withColumn("__g_mark", mark)
    named = rows.select(F.struct(F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"), F.col("__g_mark").alias("mark")).alias("__g_row"), F.col(text_col).alias("__g_text"))
    found = near_duplicates(named, "__g_row", "__g_text", size, percent).filter("n_shingles > 0")
    odd = found.groupBy(F.col("__g_row.mark").alias("__g_mark")).agg((~F.max("kept")).alias("gone"), F.count("*").alias("n")).filter("gone OR n > 1")
    odd = checkpointed(odd.select("__g_mark", "gone"))
    again = odd.filter("NOT gone").select("__g_mark")
    out = rows.join(small_or_shuffled(odd.select("__g_mark"), 16), "__g_mark", "left_anti")
    if not again.isEmpty():
        out = out.unionByName(rows.join(small_or_shuffled(again, 16), "__g_mark", "left_semi").dropDuplicates(["__g_mark"]))
    return out.select(*docs.columns)
