"""Cross-tokenizer alignment by a cogroup of postings.

Every text is cut into tokens by a byte-level BPE (side A, which gets a space before the text) and by a piece BPE (side B).
Byte offsets where tokens of both sides end cut the tokens into groups; tokens of a group are linked with each other.
The count of an id pair is the number of documents that hold it linked.

1. Tokenising.  A task works on blocks of documents and writes one row a document and, for each A id of a block, one posting
   list: B ids, run lengths, documents and multiplicities, sorted by B id.
2. Counting.  Run lengths are summed by id pair, combined on the map side first; one row an A id holds its B ids and counts (at most
   as many as side B has pieces).
3. Cogroup.  Postings meet the counts of their A ids in streams sorted by A id: A ids are dealt to ``GROUPS`` groups, and a
   group with many postings is split by block, as often as needed for about ``TASK_POSTINGS`` a task; its counts go to every
   split.  A task holds one row of counts, one posting list and a bounded table of sums by document.
4. Sums by document.  All splits of a group see a document at most once, so that a document has at most
   ``GROUPS`` contributions whatever the size of the corpus; they travel as arrays by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpointed
from .piece_bpe import default_model

#: Groups that A ids are dealt to: the most contributions that a document has.
GROUPS = 64
#: Postings that a split of a group has, about.
TASK_POSTINGS = 4_000_000
#: Bytes of text in a block.
BLOCK_BYTES = 2 << 20
#: Documents whose sums a task holds before it gives them out.
HELD_DOCUMENTS = 1 << 20
#: B ids and places in a block take so many bits of a posting's key.
B_BITS, PLACE_BITS = 18, 24

#: Units that the table of a Python worker holds at most; it starts afresh when full.
UNITS = 300_000
#: Texts without other white space than single spaces and line feeds between other characters are cut there.
ODD = "[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z|[\\x09\\x0B-\\x0D\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{2581}]"
#: Groups of a text with more links than this are counted by distinct ids instead of link by link.
WIDE_LINKS = 256


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Aligner:
    """Both encoders with the bytes of their tokens.

    Side A is the byte-level BPE of a ``tokenizers`` file: its vocabulary, whose ids are the order of its merges, is run by
    ``tiktoken``, which knows no special tokens; texts that it refuses are left to ``tokenizers``.
    """

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(a_path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        added = set(self.tokenizer.get_added_tokens_decoder())
        ranks = {bytes(byte_of[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if i not in added}
        self.merges = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n_a, n_b = max(ranks.values()) + 1, self.pieces.get_piece_size()
        self.a_bytes, self.b_bytes = np.full(n_a, b"", dtype=object), np.full(n_b, b"", dtype=object)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        for i in range(n_b):
            piece = self.pieces.id_to_piece(i)
            if self.pieces.is_byte(i):
                self.b_bytes[i] = bytes([int(piece[1:-1], 16)])
            elif not (self.pieces.is_control(i) or self.pieces.is_unknown(i)):
                self.b_bytes[i] = piece.replace("\u2581", " ").encode()
        self.a_size, self.b_size = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        #: Text of an id within its group and at the end of its side of a group: A, then B from ``b_first``.
        self.b_first = 2 * n_a
        self.table = _Units(self)
        K.CACHES.append(self.table.clear)
        self.text = np.array([f"{i}{end}" for i in range(n_a) for end in ",|"] + [f"{i}{end}" for i in range(n_b) for end in ",;"], dtype=object)

    def a_ids(self, text: str) -> np.ndarray:
        try:
            return self.merges.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except Exception as e:  # what the pattern's engine refuses, as very long runs of white space
            if not isinstance(e, ValueError | RuntimeError | UnicodeError) and type(e).__name__ != "PanicException":
                raise
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides of a whole text; none if their bytes do not give it back."""
        whole = b" " + text.encode()
        b = np.array(self.pieces.encode(text, num_threads=1), dtype=np.int64)
        if b"".join(self.b_bytes[b].tolist()) != whole:
            return None
        a = self.a_ids(" " + text)
        return (a, b) if b"".join(self.a_bytes[a].tolist()) == whole else None

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray] | None]]:
        """(place, ids) of each text that is not empty; plain ones by their units."""
        column = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(column, ODD).to_numpy(zero_copy_only=False)
        full = [i for i, t in enumerate(texts) if t]
        where, rest = [i for i in full if not odd[i]], [i for i in full if odd[i]]
        words = pc.split_pattern(pc.replace_substring(column.take(pa.array(where, pa.int64())), "\n", " \n"), " ")
        bounds = words.offsets.to_numpy()
        coded = words.values.dictionary_encode()
        found = self.table.look_up(coded.dictionary.to_pylist(), coded.indices.to_numpy())
        if found is None:
            rest = sorted(rest + where)
        else:
            (a, at_a), (b, at_b) = ((ids, np.concatenate([[0], np.cumsum(n)])[bounds]) for ids, n in found)
            for k, i in enumerate(where):
                yield i, (a[at_a[k] : at_a[k + 1]], b[at_b[k] : at_b[k + 1]])
        for i in rest:
            yield i, self.ids(texts[i])

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Sums (n x 4), digests, and postings (codes, places, multiplicities) sorted by code and place, of a block's texts."""
        n = len(texts)
        sums, digests = np.zeros((n, 4), dtype=np.int64), [""] * n
        all_a, all_b, good = [], [], []
        for i, ids in self.encoded(texts):
            if ids is not None:
                good.append(i)
                all_a.append(ids[0])
                all_b.append(ids[1])
        none = np.zeros(0, dtype=np.int64)
        if not good:
            return sums, digests, none, none, none
        places = np.array(good)
        a, b = np.concatenate(all_a), np.concatenate(all_b)
        n_a, n_b = np.array([len(x) for x in all_a]), np.array([len(x) for x in all_b])
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        mark = np.zeros(int(ends_a[-1]) + 1, dtype=np.uint8)
        mark[ends_a] = 1
        mark[ends_b] += 2
        cuts = np.cumsum(mark == 3)  # every text ends with a cut
        group_a, group_b = cuts[ends_a - 1], cuts[ends_b - 1]
        n_groups = int(cuts[-1])
        wide_a, wide_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        upto_a, upto_b = np.concatenate([[0], np.cumsum(wide_a)]), np.concatenate([[0], np.cumsum(wide_b)])
        last = np.concatenate([[0], cuts[ends_a[np.cumsum(n_a) - 1]]])  # groups before each text, and all
        links = wide_a * wide_b
        upto_links = np.concatenate([[0], np.cumsum(links)])
        sums[places] = np.stack([n_a, n_b, np.diff(last), np.diff(upto_links[last])], axis=1)
        # Ids in the order of groups, A before B, each with the mark that follows it.
        out = np.empty(len(a) + len(b), dtype=np.int64)
        ends_group_a, ends_group_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        ends_group_a[upto_a[1:] - 1] = 1
        ends_group_b[upto_b[1:] - 1] = 1
        out[np.arange(len(a)) + upto_b[group_a]] = 2 * a + ends_group_a
        out[np.arange(len(b)) + upto_a[group_b + 1]] = self.b_first + 2 * b + ends_group_b
        edges = np.concatenate([[0], np.cumsum(n_a + n_b)])
        for k, i in enumerate(good):
            digests[i] = hashlib.sha256("".join(self.text[out[edges[k] : edges[k + 1]]].tolist())[:-1].encode()).hexdigest()
        # Links: of narrow groups one by one, of wide ones by distinct ids.
        place = np.repeat(places, np.diff(last))
        narrow = links <= WIDE_LINKS
        kept = np.flatnonzero(narrow[group_a])
        times = wide_b[group_a[kept]]
        left = np.repeat(kept, times)
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + upto_b[group_a[left]]
        key = (a[left] << B_BITS | b[right]) << PLACE_BITS | place[group_a[left]]
        keys, mults = np.unique(key, return_counts=True)
        wide = []
        for g in np.flatnonzero(~narrow).tolist():
            (x, m), (y, k) = (np.unique(ids[up[g] : up[g + 1]], return_counts=True) for ids, up in ((a, upto_a), (b, upto_b)))
            wide.append((((x[:, None] << B_BITS | y[None, :]) << PLACE_BITS | place[g]).ravel(), (m[:, None] * k[None, :]).ravel()))
        if wide:
            keys, at = np.unique(np.concatenate([keys, *[w[0] for w in wide]]), return_inverse=True)
            mults = np.bincount(at, weights=np.concatenate([mults, *[w[1] for w in wide]])).astype(np.int64)
        return sums, digests, keys >> PLACE_BITS, keys & ((1 << PLACE_BITS) - 1), mults


class _Units:
    """Ids of the units of plain texts: words with the space before them (kept without it) or with the line feed before them.

    No token of either side crosses a single space or line feed between two characters that are no white space, so that the ids of a text are
    those of its units.  New units are encoded together, as one text of their own.
    """

    def __init__(self, owner: Aligner):
        self.owner = owner
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = [np.zeros(0, dtype=np.int32)] * 2
        self.start = [np.zeros(1, dtype=np.int64)] * 2

    def look_up(self, units: list[str], used: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """(ids, number of ids of each unit) of both sides for ``units`` as ``used``; none if the bytes of new units do not come back."""
        if len(self.index) > UNITS:
            self.clear()
        index = self.index
        new = [u for u in units if u not in index]
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            if not self._add(new):
                self.clear()
                return None
        at = np.array([index[u] for u in units], dtype=np.int64)[used]
        out = []
        for flat, start in zip(self.flat, self.start, strict=True):
            n = (start[1:] - start[:-1])[at]
            ends = np.cumsum(n)
            out.append((flat[np.repeat(start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int64), n))
        return out

    def _add(self, new: list[str]) -> bool:
        o = self.owner
        words = [u if u[0] == "\n" else " " + u for u in new]
        # Texts of some hundred words, each after a full stop, as the piece encoder puts a space before a text.
        texts = ["." + "".join(words[lo : lo + 256]) for lo in range(0, len(words), 256)]
        heads = [len(x) for x in o.ids(".")]
        sides: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for text in texts:
            found = o.ids(text)
            if found is None:
                return False
            for side, head, ids in zip(sides, heads, found, strict=True):
                side.append(ids[head:])
        ends = np.cumsum([0, *[len(w.encode()) for w in words]])
        for side, (parts, size) in enumerate(zip(sides, (o.a_size, o.b_size), strict=True)):
            ids = np.concatenate(parts)
            cut = np.searchsorted(np.cumsum(size[ids]), ends, "right")
            self.flat[side] = np.concatenate([self.flat[side], ids.astype(np.int32)])
            self.start[side] = np.concatenate([self.start[side], self.start[side][-1] + cut[1:]])
        return True


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _tokenised(docs: DataFrame, text_col: str, id_col: str, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents (``a`` is null) and posting lists of blocks, written to the shared folder."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["block", "place", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "bs", "runs", "places", "mults"]
    schema = f"block bigint, place int, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a int, bs array<int>, runs array<int>, places array<int>, mults array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.trim()
        table, block = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = K.text_buffers(batch.column(1))
            for lo, hi, _, _ in K.chunks(np.zeros(0, dtype=np.uint8), offsets, BLOCK_BYTES):
                n = hi - lo
                sums, digests, code, doc, mult = table.block(batch.column(1).slice(lo, n).to_pylist())
                no_lists, no_kind = [pa.nulls(n, pa.list_(pa.int32()))] * 3, pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), batch.column(0).slice(lo, n), *[pa.array(sums[:, i]) for i in range(4)], pa.array(digests, pa.string()), pa.nulls(n, pa.int32()), *no_lists, no_kind], names=names,
                )
                if len(code):
                    runs = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))  # where a pair begins
                    pair = code[runs]
                    a = pair >> B_BITS
                    heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))  # where an A id begins
                    pair_bounds = np.concatenate([heads, [len(pair)]])
                    posting_bounds = np.concatenate([runs[heads], [len(code)]])
                    m = len(heads)
                    lists = [_lists(pair & ((1 << B_BITS) - 1), pair_bounds, pa.int32()), _lists(np.diff(np.concatenate([runs, [len(code)]])), pair_bounds, pa.int32()), _lists(doc, posting_bounds, pa.int32()), _lists(mult, posting_bounds, pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, block)), pa.nulls(m, pa.int32()), pa.nulls(m, batch.column(0).type), *[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.string()), pa.array(a[heads], pa.int32()), *lists], names=names,
                    )
                block += 1
        K.trim()

    return checkpointed(source.mapInArrow(run, schema))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by document of one task's stream, in which the counts of an A id come before its postings."""
    K.trim()
    held: dict[int, list[np.ndarray]] = {}
    documents = 0
    ids = counts = None
    most = 0
    for batch in batches:
        blocks = batch.column(0).to_pylist()
        columns = []
        for c in range(1, 5):
            column = batch.column(c)
            columns.append((column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)))
        (b_at, b_of), (r_at, r_of), (p_at, p_of), (m_at, m_of) = columns
        for i, block in enumerate(blocks):
            bs, runs = b_of[b_at[i] : b_at[i + 1]], r_of[r_at[i] : r_at[i + 1]]
            if block is None:  # the counts of the next A id
                ids, counts = bs.copy(), runs.astype(np.int64)
                most = counts.max()
                continue
            count = counts[np.searchsorted(ids, bs)]
            places, mult = p_of[p_at[i] : p_at[i + 1]], m_of[m_at[i] : m_at[i + 1]]
            each = np.repeat(count, runs)
            size = int(places.max()) + 1
            sums = held.get(block)
            if sums is None or len(sums[0]) < size:
                grown = [np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)]
                if sums is not None:
                    for new, old in zip(grown, sums, strict=True):
                        new[: len(old)] = old
                documents += size - (0 if sums is None else len(sums[0]))
                sums = held[block] = grown
            np.add.at(sums[0], places, np.where(each == most, mult, 0))
            np.add.at(sums[1], places, mult * each)
        if documents > HELD_DOCUMENTS:
            yield from _given_out(held)
            held, documents = {}, 0
    yield from _given_out(held)
    K.trim()


def _given_out(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    blocks = list(held)
    for lo in range(0, len(blocks), 64):
        some = blocks[lo : lo + 64]
        bounds = np.concatenate([[0], np.cumsum([len(held[b][0]) for b in some])])
        lists = [_lists(np.concatenate([held[b][k] for b in some]), bounds, pa.int64()) for k in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *lists], names=["block", "best", "total"])


def _summed(parts: pa.Table) -> pa.Table:
    """Sums of a block's documents from the arrays of its splits."""
    totals = [np.zeros(0, dtype=np.int64)] * 2
    for k, name in enumerate(("best", "total")):
        for piece in parts.column(name).chunks:
            for row in piece:
                values = row.values.to_numpy()
                if len(values) > len(totals[k]):
                    totals[k] = np.concatenate([totals[k], np.zeros(len(values) - len(totals[k]), dtype=np.int64)])
                totals[k][: len(values)] += values
    n = len(totals[0])
    return pa.table({"block": pa.array(np.full(n, parts.column("block")[0].as_py())), "place": pa.array(np.arange(n, dtype=np.int32)), "n_best": pa.array(totals[0]), "count_sum": pa.array(totals[1])})


def align(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    ``n_best`` counts the links whose pair has the highest count of its A id (ties included), ``count_sum`` adds the pairs' counts over
    links.  A text that is null or empty, or that tokens do not give back byte for byte (as one with U+2581), has no tokens: zeros and
    an empty ``groups_sha256``.  Rows that repeat, or share an id or have none, are documents of their own;
    an empty table gives an empty one; other columns are not read.  The tokenised table is written to the shared folder, so a lost executor costs
    its tasks alone.
    """
    made = _tokenised(docs, text_col, id_col, a_path or byte_bpe_path(), b_path or default_model())
    postings = made.filter(F.col("a").isNotNull()).select("block", "a", "bs", "runs", "places", "mults")
    group = F.pmod(F.hash("a"), F.lit(GROUPS))
    split_of = {g: max(1, -(-n // TASK_POSTINGS)) for g, n in postings.groupBy(group.alias("g")).agg(F.sum(F.size("places")).alias("n")).collect()}  # GROUPS rows at most
    splits = F.element_at(F.array(*[F.lit(split_of.get(g, 1)) for g in range(GROUPS)]), group + 1)
    pairs = postings.select("a", F.explode(F.arrays_zip("bs", "runs")).alias("p")).groupBy("a", F.col("p.bs").alias("b")).agg(F.sum(F.col("p.runs").cast("bigint")).alias("n"))
    counts = pairs.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", F.col("n").cast("int").alias("n")))).alias("p"))
    header = counts.select(
        F.lit(None).cast("bigint").alias("block"), F.col("p.b").alias("bs"), F.col("p.n").alias("runs"), F.array().cast("array<int>").alias("places"), F.array().cast("array<bigint>").alias("mults"),
        "a", F.explode(F.sequence(F.lit(0), splits - 1)).alias("s"),
    )
    stream = header.unionByName(postings.withColumn("s", F.pmod(F.hash("block"), splits))).withColumn("g", group)
    sorted_stream = stream.repartition("g", "s").sortWithinPartitions("g", "s", "a", F.col("block").asc_nulls_first())
    parts = sorted_stream.select("block", "bs", "runs", "places", "mults").mapInArrow(_contributions, "block bigint, best array<bigint>, total array<bigint>")
    summed = parts.groupBy("block").applyInArrow(_summed, "block bigint, place int, n_best bigint, count_sum bigint")
    rows = made.filter(F.col("a").isNull()).drop("a", "bs", "runs", "places", "mults")
    out = rows.join(summed, ["block", "place"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
