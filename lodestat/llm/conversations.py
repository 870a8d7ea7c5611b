"""Repair of conversation structure by least-cost edits.

Turns of a conversation are edited until the initials of their roles follow ``(s?(ua)+)?``: Keep (cost 0), Rerole to user or assistant (3), Delete (4,
required for blank and repeated turns), Insert an empty turn of user or assistant anywhere (3); a truncated turn that is not deleted adds 3.
The audit is the string of the edits' initials; of the cheapest edits the one with the ASCII-least audit is taken.

The search is Dijkstra's on the implicit lattice of nodes (turn index, grammar state), with the priority key (cost, audit), and stops at the
first accepting end node that is popped.  Two paths of equal cost to one node never have audits of which one begins the
other, as what it lacks would be inserted turns, which cost; so the key orders extensions as it orders paths.

Conversations of any length: rows are dealt by ranges of (conversation, turn, role, text), so a long conversation lies in many
tasks.  A stretch of ``LAYERS`` layers turns into one layer whose edges are the least keys from each state to each other, found by the
same search; the ends of a range give such a layer, and one small task a conversation searches the layers of its ranges.  Last, texts
are streamed behind their audit, sorted by Spark with spilling, so that a task holds one audit (a character a turn) and one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.  Moves by initial.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = frozenset((0, 3))
LEGAL = frozenset(("su", "ua", "au"))
#: Layers that one search goes over; more are drawn together first.
LAYERS = 64
BLANK, DUPLICATE, CUT_OFF, SOUND = "b", "d", "t", "-"

#: A row: initial of its role, fault of its first copy, number of adjacent equal copies.
Row = tuple[str, str, int]
#: Edges of a layer by state: (next state, cost, initials of the edits).
Layer = tuple[tuple[tuple[int, int, str], ...], ...]


@lru_cache(maxsize=4096)
def row_layer(row: Row) -> Layer:
    """Edges of one row and its further copies, which have to go."""
    initial, fault, copies = row
    out = []
    for state in range(4):
        edges = [(state, DELETE * copies, "D" * copies)]
        if fault in (SOUND, CUT_OFF):
            extra, rest = (TRUNCATED if fault == CUT_OFF else 0) + DELETE * (copies - 1), "D" * (copies - 1)
            if initial in MOVES[state]:
                edges.append((MOVES[state][initial], KEEP + extra, "K" + rest))
            edges += [(MOVES[state][role], REROLE + extra, "R" + rest) for role in "ua" if role in MOVES[state]]
        out.append(tuple(edges))
    return tuple(out)


def search(layers: list[Layer], start: int, wanted: frozenset[int], every: bool) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) from ``start`` to the first popped state of ``wanted`` behind the last layer, or to every one of them."""
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    end = len(layers)
    while heap:
        cost, audit, at, state = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == end and state in wanted:
            found[state] = cost, audit
            if not every or len(found) == len(wanted):
                break
        for target in set(MOVES[state].values()) - {1}:
            if (at, target) not in done:
                heappush(heap, (cost + INSERT, audit + "I", at, target))
        if at < end:
            for target, price, letters in layers[at][state]:
                if (at + 1, target) not in done:
                    heappush(heap, (cost + price, audit + letters, at + 1, target))
    return found


def drawn_together(layers: list[Layer]) -> Layer:
    """One layer with the least edges of many, stretch by stretch."""
    while len(layers) > LAYERS:
        layers = [drawn_together(layers[lo : lo + LAYERS]) for lo in range(0, len(layers), LAYERS)]
    every = frozenset(range(4))
    return tuple(tuple((target, cost, letters) for target, (cost, letters) in sorted(search(layers, state, every, True).items())) for state in range(4))


def cheapest(layers: list[Layer]) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    while len(layers) > LAYERS:
        layers = [drawn_together(layers[lo : lo + LAYERS]) for lo in range(0, len(layers), LAYERS)]
    return next(iter(search(layers, 0, ACCEPTING, False).values()))


@lru_cache(maxsize=1 << 14)
def _short(rows: tuple[Row, ...]) -> tuple[int, str]:
    return cheapest([row_layer(r) for r in rows])


class _Stretch:
    """Rows of one conversation in one range, drawn together as they come."""

    def __init__(self, conversation: object, at: int):
        self.id, self.at = conversation, at
        self.rows: list[Row] = []
        self.layers: list[Layer] = []
        self.illegal, self.first, self.last = 0, None, None

    def add(self, row: Row) -> None:
        if self.first is None:
            self.first = row[0]
        elif self.last + row[0] not in LEGAL:
            self.illegal += 1
        self.illegal += (row[2] - 1) * (row[0] + row[0] not in LEGAL)
        self.last = row[0]
        self.rows.append(row)
        if len(self.rows) > LAYERS:
            self.layers.append(drawn_together([row_layer(r) for r in self.rows[:LAYERS]]))
            self.rows = self.rows[LAYERS:]

    def all_layers(self) -> list[Layer]:
        return self.layers + [row_layer(r) for r in self.rows]

    def record(self, whole: bool) -> tuple:
        if whole:
            cost, audit = _short(tuple(self.rows)) if not self.layers else cheapest(self.all_layers())
            return self.id, self.at, True, cost, audit, self.illegal, "", "", []
        edges = [{"from": s, "to": t, "cost": c, "letters": x} for s, out in enumerate(drawn_together(self.all_layers())) for t, c, x in out]
        return self.id, self.at, False, 0, "", self.illegal, self.first, self.last, edges


def _plan_schema(kind: str) -> str:
    return f"id {kind}, at int, whole boolean, cost bigint, audit string, illegal bigint, first string, last string, edges array<struct<from:int,to:int,cost:bigint,letters:string>>"


def _records(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    edge = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])
    fields = [("id", kind), ("at", pa.int32()), ("whole", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("edges", pa.list_(edge))]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solved conversations of a range; those at its ends, which may go on elsewhere, as layers."""
    at, now, outside, kind = TaskContext.get().partitionId(), None, True, None
    out: list[tuple] = []
    for batch in batches:
        kind = batch.column(0).type
        for conversation, initial, fault, copies in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if now is None or conversation != now.id:
                if now is not None:
                    out.append(now.record(whole=not outside))
                    outside = False
                now = _Stretch(conversation, at)
            now.add((initial, fault, copies))
        if len(out) >= 1000:
            yield _records(out, kind)
            out = []
    if now is not None:
        out.append(now.record(whole=False))
        yield _records(out, kind)


def _joined(table: pa.Table) -> pa.Table:
    """One conversation from its layers in several ranges."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    layers, illegal = [], sum(r["illegal"] for r in rows)
    for r in rows:
        layers.append(tuple(tuple((e["to"], e["cost"], e["letters"]) for e in r["edges"] if e["from"] == s) for s in range(4)))
    illegal += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = cheapest(layers)
    return pa.table({"id": table.column("id").slice(0, 1), "cost": pa.array([cost], pa.int64()), "audit": pa.array([audit]), "illegal": pa.array([illegal], pa.int64())})


def replayed(audit: str) -> Callable[[str, str, int], Iterator[tuple[str, str, str]]]:
    """A function of (role, text, copies) that gives the (edit, role, text) up to and with those copies; None as role ends it."""
    at, state = 0, 0

    def put(letter: str, role: str | None, text: str) -> tuple[str, str, str]:
        nonlocal state
        role = role if role is not None else ("user" if "u" in MOVES[state] else "assistant")
        state = MOVES[state][role[:1]]
        return letter, role, text

    def step(role: str | None, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        nonlocal at
        while at < len(audit) and (copies or role is None):
            letter = audit[at]
            at += 1
            if letter == "I":
                yield put("I", None, "")
                continue
            copies -= 1
            if letter != "D":
                yield put(letter, role if letter == "K" else None, text)

    return step


def coded(rows: DataFrame) -> DataFrame:
    """Equal rows together, with ``initial``, ``fault`` of the first copy and ``copies``; from (id, turn, role, text, times)."""
    equal = rows.filter(F.col("times") > 0).groupBy("id", "turn", "role", "text").agg(F.sum("times").cast("bigint").alias("copies"))
    equal = equal.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = equal.groupBy(F.col("id").alias("f_id"), F.col("digest").alias("f_digest")).agg(F.min(F.struct(F.col("turn").alias("t"))).alias("f"))
    joined = equal.join(first, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest")))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(~F.col("turn").eqNullSafe(F.col("f.t")), DUPLICATE).when(~whole, CUT_OFF).otherwise(SOUND)
    return joined.select("id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "copies")


def _plans(made: DataFrame) -> DataFrame:
    """(id, cost, audit, illegal) of each conversation that has rows."""
    kind = made.schema["id"].dataType.simpleString()
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    ranges = made.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "initial", "fault", "copies")
    found = checkpointed(ranges.mapInArrow(_stretches, _plan_schema(kind)))
    whole = found.filter("whole").select("id", "cost", "audit", "illegal")
    return whole.unionByName(found.filter("NOT whole").groupBy("id").applyInArrow(_joined, f"id {kind}, cost bigint, audit string, illegal bigint"))


def _headers(rows: DataFrame, made: DataFrame) -> DataFrame:
    """One row for each id of ``rows``: counts of faults, gaps and the plan."""
    there = F.when(F.col("times") > 0, F.col("turn"))
    span = F.coalesce((F.max(there) - F.min(there) + 1 - F.countDistinct(there)).cast("bigint"), F.lit(0).cast("bigint"))
    count = lambda fault, n: F.sum(F.when(F.col("fault") == fault, n).otherwise(0)).cast("bigint")
    # Further copies of a row that is not blank are duplicates.
    again = F.sum(F.when(F.col("fault").isin(SOUND, CUT_OFF), F.col("copies") - 1).when(F.col("fault") == DUPLICATE, F.col("copies")).otherwise(0)).cast("bigint")
    faults = made.groupBy(F.col("id").alias("f_id")).agg(count(BLANK, F.col("copies")).alias("blank"), again.alias("duplicate"), count(CUT_OFF, F.lit(1)).alias("truncated"))
    plans = _plans(made).withColumnRenamed("id", "p_id")
    out = rows.groupBy("id").agg(span.alias("gaps")).join(faults, F.col("id").eqNullSafe(F.col("f_id")), "left").join(plans, F.col("id").eqNullSafe(F.col("p_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("id", "gaps", *zero, F.coalesce("audit", F.lit("")).alias("audit"))


def _streamed(headers: DataFrame, made: DataFrame) -> DataFrame:
    """Headers, each before the rows of its conversation in order."""
    nothing = [F.lit(None).cast(made.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "copies")]
    plans = headers.select("*", *nothing, F.lit(0).alias("kind"))
    rest = [F.lit(None).cast(headers.schema[c].dataType).alias(c) for c in headers.columns[1:]]
    rows = made.select("id", *rest, "turn", "role", "text", "copies", F.lit(1).alias("kind"))
    return plans.unionByName(rows).repartition("id").sortWithinPartitions(F.col("id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "text").drop("turn")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The header of each conversation with the digest of its repaired turns."""
    header, step, digest, begun = None, None, None, False
    out: list[tuple] = []
    schema = None

    def take(turns: Iterator[tuple[str, str, str]]) -> None:
        nonlocal begun
        for _, role, text in turns:
            digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
            begun = True

    def closed() -> tuple:
        take(step(None, "", 0))
        return (*header, digest.hexdigest())

    for batch in batches:
        schema = schema or pa.schema([*(batch.schema.field(i) for i in range(8)), pa.field("repaired_sha256", pa.string())])
        for values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            *plan, role, text, copies, kind = values
            if kind == 0:
                if header is not None:
                    out.append(closed())
                header, step, digest, begun = plan, replayed(plan[7]), hashlib.sha256(), False
            else:
                take(step(role, text, copies))
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if header is not None:
        out.append(closed())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns themselves."""
    conversation = step = kind = None
    place = 0
    out: list[tuple] = []
    names = ["id", "place", "edit", "role", "text"]

    def take(turns: Iterator[tuple[str, str, str]]) -> None:
        nonlocal place
        for turn in turns:
            out.append((conversation, place, *turn))
            place += 1

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], names=names)

    for batch in batches:
        kind = batch.column(0).type
        at = {n: i for i, n in enumerate(batch.schema.names)}
        for i, row, audit, role, text, copies in zip(*(batch.column(at[n]).to_pylist() for n in ("id", "kind", "audit", "role", "text", "copies")), strict=True):
            if row == 0:
                if step is not None:
                    take(step(None, "", 0))
                conversation, step, place = i, replayed(audit), 0
            else:
                take(step(role, text, copies))
        if out:
            yield batch_of()
            out = []
    if step is not None:
        take(step(None, "", 0))
        if out:
            yield batch_of()


def _plain(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, times: Column | None) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(conv_col).alias("id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), (F.lit(1) if times is None else times).alias("times"))


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times: Column | None = None) -> DataFrame:
    """One row a conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``.

    Turns stand in the order of turn (nulls first), then role and text.  A row counts ``times`` times, next to each other;
    a conversation all of whose rows count 0 times has zeros, the empty audit and the digest of the empty text.  Null roles and texts are one
    space, so null texts are blank; rows without an id are one conversation; equal rows are duplicates of each other;
    other columns are not read; an empty table gives an empty one.
    """
    rows = _plain(conversations, conv_col, turn_col, role_col, text_col, times)
    made = checkpointed(coded(rows))
    stream = _streamed(_headers(rows, made), made)
    kind = made.schema["id"].dataType.simpleString()
    found = stream.mapInArrow(_digests, f"id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
    return found.withColumnRenamed("id", conv_col)


def repaired_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times: Column | None = None) -> DataFrame:
    """The turns of the repaired conversations: id, ``place`` from 0, ``edit`` (K, R or I), ``role`` and ``text``; edges as in ``repair``."""
    rows = _plain(conversations, conv_col, turn_col, role_col, text_col, times)
    made = checkpointed(coded(rows))
    kind = made.schema["id"].dataType.simpleString()
    return _streamed(_headers(rows, made), made).mapInArrow(_turns, f"id {kind}, place bigint, edit string, role string, text string").withColumnRenamed("id", conv_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) with every twentieth row each dropped, emptied, robbed of its ends, repeated or given to user, by crc32 of ``conv_id:turn``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(text("role")).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"), F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("times"),
    )
