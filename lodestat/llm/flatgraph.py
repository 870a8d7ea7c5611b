"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors are dealt to overlapping cluster shards, each to the nearest few of the centroids.  Every shard builds a graph whose
neighbour lists are thinned by robust pruning (Subramanya et al., DiskANN, 2019); the lists of a vector's shards are
united.  From a shard's medoids each of its vectors then searches the united graph: greedily until it is among its nearest, and
on over every neighbour within the similarity range.  Found pairs are verified in double precision.
A bounded sample of vectors is compared with all others to audit recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpointed, small_or_shuffled
from .graph import components

#: Shards a vector belongs to, vectors aimed at in a shard, and most in a block of one.
OVERLAP, SHARD, BLOCK = 3, 512, 1536
#: Centroids are fitted on at most SAMPLE vectors; there are MAX_SHARDS at most.
SAMPLE, MAX_SHARDS = 20_000, 4096
DEGREE, ALPHA, MEDOIDS, BEAM = 32, 1.5, 32, 12
#: Slack of the single-precision search below the bound.
SLACK = 1e-4
AUDIT = 64
U64 = np.uint64


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec, node, unit): hash of the direction and its float64 coordinates; both null where there is none.

    Vectors that are null, empty or zero, or hold null or non-finite components, have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, units = [], []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], dtype=np.float64) if v else np.zeros(0)
                top = np.abs(x).max(initial=0.0)
                if not np.isfinite(top) or top == 0.0 or np.isnan(x).any():
                    nodes.append(None)
                    units.append(None)
                    continue
                x = x / top
                x = x / np.sqrt(x @ x) + 0.0
                nodes.append(int(K.mix((x.view(U64) * K.powers(K.BASE, len(x) + 1)[1:]).sum(dtype=U64, keepdims=True) + U64(len(x))).view(np.int64)[0]))
                units.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(units, pa.binary())], names=["vec", "node", "unit"])

    source = vectors.select(F.col(id_col).alias("vec"), F.col(vector_col).alias("v"))
    return source.mapInArrow(run, f"vec {source.schema['vec'].dataType.simpleString()}, node bigint, unit binary")


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of a bounded sample by spherical k-means."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    at = sample[np.sort(rng.choice(len(sample), k, replace=False))]
    for _ in range(rounds):
        owner = np.concatenate([(sample[i : i + 4096] @ at.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(k + 1))
        for c in range(k):
            if cuts[c + 1] > cuts[c]:
                total = sample[order[cuts[c] : cuts[c + 1]]].sum(axis=0)
                norm = np.linalg.norm(total)
                if norm > 0:
                    at[c] = total / norm
    return at


def medoids(x: np.ndarray, count: int) -> np.ndarray:
    """The point nearest to the mean, then one by one the point farthest from those chosen."""
    first = int((x @ x.mean(axis=0)).argmax())
    chosen, near = [first], x @ x[first]
    while len(chosen) < min(count, len(x)):
        nxt = int(near.argmin())
        chosen.append(nxt)
        near = np.maximum(near, x @ x[nxt])
    return np.array(chosen)


def robust_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbour lists of a block: of all its vectors, nearest first, those no neighbour so far is much nearer to.

    Reverse edges are added to a list until it has twice the degree.
    """
    n = len(x)
    if n == 1:
        return [np.zeros(0, dtype=np.int64)]
    sims = x @ x.T
    np.fill_diagonal(sims, 1.0)
    open_ = sims.copy()
    np.fill_diagonal(open_, -2.0)
    away = 1.0 - sims
    picked = np.full((n, degree), -1, dtype=np.int64)
    rows = np.arange(n)
    for d in range(degree):
        pick = open_.argmax(axis=1)
        some = open_[rows, pick] > -2.0
        if not some.any():
            break
        picked[some, d] = pick[some]
        live = rows[some]
        gone = alpha * away[pick[live]] <= away[live]
        gone[np.arange(len(live)), pick[live]] = True
        open_[live] = np.where(gone, np.float32(-2.0), open_[live])
    src, dst = np.repeat(rows, degree), picked.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    lists = [row[row >= 0] for row in picked]
    order = np.lexsort((away[src, dst], dst))
    src, dst = src[order], dst[order]
    cuts = np.searchsorted(dst, np.arange(n + 1))
    for i in range(n):
        back = np.setdiff1d(src[cuts[i] : cuts[i + 1]][: 2 * degree], lists[i])
        lists[i] = np.concatenate([lists[i], back])[: 2 * degree]
    return lists


def range_search(x: np.ndarray, adjacency: np.ndarray, entry: np.ndarray, bound: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) rows of all pairs that the search meets with similarity >= bound; every row of x is a query.

    ``adjacency`` has one row of neighbours for each vector, padded by -1.
    """
    n = len(x)
    entry = np.unique(entry)
    start = x @ x[entry].T
    take = min(beam, len(entry))
    best = np.argsort(-start, axis=1, kind="stable")[:, :take]
    ids, score = entry[best], np.take_along_axis(start, best, axis=1)
    visited = np.zeros((n, n), dtype=bool)
    visited[:, entry] = True
    open_ = np.ones(ids.shape, dtype=bool)
    found = [(lambda q, e: (q, entry[e]))(*np.nonzero(start >= bound))]
    active = np.arange(n)
    while len(active):
        at = np.where(open_[active], score[active], -3.0).argmax(axis=1)
        some = open_[active, at]
        active, at = active[some], at[some]
        if not len(active):
            break
        open_[active, at] = False
        near = adjacency[ids[active, at]]
        fresh = (near >= 0) & ~visited[active[:, None], near]
        q, slot = np.nonzero(fresh)
        node = near[q, slot]
        visited[active[q], node] = True
        value = np.full(near.shape, -3.0, dtype=x.dtype)
        for lo in range(0, len(q), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            value[q[s], slot[s]] = np.einsum("ij,ij->i", x[active[q[s]]], x[node[s]])
        hit = value[q, slot] >= bound
        found.append((active[q[hit]], node[hit]))
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_score = np.concatenate([score[active], value], axis=1)
        all_open = np.concatenate([open_[active], fresh], axis=1)
        top = np.argpartition(-all_score, take - 1, axis=1)[:, :take]
        ids[active], score[active], open_[active] = (np.take_along_axis(v, top, axis=1) for v in (all_ids, all_score, all_open))
    queries, nodes = (np.concatenate(v) for v in zip(*found, strict=True))
    out = [(queries, nodes)]
    while len(queries):  # on over all that is in range
        new: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, len(queries), 1 << 14):
            q, near = queries[lo : lo + (1 << 14)], adjacency[nodes[lo : lo + (1 << 14)]]
            at, slot = np.nonzero((near >= 0) & ~visited[q[:, None], near])
            pair = np.unique(q[at] * n + near[at, slot])
            a, b = pair // n, pair % n
            visited[a, b] = True
            hit = np.einsum("ij,ij->i", x[a], x[b]) >= bound
            new.append((a[hit], b[hit]))
        queries, nodes = (np.concatenate(v) for v in zip(*new, strict=True))
        out.append((queries, nodes))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))  # type: ignore[return-value]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns after the key) of runs of rows with one key, over batches sorted by key."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, [list(c) for c in zip(*rows, strict=True)]
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, [list(c) for c in zip(*rows, strict=True)]


def _matrix(units: list[bytes]) -> np.ndarray:
    width = max(len(u) for u in units)
    return np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), dtype=np.float64).reshape(len(units), -1)


def shard_links(cluster: int, cross: bool, nodes: list[int], units: list[bytes], copies: list[int], homes: list[list[int]], lists: list[list[int]], blocks: list[int], bound: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """(linked vectors by node, spanning links) among the pairs that this shard owns.

    A pair belongs to the first shard that both its vectors are in.
    """
    exact = _matrix(units)
    x = exact.astype(np.float32)
    n = len(nodes)
    place = {v: i for i, v in enumerate(nodes)}
    local = [[place[v] for v in near if v in place] for near in lists]
    adjacency = np.full((n, max(1, max(map(len, local)))), -1, dtype=np.int64)
    for i, near in enumerate(local):
        adjacency[i, : len(near)] = near
    block = np.array(blocks)
    entry = np.concatenate([(rows := np.flatnonzero(block == b))[medoids(x[rows], MEDOIDS)] for b in np.unique(block)])
    a, b = range_search(x, adjacency, entry, bound - SLACK)
    pair = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    a, b = pair // n, pair % n
    keep = (a != b) & ((block[a] != block[b]) if cross else (block[a] == block[b]))
    a, b = a[keep], b[keep]
    home = np.full((n, max(map(len, homes))), -1, dtype=np.int64)
    for i, h in enumerate(homes):
        home[i, : len(h)] = h
    shared = np.full(len(a), np.iinfo(np.int64).max)
    for i in range(home.shape[1]):
        for j in range(home.shape[1]):
            same = (home[a, i] == home[b, j]) & (home[a, i] >= 0)
            shared = np.where(same, np.minimum(shared, home[a, i]), shared)
    own = shared == cluster
    a, b = a[own], b[own]
    sure = np.concatenate([np.einsum("ij,ij->i", exact[a[i : i + 8192]], exact[b[i : i + 8192]]) >= bound for i in range(0, len(a), 8192)] or [np.zeros(0, dtype=bool)])
    a, b = a[sure], b[sure]
    weight = np.array(copies, dtype=np.float64)
    count = np.bincount(a, weights=weight[b], minlength=n) + np.bincount(b, weights=weight[a], minlength=n)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(i), find(j)
        if p != q:
            root[q] = p
            links.append((nodes[i], nodes[j]))
    return {nodes[i]: int(c) for i, c in enumerate(count) if c}, links


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bound: float = 0.95) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id``, ``kept``, ``audit_recall``.

    Vectors link where their cosine, in double precision, is ``bound`` or more.  ``n_links`` counts the other vectors
    linked directly, ``component_id`` is the least id reachable and ``kept`` marks its vector.  Vectors of one
    direction are one class, whose copies are never paired.  Vectors without a direction (null, zero, null or non-finite components)
    link with nothing; a null id is greater than all others; an empty table gives an empty one.  ``audit_recall`` is
    the share of links found among those of a sample of AUDIT vectors against all (null where the sample has none).
    """
    spark = vectors.sparkSession
    rows = checkpointed(unit_vectors(vectors, id_col, vector_col))
    full = rows.filter("node IS NOT NULL")
    classes = checkpointed(full.groupBy("node").agg(F.min("vec").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")))
    n = classes.count()

    def chosen(rate: float, most: int) -> list:
        return classes.filter(F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(1 << 30)) < min(1.0, rate) * (1 << 30)).limit(most).collect()

    sample = [r.unit for r in sorted(chosen(0.9 * SAMPLE / max(n, 1), SAMPLE), key=lambda r: r.node)]
    shards = max(1, min(MAX_SHARDS, -(-n * OVERLAP // SHARD)))
    middle = centroids(_matrix(sample), shards) if sample else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(middle.astype(np.float32))  # MAX_SHARDS rows at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            homes = []
            units = batch.column(1).to_pylist()
            for lo in range(0, len(units), 2048):
                x = _matrix(units[lo : lo + 2048]).astype(np.float32)
                width = min(x.shape[1], c.shape[1])
                sims = x[:, :width] @ c[:, :width].T
                m = min(OVERLAP, sims.shape[1])
                homes += np.sort(np.argpartition(-sims, m - 1, axis=1)[:, :m], axis=1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(homes, pa.list_(pa.int32()))], names=["node", "unit", "copies", "homes"])

    placed = checkpointed(classes.select("node", "unit", "copies").mapInArrow(assign, "node bigint, unit binary, copies bigint, homes array<int>"))
    member = placed.withColumn("shard", F.explode("homes"))
    blocks = F.broadcast(member.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # MAX_SHARDS rows at most
    member = member.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (nodes, units) in _groups(batches, 2):
            near = robust_graph(_matrix(units).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([[nodes[j] for j in x] for x in near], pa.list_(pa.int64()))], names=["node", "near"])

    built = member.select("shard", "block", "node", "unit").repartition("shard", "block").sortWithinPartitions("shard", "block", "node").mapInArrow(build, "node bigint, near array<bigint>")
    united = checkpointed(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))  # OVERLAP lists a node

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = member.join(united, "node").withColumn("other", other).select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "unit", "copies", "homes", "near", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, i, j), columns in _groups(batches, 3):
            count, links = shard_links(shard, i != j, *columns, bound)
            a = [*count, *[x for x, _ in links]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([None] * len(count) + [y for _, y in links], pa.int64()), pa.array([*count.values(), *[0] * len(links)], pa.int64())], names=["a", "b", "n"])

    found = checkpointed(tasks.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "node").mapInArrow(search, "a bigint, b bigint, n bigint"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    comps = components(found.filter("b IS NOT NULL").select("a", "b"))
    named = classes.select("node", "rep", "copies").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = checkpointed(named.join(least, "component").join(counts, "node", "left").select("node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    recall = F.lit(_audit(placed, named, chosen(2.0 * AUDIT / max(n, 1), AUDIT), bound)).cast("double")
    out = full.select("vec", "node").join(named, "node").select("vec", "n_links", "component_id")
    out = out.unionAll(rows.filter("node IS NULL").select("vec", F.lit(0).cast("bigint"), F.col("vec")))
    return out.select(F.col("vec").alias(id_col), "n_links", "component_id", F.col("vec").eqNullSafe(F.col("component_id")).alias("kept"), recall.alias("audit_recall"))


def _audit(placed: DataFrame, named: DataFrame, sample: list, bound: float) -> float | None:
    """Links found over links there are, for the sampled classes."""
    if not sample:
        return None
    probes, x = [r.node for r in sample], _matrix([r.unit for r in sample])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(probes))
        for batch in batches:
            if batch.num_rows:
                hits = _matrix(batch.column(0).to_pylist()) @ x.T >= bound
                total += np.asarray(batch.column(1), dtype=np.float64) @ hits
        yield pa.RecordBatch.from_arrays([pa.array(probes, pa.int64()), pa.array(total.astype(np.int64))], names=["node", "n"])

    true = placed.select("unit", "copies").mapInArrow(count, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n"))
    both = true.join(small_or_shuffled(named, 24), "node").select((F.col("n") - 1).alias("true"), "n_links").collect()  # AUDIT rows
    there = sum(r["true"] for r in both)
    return sum(min(r["true"], r.n_links) for r in both) / there if there else None
