"""Triangles without a table of wedges.

Nodes are ranked by (degree, id) and edges lead to the larger rank, so no node
has more than sqrt(2e) edges out.  Ranks fall into buckets, and a task sees
the edges between three buckets only (Afrati and Ullman, "Optimizing joins in
a map-reduce environment", 2010; Suri and Vassilvitskii, 2011).  An edge is
sent once for each bucket, packed; wedges exist in a task's memory alone, a
slice at a time.  The number of buckets keeps a task's edges bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import with_row_numbers
from ..model import Graph
from ..storage import default_partitions, materialise

#: Edges that meet in a task, on average, at most.
TASK_EDGES = 16_000_000
LEAST_BUCKETS = 12
#: Edges packed at once, and wedges looked at in one slice.
PACKED, SLICE = 4_000_000, 1_000_000


def _pack(u: np.ndarray, v: np.ndarray, p: int) -> Iterator[pa.RecordBatch]:
    """Blocks of edges between two buckets, once for each third bucket."""
    i, j = u % p, v % p
    block = np.minimum(i, j) * p + np.maximum(i, j)
    order = np.lexsort((u, block))
    u, v, block = u[order], v[order], block[order]
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(block)]):
        low, high = divmod(int(block[a]), p)
        data = np.diff(u[a:b], prepend=0).astype("<u4").tobytes() + v[a:b].astype("<u4").tobytes()
        data = pa.compress(data, codec="zstd", asbytes=True)
        keys = []
        for k in range(p):
            x, y, z = sorted((low, high, k))
            keys.append((x * p + y) * p + z)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([int(b - a)] * p, pa.int64()), pa.array([data] * p, pa.binary())], names=["key", "n", "data"])


def _edges(table: pa.Table) -> np.ndarray:
    """The distinct edges of a task as sorted keys: source's rank, then target's."""
    parts = []
    for n, data in zip(table["n"].to_pylist(), table["data"]):
        raw = np.frombuffer(pa.decompress(data.as_buffer(), n * 8, codec="zstd"), "<u4")
        parts.append(np.cumsum(raw[:n], dtype=np.uint64) << np.uint64(32) | raw[n:])
    keys = np.concatenate(parts)
    keys.sort()
    return keys


def find(keys: np.ndarray, same: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of triangles a < b < c over sorted keys; with ``same`` none of which all ranks are equal modulo it."""
    u, v = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.diff(u, prepend=-1))
    nodes, degree = u[starts], np.diff(starts, append=len(u))
    own = np.repeat(np.arange(len(nodes)), degree)
    at = np.minimum(np.searchsorted(nodes, v), len(nodes) - 1)
    wedges = np.where(nodes[at] == v, degree[at], 0)
    # marks turn away most open wedges before the search: a node has four to eight bits for each of its edges
    room = 1 << np.ceil(np.log2(4 * degree)).astype(np.int64)
    base, mask = np.cumsum(room) - room, room - 1
    marks = np.zeros(int(room.sum()), bool)

    def slot(node: np.ndarray, target: np.ndarray) -> np.ndarray:
        return base[node] + ((target * 0x9E3779B1 >> 15) & mask[node])

    marks[slot(own, v)] = True
    edge = np.flatnonzero(wedges)
    ends = np.cumsum(wedges[edge])
    first = 0
    while first < len(edge):
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + SLICE, "right")))
        e = edge[first:last]
        count = wedges[e]
        rows = np.repeat(e, count)
        c = v[np.arange(len(rows)) + np.repeat(starts[at[e]] - (np.cumsum(count) - count), count)]
        hit = np.flatnonzero(marks[slot(own[rows], c)])
        rows, c = rows[hit], c[hit]
        wanted = u[rows].astype(np.uint64) << np.uint64(32) | c.astype(np.uint64)
        spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = np.flatnonzero(keys[spot] == wanted)
        a, b, c = u[rows[hit]], v[rows[hit]], c[hit]
        if same is not None:
            mixed = (a % same != b % same) | (b % same != c % same)
            a, b, c = a[mixed], b[mixed], c[mixed]
        if len(a):
            yield a, b, c
        first = last


def _counts(keys: np.ndarray, same: int | None) -> pa.Table:
    return pa.table({"n": pa.array([sum(len(a) for a, _, _ in find(keys, same))], pa.int64())})


def _corners(keys: np.ndarray, same: int | None) -> pa.Table:
    ranks = np.unique(np.concatenate([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)])).astype(np.int64)
    total = np.zeros(len(ranks), np.int64)
    for abc in find(keys, same):
        for x in abc:
            total += np.bincount(np.searchsorted(ranks, x), minlength=len(ranks))
    some = np.flatnonzero(total)
    return pa.table({"rank": pa.array(ranks[some], pa.int64()), "n": pa.array(total[some], pa.int64())})


def _rows(keys: np.ndarray, same: int | None) -> pa.Table:
    found = list(find(keys, same)) or [(np.zeros(0, np.int64),) * 3]
    return pa.table({n: pa.array(np.concatenate(x), pa.int64()) for n, x in zip("abc", zip(*found))})


def ranked(pairs: DataFrame) -> DataFrame:
    """(id, k, rank): the degree of every node with an edge, and its place by (degree, id)."""
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    return with_row_numbers(degree, ["k", "id"], "rank")


def _dealt(pairs: DataFrame, ranks: DataFrame, reduce, schema: str) -> DataFrame:
    nodes, ends = ranks.agg(F.count(F.lit(1)), F.sum("k")).first()
    if nodes >= 1 << 32:
        raise ValueError("ranks must fit into 32 bits")
    edges = (ends or 0) // 2
    p = max(LEAST_BUCKETS, math.ceil(math.sqrt(6 * edges / TASK_EDGES)))
    a, b = ranks.select(F.col("id").alias("src"), F.col("rank").alias("a")), ranks.select(F.col("id").alias("dst"), F.col("rank").alias("b"))
    oriented = pairs.join(a, "src").join(b, "dst").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(u) for u, _ in held) >= PACKED:
                yield from _pack(*(np.concatenate(x) for x in zip(*held)), p)
                held = []
        if held:
            yield from _pack(*(np.concatenate(x) for x in zip(*held)), p)

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        z = key[0].as_py()
        buckets = {z % p, z // p % p, z // p // p}
        return reduce(_edges(table), p if len(buckets) == 2 else None)

    tasks = max(default_partitions(pairs.sparkSession), min(p * (p + 1) * (p + 2) // 6, edges * p // 2_000_000))
    return oriented.mapInArrow(pack, "key long, n long, data binary").repartition(tasks, "key").groupBy("key").applyInArrow(kernel, schema)


def _pairs(g: Graph) -> DataFrame:
    return g.pairs() if g.distinct else materialise(g.pairs(), "pairs")


def count(g: Graph) -> DataFrame:
    """One row (triangle_count)."""
    pairs = _pairs(g)
    return _dealt(pairs, ranked(pairs), _counts, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triangle_count"))


def corners(g: Graph) -> DataFrame:
    """(id, k, t): the neighbours of every node with an edge, and the triangles it is part of."""
    pairs = _pairs(g)
    ranks = ranked(pairs)
    found = _dealt(pairs, ranks, _corners, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("t"))
    return ranks.join(found, "rank", "left").select("id", "k", F.coalesce("t", F.lit(0).cast("long")).alias("t"))


def rows(g: Graph) -> DataFrame:
    """(a, b, c): each triangle once."""
    pairs = _pairs(g)
    ranks = ranked(pairs)
    found = _dealt(pairs, ranks, _rows, "a long, b long, c long")
    for c in "abc":
        found = found.join(ranks.select(F.col("rank").alias(c), F.col("id").alias(f"_{c}")), c)
    return found.select(*[F.col(f"_{c}").alias(c) for c in "abc"])
