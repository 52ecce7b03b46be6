"""Best-fit packing of token sequences by bin completion.

Documents become token ids; those longer than a sequence are cut so that the
first piece takes the remainder and all others fill a sequence.  What is left
to pack are lengths below the capacity, and only their histogram matters: it
has at most ``capacity`` entries whatever the corpus holds.  The driver packs
the histogram by bin completion with branch and bound, applying a filling as
often as the counts allow, so the plan has a bounded number of distinct
fillings too.  The pieces then look up their places by their rank among the
pieces of equal length.

Defined cases: a null text counts as empty (the end id alone); an empty table
gives no rows; equal documents are packed one by one; a null ``doc_id`` and
other columns have no influence.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .tokens import append_id, release_memory, shared_encoder, text_slices

PIECES = "doc_id long, piece int, start long, length long, part int, rank long, ids binary"

#: Fillings that the search may look at before the incumbent stands.
NODES = 10_000


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, *, spaced: bool) -> DataFrame:
    """Pieces of all documents with their ids (little-endian 32-bit), written to the shared folder.

    ``part`` and ``rank`` number the pieces of equal length within a task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = shared_encoder(vocabulary, spaced), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in text_slices(batch):
                values, totals = append_id(*encoder.encode(rows.column("text")), end_id)
                n_pieces = -(-totals // capacity)
                owner = np.repeat(np.arange(len(totals)), n_pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                first = totals - (n_pieces - 1) * capacity
                start = np.where(piece > 0, first[owner] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[owner])
                order = np.argsort(length, kind="stable")
                group = length[order]
                new = np.flatnonzero(np.diff(group, prepend=-1))
                sizes = np.diff(np.append(new, len(group)))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(new, sizes) + seen[group]
                seen[group[new]] += sizes
                edges = np.concatenate([[0], np.cumsum(length)]) * 4
                ids = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(values.astype("<u4", copy=False))])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.full(len(owner), part, np.int32)), pa.array(rank), ids],
                    ["doc_id", "piece", "start", "length", "part", "rank", "ids"],
                )
        release_memory()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return materialise(rows.mapInArrow(cut, PIECES), "token-pieces")


def reachable(room: int, counts: np.ndarray, lengths: list[int]) -> list[int]:
    """For each number of the shortest lengths, the sums up to ``room`` that they can make, as bits."""
    within, sums = (1 << room + 1) - 1, [1]
    for length in lengths:
        now, left, step = sums[-1], min(int(counts[length]), room // length), 1
        while left:
            step = min(step, left)
            now |= now << length * step & within
            left -= step
            step *= 2
        sums.append(now)
    return sums


def fillings(total: int, counts: np.ndarray, lengths: list[int], sums: list[int]) -> Iterator[tuple[int, ...]]:
    """All fillings that sum to ``total``, those of larger lengths first."""
    if not total:
        yield ()
        return
    for k in range(len(lengths), 0, -1):
        if not sums[k] >> total & 1:
            return
        length = lengths[k - 1]
        for n in range(min(int(counts[length]), total // length), 0, -1):
            if sums[k - 1] >> total - n * length & 1:
                for rest in fillings(total - n * length, counts, lengths[: k - 1], sums):
                    yield (length,) * n + rest


def dominated(used: tuple[int, ...], waste: int, counts: np.ndarray, lengths: list[int]) -> bool:
    """Whether a longer document left could take the place of some of these, or of none, without overflow.

    Swapping it for them never costs a sequence.  Of long fillings only single
    documents and pairs are looked at, which leaves more to search, never less.
    """
    own = {x: used.count(x) for x in set(used)}
    most = len(used) if len(used) <= 6 else 2
    for size in range(min(most, len(used)) + 1):
        for part in set(combinations(used, size)):
            low = sum(part) + (size < 2)
            for x in lengths[bisect_left(lengths, low) : bisect_right(lengths, sum(part) + waste)]:
                if counts[x] > own.get(x, 0):
                    return True
    return False


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by waste, and by documents too long to share one (Martello and Toth's L2)."""
    counts = np.cumsum(histogram)
    sums = np.cumsum(histogram * np.arange(capacity + 1))
    half, best = capacity // 2, -(-int(sums[-1]) // capacity)
    for k in range(1, half + 1):
        alone, wide = int(counts[-1] - counts[capacity - k]), int(counts[capacity - k] - counts[half])
        room = wide * capacity - int(sums[capacity - k] - sums[half])
        best = max(best, alone + wide + max(0, -(-(int(sums[half] - sums[k - 1]) - room) // capacity)))
    return best


def _choices(counts: np.ndarray, capacity: int, last: tuple | None, slack: Callable[[], int], spend: Callable[[], bool]) -> Iterator[tuple]:
    """(largest length, filling, times, waste, key) for every undominated filling of the largest document left.

    Fillings of one length are used in order of their keys, after ``last``; all
    are first tried as often as counts allow, then less often.
    """
    largest = int(np.flatnonzero(counts)[-1])
    room = capacity - largest
    counts[largest] -= 1
    left = counts.copy()
    counts[largest] += 1
    lengths = np.flatnonzero(left[: room + 1]).tolist()
    sums = reachable(room, left, lengths)
    for fewer in (False, True):
        waste = -1
        while (waste := waste + 1) <= min(room, slack()):
            for used in fillings(room - waste, left, lengths, sums) if sums[-1] >> room - waste & 1 else ():
                if not spend():
                    return
                key = (-largest, waste, tuple(-x for x in used))
                if last is not None and last[0] == -largest and key <= last or dominated(used, waste, left, lengths):
                    continue
                kinds, each = np.unique((largest, *used), return_counts=True)
                times = int((counts[kinds] // each).min())
                for t in range(times - 1, 0, -1) if fewer else (times,):
                    if fewer and not spend():
                        return
                    yield largest, used, t, waste, key


def branch(histogram: np.ndarray, capacity: int, incumbent: int, bound: int, nodes: int | None) -> list[tuple[list[int], int]] | None:
    """The best plan found of under ``incumbent`` sequences, by depth-first search over undominated fillings.

    A branch ends where its waste leaves no plan below the incumbent; the search
    ends at ``bound``, or after looking at so many fillings.
    """
    counts = histogram.copy()
    total = int((counts * np.arange(capacity + 1)).sum())
    best, path, wasted, seen = None, [], 0, 0

    def slack() -> int:
        return (incumbent - 1) * capacity - total - wasted

    def spend() -> bool:
        nonlocal seen
        seen += 1
        return nodes is None or seen <= nodes

    stack = [_choices(counts, capacity, None, slack, spend)] if total else []
    undo: list[tuple] = []
    while stack:
        choice = next(stack[-1], None)
        if choice is None:
            stack.pop()
            if undo:
                largest, used, times, waste = undo.pop()
                path.pop()
                np.add.at(counts, [largest, *used], times)
                wasted -= waste * times
            continue
        largest, used, times, waste, key = choice
        if waste * times > slack():
            continue
        np.subtract.at(counts, [largest, *used], times)
        wasted += waste * times
        path.append(([largest, *used], times))
        undo.append((largest, used, times, waste))
        if counts.any():
            stack.append(_choices(counts, capacity, key, slack, spend))
            continue
        best, incumbent = list(path), sum(t for _, t in path)
        if incumbent <= bound:
            break
        stack.append(iter(()))
    return best


def greedy_plan(histogram: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """The least wasteful filling of the largest document left, as often as the counts allow, again and again."""
    counts, plan = histogram.copy(), []
    while counts.any():
        largest, used, times, *_ = next(_choices(counts, capacity, None, lambda: capacity, lambda: True))
        np.subtract.at(counts, [largest, *used], times)
        plan.append(([largest, *used], times))
    return plan


def complete_bins(histogram: np.ndarray, capacity: int, nodes: int = NODES) -> list[tuple[list[int], int]]:
    """Fillings (lengths) and how often each is used, packing the whole histogram.

    The better of the best-fit and the greedy plan is the incumbent.  Unless it
    meets the lower bound, bin completion searches for a plan that does, which
    leaves the least waste to spend, then for plans 1, 3, 7 ... above the bound.
    Each search looks at ``nodes`` fillings at most; the result is the optimum
    where none is cut off by that.
    """
    bound = lower_bound(histogram, capacity)
    plans = [best_fit_plan(histogram, capacity)]
    if _size(plans[0]) > bound:
        plans.append(greedy_plan(histogram, capacity))
    plan = min(plans, key=_size)
    top = _size(plan) - 1 - bound
    for above in sorted({min(2**k - 1, top) for k in range(top.bit_length() + 1)}) if top >= 0 else ():
        found = branch(histogram, capacity, bound + above + 1, bound, nodes)
        if found:
            return found
    return plan


def _size(plan: list[tuple[list[int], int]]) -> int:
    return sum(times for _, times in plan)


def best_fit_plan(histogram: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """The best-fit decreasing packing as fillings: each sequence takes the largest document that fits, again and again."""
    counts = histogram.copy()
    plan: list[tuple[list[int], int]] = []
    while counts.any():
        used, free = [], capacity
        left = counts.copy()
        while free and (fits := np.flatnonzero(left[: free + 1])).size:
            used.append(int(fits[-1]))
            left[used[-1]] -= 1
            free -= used[-1]
        kinds, each = np.unique(used, return_counts=True)
        times = int((counts[kinds] // each).min())
        counts[kinds] -= each * times
        plan.append((used, times))
    return plan


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have length, part and rank.

    Ranks within a length over all tasks come from the counts by (length,
    task), a table much smaller than the pieces; no piece waits for another.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    runs, sequence = [], 0
    taken = np.zeros(capacity + 1, np.int64)
    for used, times in complete_bins(histogram, capacity):
        offset = 0
        for length in sorted(set(used), reverse=True):
            each = used.count(length)
            runs.append((length, int(taken[length]), sequence, offset, each))
            taken[length] += each * times
            offset += each * length
        sequence += times
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    key = table[:, 0] * (1 << 48) + table[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            run = table[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            out = [pa.array(run[:, 2] + nth // run[:, 4]), pa.array(run[:, 3] + nth % run[:, 4] * length)]
            names = [c for c in batch.schema.names if c not in ("part", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *out], [*names, "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank")).drop("base")
    fields = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c not in ("part", "rank"))
    return ranked.mapInArrow(assign, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, *, spaced: bool = True) -> DataFrame:
    """Pieces with ids and their places: doc_id, piece, start, length, ids, sequence_id, offset."""
    return place(token_pieces(docs, vocabulary, end_id, capacity, spaced=spaced), capacity)
