"""A largest matching of a bipartite graph, without a task that sees a whole component.

Rounds of offers match what they can; then searches from all unmatched nodes
of one side grow disjoint trees over the edges, alternately unmatched and
matched, and every tree that meets an unmatched node of the other side swaps
one path.  It ends where no tree meets one, which proves the matching largest
(Berge), or where one side is matched altogether.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..loop import count_rows
from ..storage import checkpoint


def _greedy(edges: DataFrame, goal: int) -> DataFrame:
    """(l, r): a matching that no edge extends, or one of ``goal`` pairs."""
    mates, left, found = None, edges, 0
    for k in range(1 << 20):
        spread = F.xxhash64("l", "r", F.lit(k))
        offers = left.groupBy("l").agg(F.min_by("r", spread).alias("r"))
        new = checkpoint(offers.groupBy("r").agg(F.min_by("l", spread).alias("l")).select("l", "r"))
        mates = new if mates is None else mates.unionAll(new)
        found += count_rows(new)
        if found >= goal:
            break
        left = checkpoint(left.join(new.select("r"), "r", "left_anti").join(new.select("l"), "l", "left_anti").select("l", "r"))
        if left.isEmpty():
            break
    return checkpoint(mates)


def _search(edges: DataFrame, free: DataFrame, mates: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Trees (r, l, root) from the unmatched ``free`` (l), and the ends (r) of disjoint paths, at most one of a tree; None where there is none."""
    front = free.select("l", F.col("l").alias("root"))
    mate = mates.select("r", F.col("l").alias("next"))
    seen = None
    while True:
        step = front.join(edges, "l")
        if seen is not None:
            step = step.join(seen.select("r"), "r", "left_anti")
        step = checkpoint(step.groupBy("r").agg(F.min(F.struct("root", "l")).alias("by")).select("r", "by.l", "by.root").join(mate, "r", "left"))
        seen = step.select("r", "l", "root") if seen is None else checkpoint(seen.unionAll(step.select("r", "l", "root")))
        if step.isEmpty():
            return seen, None
        ends = step.filter("next is null")
        if not ends.isEmpty():
            return seen, checkpoint(ends.groupBy("root").agg(F.min("r").alias("r")).select("r"))
        front = step.select(F.col("next").alias("l"), "root")


def _swapped(mates: DataFrame, seen: DataFrame, ends: DataFrame) -> DataFrame:
    """The matching after every path to ``ends`` has swapped its edges."""
    new, at = None, ends
    back = mates.select("l", F.col("r").alias("before"))
    while True:
        step = checkpoint(at.join(seen, "r").select("l", "r").join(back, "l", "left"))
        new = step.select("l", "r") if new is None else new.unionAll(step.select("l", "r"))
        at = step.filter("before is not null").select(F.col("before").alias("r"))
        if at.isEmpty():
            return checkpoint(mates.join(new.select("l"), "l", "left_anti").select("l", "r").unionAll(new))


def largest(edges: DataFrame) -> DataFrame:
    """(l, r): a largest matching of the distinct ``edges`` (l, r) between two sides; ``edges`` is read often."""
    lefts, rights = edges.select("l").distinct(), edges.select("r").distinct()
    n, m = count_rows(lefts), count_rows(rights)
    if not min(n, m):
        return edges
    mates = _greedy(edges, min(n, m))
    size = count_rows(mates)
    swap = m < n  # search from the side with fewer unmatched nodes
    if swap:
        edges, mates, lefts = edges.select(F.col("r").alias("l"), F.col("l").alias("r")), mates.select(F.col("r").alias("l"), F.col("l").alias("r")), rights.toDF("l")
    while size < min(n, m):
        free = checkpoint(lefts.join(mates.select("l"), "l", "left_anti"))
        seen, ends = _search(edges, free, mates)
        if ends is None:
            break
        size += count_rows(ends)
        mates = _swapped(mates, seen, ends)
    return mates.select(F.col("r").alias("l"), F.col("l").alias("r")) if swap else mates
