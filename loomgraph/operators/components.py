"""Connected components of an edge table by alternating star contractions.

Each round replaces every edge by edges towards the smallest neighbour
(Kiveris et al., "Connected components in MapReduce and beyond", 2014), so
the number of rounds grows with the logarithm of the longest path, the edge
count never grows, and no group is gathered in one task: neighbour minima are
pre-aggregated and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def component_labels(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, component) for every id in ``edges`` (u, v); component is the smallest id reachable.

    Edges count in both directions; loops and repeated edges don't matter.
    Ids without an edge to another id are not in the result.
    """
    state = checkpoint(edges.select("u", "v").filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        state = checkpoint(_small_star(_large_star(state)))
        mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)


def _parity_round(edges: DataFrame) -> DataFrame:
    """Both stars over edges (u, v, p); p says whether the ends are on different sides.  Rows u = v remain where a cycle is odd."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "p"))
    least = both.groupBy("u").agg(F.min(F.struct("v", "p")).alias("m"))
    least = least.select("u", F.least("m", F.struct(F.col("u").alias("v"), F.lit(0).alias("p"))).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m.v").alias("v"), F.col("p").bitwiseXOR(F.col("m.p")).alias("p")).distinct()
    least = large.groupBy("u").agg(F.min(F.struct("v", "p")).alias("m"))
    moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m.v").alias("v"), F.col("p").bitwiseXOR(F.col("m.p")).alias("p"))
    rows = moved.unionAll(least.select("u", "m.v", "m.p")).filter("u <> v or p = 1")
    return rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), "p").distinct()


def _parities(edges: DataFrame, max_rounds: int) -> DataFrame | None:
    """(id, component, p) over edges (u, v, p) with u > v; None where a cycle is odd."""
    state, before = edges, None
    for _ in range(max_rounds):
        state = checkpoint(_parity_round(state))
        *mark, odd = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)")), F.count(F.when(F.expr("u = v"), 1))).first()
        if odd:
            return None
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = state.select(F.col("v").alias("id"), F.col("v").alias("component"), F.lit(0).alias("p")).distinct()
    return state.select(F.col("u").alias("id"), F.col("v").alias("component"), "p").unionAll(roots)


def contracted(pairs: DataFrame, sides: bool, max_rounds: int = 64) -> DataFrame | None:
    """(id, component, p) by way of a forest, for graphs with far more edges than nodes.

    Every node keeps the edge to its smallest neighbour; the components of
    these few edges come first, and all ``pairs`` (src, dst) are read once
    more to see which of them meet.  With ``sides`` p is the side of a node,
    0 for the smallest id, and None is returned where a cycle is odd.
    """
    p = F.lit(1 if sides else 0)
    both = pairs.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(pairs.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    hooks = both.groupBy("u").agg(F.min("v").alias("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), p.alias("p")).distinct()
    trees = _parities(checkpoint(hooks), max_rounds)
    if trees is None:
        return None
    trees = checkpoint(trees)
    a, b = trees.toDF("src", "a", "pa"), trees.toDF("dst", "b", "pb")
    meet = pairs.join(a, "src").join(b, "dst").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), p.bitwiseXOR(F.col("pa")).bitwiseXOR(F.col("pb")).alias("p"))
    meet = checkpoint(meet.filter("u <> v or p = 1").distinct())
    if not meet.filter("u = v").isEmpty():
        return None
    top = _parities(meet, max_rounds)
    if top is None:
        return None
    top = checkpoint(top).toDF("component", "top", "q")
    both = trees.join(top, "component", "left")
    return both.select("id", F.coalesce("top", "component").alias("component"), F.col("p").bitwiseXOR(F.coalesce("q", F.lit(0))).alias("p"))
