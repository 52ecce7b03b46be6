"""Synthetic graphs, reproducible by seed."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import Graph, mirrored


def _graph(spark: SparkSession, n: int, edges, directed: bool) -> Graph:
    nodes = spark.range(n).select("id", F.col("id").alias("label"))
    rows = edges.select("src", "dst", F.lit(1.0).alias("weight"))
    return Graph(nodes, rows if directed else mirrored(rows), directed)


def erdos_renyi(spark: SparkSession, n: int, p: float, directed: bool = False, seed: int = 42) -> Graph:
    """Every pair of ``n`` nodes is an edge with probability ``p``, decided by a hash of the pair.

    Each source node draws its own row of pairs, so tasks hold no state.
    """
    first = F.lit(0).cast("long") if directed else F.col("src") + 1
    rows = spark.range(n).withColumnRenamed("id", "src").filter(first <= n - 1)
    pairs = rows.select("src", F.explode(F.sequence(first, F.lit(n - 1).cast("long"))).alias("dst")).filter("src <> dst")
    if p < 1:
        draw = F.shiftrightunsigned(F.xxhash64("src", "dst", F.lit(seed)), 11) / float(1 << 53)
        pairs = pairs.filter(draw < max(p, 0.0))
    return _graph(spark, n, pairs, directed)


def barabasi_albert(spark: SparkSession, n: int, m: int, directed: bool = False, seed: int = 42) -> Graph:
    """A clique of ``m`` nodes, then each node links to ``m`` distinct ones in proportion to their degrees."""
    if not n > m >= 1:
        raise ValueError("n must be larger than m, and m at least 1")
    rng = random.Random(seed)
    pairs = [(a, b) for a in range(m) for b in range(a + 1, m)]
    ends = [x for e in pairs for x in e] or [0]
    for v in range(m, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(rng.choice(ends))
        pairs += [(v, w) for w in sorted(chosen)]
        ends += [x for w in sorted(chosen) for x in (v, w)]
    return _graph(spark, n, spark.createDataFrame(pairs, "src long, dst long"), directed)


def watts_strogatz(spark: SparkSession, n: int, k: int, beta: float, directed: bool = False, seed: int = 42) -> Graph:
    """A ring where each node links to ``k`` neighbours; each link moves its far end with probability ``beta``."""
    if k % 2 or not 2 <= k < n:
        raise ValueError("k must be even, at least 2 and below n")
    rng = random.Random(seed)
    taken = {(v, (v + j) % n) for v in range(n) for j in range(1, k // 2 + 1)}
    present = {frozenset(e) for e in taken}
    pairs = []
    for v, w in sorted(taken):
        if rng.random() < beta:
            free = [u for u in range(n) if u != v and frozenset((v, u)) not in present]
            if free:
                present.discard(frozenset((v, w)))
                w = rng.choice(free)
                present.add(frozenset((v, w)))
        pairs.append((v, w))
    return _graph(spark, n, spark.createDataFrame(pairs, "src long, dst long"), directed)


def grid_2d(spark: SparkSession, rows: int, cols: int, directed: bool = False) -> Graph:
    """A grid with edges to the right and down; labels are (r, c), coordinates x = c and y = r."""
    cells = spark.range(rows * cols).select("id", F.expr(f"cast(id div {max(cols, 1)} as int)").alias("r"), F.expr(f"cast(id % {max(cols, 1)} as int)").alias("c"))
    nodes = cells.select("id", F.struct("r", "c").alias("label"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    right = cells.filter(F.col("c") < cols - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = cells.filter(F.col("r") < rows - 1).select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    edges = right.unionAll(down).select("src", "dst", F.lit(1.0).alias("weight"))
    return Graph(nodes, edges if directed else mirrored(edges), directed)
