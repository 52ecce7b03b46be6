"""Maximal cliques and colourings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..storage import checkpoint
from . import kernels
from .connectivity import by_component, core_numbers


def maximal_cliques(g: Graph) -> DataFrame:
    """(clique): sorted ids of every maximal clique; a lone node is one.

    Nodes are ordered by core number; each finds the cliques of which it is
    the first, among its later neighbours, as a task of its own.  Earlier
    neighbours only matter where they share a triangle with a later one.
    """
    links = g.simple()
    rank = core_numbers(g).select("id", F.struct("core", "id").alias("rank"))
    later = links.join(rank.select(F.col("id").alias("src"), F.col("rank").alias("rs")), "src").join(rank.select(F.col("id").alias("dst"), F.col("rank").alias("rd")), "dst")
    later = checkpoint(later.filter("rd > rs").select(F.col("src").alias("v"), F.col("dst").alias("a")))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    triangles = later.toDF("x", "y").join(later.toDF("y", "z"), "y").join(later.toDF("x", "z"), ["x", "z"])
    pairs = triangles.select(F.explode(F.array(F.struct(x.alias("v"), y.alias("a"), z.alias("b")), F.struct(y.alias("v"), x.alias("a"), z.alias("b")))).alias("p")).select("p.*")
    marks = later.select("v", "a", F.lit(-1).cast("long").alias("b"))

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        v = int(part["v"].iloc[0])
        adj: dict[int, set[int]] = {}
        own = set()
        for a, b in zip(part["a"].tolist(), part["b"].tolist()):
            adj.setdefault(a, set())
            if b == -1:
                own.add(a)
            else:
                adj[a].add(b)
                adj.setdefault(b, set()).add(a)
        found = kernels.maximal_cliques(own, set(adj) - own, adj)
        return pd.DataFrame({"clique": pd.Series([sorted([v, *c]) for c in found], dtype=object)})

    first = marks.select("v").distinct()  # a node without later neighbours begins no clique
    cliques = marks.unionAll(pairs.join(first, "v", "left_semi")).groupBy("v").applyInPandas(kernel, "clique array<long>")
    alone = g.nodes.select("id").join(links.select(F.col("src").alias("id")), "id", "left_anti").select(F.array("id").alias("clique"))
    return cliques.unionAll(alone)


def max_clique(g: Graph) -> DataFrame:
    """One row (clique): the largest, the first in order of ids among equals."""
    sized = maximal_cliques(g).select("clique", F.size("clique").alias("n"))
    best = sized.agg(F.max("n").alias("n"))
    return sized.join(F.broadcast(best), "n").agg(F.min("clique").alias("clique")).filter("clique is not null")  # one row


def _colored(g: Graph, kernel) -> DataFrame:
    rows = by_component(g, g.simple())
    found = rows.groupBy("component").applyInPandas(kernel, "id long, color long, proven boolean")
    alone = g.nodes.select("id").join(rows.select(F.col("src").alias("id")), "id", "left_anti")
    return found.unionAll(alone.select("id", F.lit(1).cast("long").alias("color"), F.lit(True).alias("proven")))


def dsatur(g: Graph) -> DataFrame:
    """(id, color): a proper colouring from 1, greedy by saturation; components don't influence each other."""
    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        found = kernels.dsatur(kernels.neighbours(zip(part["src"], part["dst"])))
        return pd.DataFrame([(v, c, False) for v, c in sorted(found.items())], columns=["id", "color", "proven"])

    return _colored(g, kernel).select("id", "color")


def exact_coloring(g: Graph, timeout_ms: int = 5_000) -> DataFrame:
    """(id, color, proven): fewest colours for each component, proven unless time ran out."""
    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        found, proven = kernels.exact_coloring(kernels.neighbours(zip(part["src"], part["dst"])), timeout_ms / 1000)
        return pd.DataFrame([(v, c, proven) for v, c in sorted(found.items())], columns=["id", "color", "proven"])

    return _colored(g, kernel)


def chromatic_number(colors: DataFrame) -> DataFrame:
    return colors.agg(F.coalesce(F.max("color"), F.lit(0).cast("long")).alias("colors"))
