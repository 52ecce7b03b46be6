"""Community detection, and accessors for levels of communities."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..loop import fixpoint
from ..model import Graph
from ..storage import checkpoint
from . import kernels
from .connectivity import by_component


@dataclass(frozen=True)
class Dendrogram:
    """Partitions from the finest level 0 to the coarsest: (level, id, community)."""

    levels: DataFrame

    def num_levels(self) -> DataFrame:
        return self.levels.agg(F.coalesce(F.max("level") + 1, F.lit(0)).alias("num_levels"))

    def level(self, i: int) -> DataFrame:
        return self.levels.filter(F.col("level") == i).select("id", "community")

    def finest(self) -> DataFrame:
        return self.level(0)

    def coarsest(self) -> DataFrame:
        last = self.levels.agg(F.max("level").alias("level"))
        return self.levels.join(F.broadcast(last), "level").select("id", "community")  # one row

    def at_most(self, communities: int) -> DataFrame:
        """The first level with at most that many communities."""
        sizes = self.levels.groupBy("level").agg(F.countDistinct("community").alias("n"))
        first = sizes.filter(F.col("n") <= communities).agg(F.min("level").alias("level"))
        return self.levels.join(F.broadcast(first), "level").select("id", "community")  # one row


def num_communities(assignments: DataFrame) -> DataFrame:
    return assignments.agg(F.countDistinct("community").alias("num_communities"))


def _levels(g: Graph, refine: bool, seed: int, **options) -> DataFrame:
    """(level, id, community) for every component, each in a task of its own; lone nodes are communities."""
    m2 = g.edges.agg(F.sum("weight")).first()[0] or 0.0

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        found = kernels.communities(list(zip(part["src"], part["dst"], part["weight"])), m2, refine=refine, seed=seed, **options)
        return pd.DataFrame([(k, v, c) for k, level in enumerate(found) for v, c in sorted(level.items())], columns=["level", "id", "community"])

    rows = g.edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    found = checkpoint(by_component(g, rows).groupBy("component").applyInPandas(kernel, "level int, id long, community long"))
    alone = g.nodes.select("id").join(found.select("id").distinct(), "id", "left_anti").select(F.lit(0).alias("level"), "id", F.col("id").alias("community"))
    out = found.unionAll(alone)
    # a component with fewer levels keeps its last one in the coarser levels
    most = found.agg(F.coalesce(F.max("level"), F.lit(0)).alias("most"))
    last = out.groupBy("id").agg(F.max(F.struct("level", "community")).alias("last"))
    more = last.crossJoin(F.broadcast(most)).filter("last.level < most")  # one row
    filled = more.select(F.explode(F.sequence(F.col("last.level") + 1, F.col("most"))).alias("level"), "id", F.col("last.community").alias("community"))
    return out.unionAll(filled)


def louvain(g: Graph, min_modularity_gain: float = 1e-6, max_iterations: int = 100, seed: int = 42) -> DataFrame:
    """(id, community): the coarsest level."""
    return Dendrogram(_levels(g, False, seed, least=min_modularity_gain, sweeps=max_iterations)).coarsest()


def leiden(g: Graph, min_modularity_gain: float = 1e-6, max_iterations: int = 100, theta: float = 1.0, seed: int = 42) -> DataFrame:
    """(id, community): the coarsest level, with refinement between levels."""
    return leiden_hierarchical(g, min_modularity_gain, max_iterations, theta, seed).coarsest()


def leiden_hierarchical(g: Graph, min_modularity_gain: float = 1e-6, max_iterations: int = 100, theta: float = 1.0, seed: int = 42) -> Dendrogram:
    return Dendrogram(_levels(g, True, seed, least=min_modularity_gain, sweeps=max_iterations, theta=theta))


def label_propagation(g: Graph, max_iterations: int = 100, seed: int = 0) -> DataFrame:
    """(id, community): every node takes the most frequent label around it.

    A node keeps its label where it is among the most frequent, and else takes
    the smallest of them.  Half of the nodes, another half by a hash in each
    round, may move, so neighbours don't swap labels for ever; it ends where no
    node wishes to move.
    """
    links = g.edges.filter("src <> dst").select("src", "dst").repartition("dst").persist()
    turn = F.pmod(F.xxhash64("id", "round", F.lit(seed)), F.lit(2)) == 0

    def step(state: DataFrame) -> DataFrame:
        votes = links.join(state.select(F.col("id").alias("dst"), F.col("community").alias("c")), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.count(F.lit(1)).alias("n"))
        own = votes.join(state.select("id", "community"), "id")
        best = own.groupBy("id").agg(F.max(F.struct("n", (F.col("c") == F.col("community")).alias("own"), (-F.col("c")).alias("c"))).alias("b"))
        wish = F.when(F.col("b").isNull(), F.col("community")).otherwise(-F.col("b.c"))
        rows = state.join(best, "id", "left").select("id", F.when(turn, wish).otherwise(F.col("community")).alias("community"), (wish != F.col("community")).alias("moved"), (F.col("round") + 1).alias("round"))
        return rows

    start = g.nodes.select("id", F.col("id").alias("community"), F.lit(True).alias("moved"), F.lit(0).alias("round"))
    found = fixpoint(start, step, F.col("moved"), 2 * max_iterations).select("id", "community")
    links.unpersist()
    return found
