"""Whole components in batches.

Where a graph falls into many components of modest size, an algorithm that
needs rounds over everything is cheaper on whole components: a task takes many
at a time.  Components above a limit are handed back, for the distributed way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..storage import default_partitions, materialise
from .connectivity import by_component

#: Edge rows of one component, at most, and of one batch, on average.
MOST, BATCH = 500, 20_000


def batched(rows: DataFrame, each: int | None = None) -> DataFrame:
    """``rows`` with the batch of their component."""
    batches = max(default_partitions(rows.sparkSession), rows.count() // (each or BATCH) + 1)
    return rows.withColumn("batch", F.pmod(F.xxhash64("component"), F.lit(batches)))


def split(g: Graph, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edge rows of components of ``MOST`` rows or fewer, with their batch; and those of larger ones, None if there are none."""
    rows = materialise(by_component(g, rows), "parts")
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    if sizes.filter(F.col("size") > MOST).isEmpty():
        return batched(rows), None
    large = sizes.filter(F.col("size") > MOST).select("component")
    return batched(rows.join(large, "component", "left_anti")), rows.join(large, "component", "left_semi")


def rest(g: Graph, rows: DataFrame, weighted: bool = False) -> Graph:
    """The graph of the larger components' rows."""
    nodes = rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(g.nodes.join(nodes, "id", "left_semi"), rows.select("src", "dst", F.col("weight") if weighted else F.lit(1.0).alias("weight")), g.directed)
