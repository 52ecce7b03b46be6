"""Flows and cuts.

Only nodes on some way from source to sink matter, which relational steps find
first; the augmenting itself is sequential and runs as one task over that part
of the graph.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..storage import checkpoint
from . import kernels, paths
from .connectivity import by_component, weakly_connected
from .transform import induced

ALGORITHMS = ("edmonds_karp", "push_relabel")


@dataclass(frozen=True)
class Flow:
    """``value`` is one row (max_flow); ``residual`` has (src, dst, capacity); ``sides`` has (id, side)."""

    value: DataFrame
    residual: DataFrame
    sides: DataFrame


def max_flow(g: Graph, source, sink, algorithm: str = "edmonds_karp") -> Flow:
    """The largest flow between two labels, with capacities as weights, and a smallest cut.

    An undirected graph carries flow either way.  Residual capacities are
    summed for each pair of nodes.
    """
    s, t = g.id_of(source), g.id_of(sink)
    if s is None or t is None:
        raise ValueError("source and sink must be nodes")
    spark = g.spark
    start, end = spark.createDataFrame([(s,)], "id long"), spark.createDataFrame([(t,)], "id long")
    useful = Graph(g.nodes, g.edges.filter("weight > 0 and src <> dst"), True)
    ahead = paths.reach(useful, start).select(F.col("dst").alias("id"))
    behind = paths.reach(useful.transpose(), end).select(F.col("dst").alias("id"))
    part = checkpoint(induced(useful.edges, ahead.join(behind, "id", "left_semi")).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        value, residual = kernels.max_flow(list(zip(rows["src"], rows["dst"], rows["weight"])), s, t, algorithm)
        out = [("value", None, None, value)]
        out += [("residual", a, b, c) for (a, b), c in sorted(residual.items()) if c > 0]
        out += [("source", v, None, None) for v in sorted(kernels.residual_side(residual, s))]
        return pd.DataFrame(out, columns=["what", "src", "dst", "capacity"]).astype({"src": "Int64", "dst": "Int64", "capacity": "float64"})

    found = checkpoint(part.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(kernel, "what string, src long, dst long, capacity double"))
    total = found.filter("what = 'value'").agg(F.coalesce(F.sum("capacity"), F.lit(0.0)).alias("max_flow"))
    # beyond the part, what the source reaches over unused edges is on its side as well
    reached = found.filter("what = 'source'").select(F.col("src").alias("id")).unionAll(start).distinct()
    inside = found.filter("what = 'residual'").select("src", "dst", "capacity")
    beyond = useful.edges.join(part.select("src", "dst"), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.sum("weight").alias("capacity"))
    residual = checkpoint(inside.unionAll(beyond.select("src", "dst", "capacity")))
    side = paths.reach(Graph(g.nodes, residual.select("src", "dst", F.col("capacity").alias("weight")), True), checkpoint(reached)).select(F.col("dst").alias("id")).distinct().withColumn("side", F.lit("source"))
    sides = g.nodes.select("id").join(side, "id", "left").select("id", F.when(F.col("id") == t, F.lit("sink") if s != t else F.col("side")).otherwise(F.coalesce("side", F.lit("sink"))).alias("side"))
    return Flow(total, residual, sides)


def global_min_cut(g: Graph) -> DataFrame:
    """One row (min_cut): the least weight whose removal parts an undirected graph; 0 if it is not connected."""
    g.require_undirected("the global minimum cut")
    spark = g.spark
    parts = checkpoint(weakly_connected(g)).select("component").distinct().limit(2).count()
    if parts != 1 or g.n() < 2:
        return spark.createDataFrame([(0.0,)], "min_cut double")

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"min_cut": [kernels.stoer_wagner(zip(rows["src"], rows["dst"], rows["weight"]))[0]]})

    rows = g.edges.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return by_component(g, rows).groupBy("component").applyInPandas(kernel, "min_cut double")


def global_min_cut_sides(g: Graph) -> DataFrame:
    """(id, side) of a global minimum cut of a connected undirected graph."""
    g.require_undirected("the global minimum cut")

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        _, side = kernels.stoer_wagner(zip(rows["src"], rows["dst"], rows["weight"]))
        ids = sorted(set(rows["src"]) | set(rows["dst"]))
        return pd.DataFrame({"id": ids, "side": ["a" if v in side else "b" for v in ids]})

    rows = g.edges.filter("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return by_component(g, rows).groupBy("component").applyInPandas(kernel, "id long, side string")
