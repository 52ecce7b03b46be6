"""Minimum spanning forest by rounds of cheapest edges out of every component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..storage import checkpoint
from .components import component_labels


def minimum_spanning_forest(g: Graph) -> DataFrame:
    """(src, dst, weight) with src < dst; equal weights are ordered by (src, dst)."""
    g.require_undirected("a spanning tree")
    pairs = g.edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    left = checkpoint(pairs.groupBy("src", "dst").agg(F.min("weight").alias("weight")).withColumns({"a": F.col("src"), "b": F.col("dst")}))
    chosen = []
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("a", "b")).alias("at"), F.struct("weight", "src", "dst", "a", "b").alias("e"))
        picked = checkpoint(ends.groupBy("at").agg(F.min("e").alias("e")).select("e.*").distinct())
        chosen.append(picked.select("src", "dst", "weight"))
        part = checkpoint(component_labels(picked.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        for c in ("a", "b"):
            left = left.join(part.select(F.col("id").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
        left = checkpoint(left.filter("a <> b").select("src", "dst", "weight", "a", "b"))
    if not chosen:
        return pairs.limit(0)
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionAll(c)
    return out
