"""Distance-based measures of a whole network, from one all-pairs table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..storage import checkpoint
from . import paths


def eccentricity(g: Graph, dist: DataFrame | None = None) -> DataFrame:
    """(id, eccentricity): the largest distance to a node that can be reached; 0 if there is none."""
    rows = paths.relax(g, g.nodes.select("id"), tolerate_negative=False) if dist is None else dist
    return rows.groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("eccentricity"))


def analyze(g: Graph) -> DataFrame:
    """One row: diameter, radius, average_path_length; 0 for an empty graph."""
    dist = checkpoint(paths.relax(g, g.nodes.select("id"), tolerate_negative=False))
    ends = eccentricity(g, dist).agg(F.coalesce(F.max("eccentricity"), F.lit(0.0)).alias("diameter"), F.coalesce(F.min("eccentricity"), F.lit(0.0)).alias("radius"))
    mean = dist.filter("src <> dst").agg(F.coalesce(F.avg("dist"), F.lit(0.0)).alias("average_path_length"))
    return ends.crossJoin(mean)  # two one-row tables


def diameter(g: Graph) -> DataFrame:
    return analyze(g).select("diameter")


def radius(g: Graph) -> DataFrame:
    return analyze(g).select("radius")


def average_path_length(g: Graph) -> DataFrame:
    return analyze(g).select("average_path_length")


def strict(g: Graph) -> DataFrame:
    """As ``analyze``, but null wherever some node can't reach all others."""
    n = g.n()
    dist = checkpoint(paths.relax(g, g.nodes.select("id"), tolerate_negative=False))
    whole = dist.agg((F.count(F.lit(1)) == n * n).alias("whole"))
    return analyze(g).crossJoin(whole).select(*[F.when(F.col("whole"), F.col(c)).alias(c) for c in ("diameter", "radius", "average_path_length")])
