"""Graph to graph."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import with_row_numbers
from ..model import CyclicGraphError, Graph
from ..storage import checkpoint
from . import kernels, paths


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in ``keep`` (id)."""
    return edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")


def subgraph(g: Graph, labels: list | DataFrame, renumber: bool = False) -> Graph:
    """The nodes with these labels and the edges between them; unknown labels are ignored."""
    if isinstance(labels, list):
        kind = g.nodes.schema["label"].dataType.simpleString()
        labels = g.spark.createDataFrame([(x,) for x in labels], f"label {kind}")
    nodes = g.nodes.join(labels.select("label").distinct(), "label", "left_semi").select(*g.nodes.columns)
    edges = induced(g.edges, nodes)
    if not renumber:
        return replace(g, nodes=nodes, edges=edges)
    named = with_row_numbers(nodes, ["id"], "new")
    ids = named.select(F.col("id").alias("old"), "new")
    moved = edges.join(ids.select(F.col("old").alias("src"), F.col("new").alias("s")), "src").join(ids.select(F.col("old").alias("dst"), F.col("new").alias("d")), "dst")
    return replace(g, nodes=named.withColumn("id", F.col("new")).drop("new"), edges=moved.select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight"))


def ego_graph(g: Graph, center, radius: int = 1) -> Graph:
    """Everything within ``radius`` hops of a label, against edge directions too, with the edges between."""
    at = g.id_of(center)
    if at is None:
        raise ValueError(f"no node is labelled {center!r}")
    links = g.edges.select("src", "dst", "weight").unionAll(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    near = paths.reach(Graph(g.nodes, links, True), g.spark.createDataFrame([(at,)], "id long"), radius) if radius else None
    keep = g.spark.createDataFrame([(at,)], "id long") if near is None else near.select(F.col("dst").alias("id"))
    return replace(g, nodes=g.nodes.join(keep, "id", "left_semi").select(*g.nodes.columns), edges=induced(g.edges, keep))


def transitive_closure(g: Graph) -> Graph:
    """An edge of weight 1 from every node to all it reaches, itself included: whole components in batches, larger ones in rounds."""
    g.require_directed("the transitive closure")
    from . import parts

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        src, dst = kernels.reach_all(zip(part["src"].tolist(), part["dst"].tolist()))
        return pd.DataFrame({"src": src, "dst": dst}, dtype="int64")

    links = g.edges.filter("src <> dst").select("src", "dst")
    small, large = parts.split(g, links)
    found = small.groupBy("batch").applyInPandas(kernel, "src long, dst long")
    if large is not None:
        over = parts.rest(g, large)
        found = found.unionAll(paths.reach(over, over.nodes.select("id")).select("src", "dst"))
    alone = g.nodes.select("id").join(links.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti")
    pairs = found.unionAll(alone.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    return replace(g, edges=pairs.select("src", "dst", F.lit(1.0).alias("weight")))


def transitive_reduction(g: Graph) -> Graph:
    """Without the edges that a longer way replaces; the graph must be directed and without cycles."""
    g.require_directed("the transitive reduction")
    from . import parts

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        found = kernels.replaced_edges(zip(part["src"].tolist(), part["dst"].tolist()))
        return pd.DataFrame([(None, None)] if found is None else found, columns=["src", "dst"]).astype("Int64")

    if not g.edges.filter("src = dst").isEmpty():
        raise CyclicGraphError("the graph has a cycle")
    small, large = parts.split(g, g.edges.select("src", "dst"))
    longer = checkpoint(small.groupBy("batch").applyInPandas(kernel, "src long, dst long"))
    if not longer.filter("src is null").isEmpty():
        raise CyclicGraphError("the graph has a cycle")
    if large is not None:
        longer = longer.unionAll(_replaced(parts.rest(g, large)))
    return replace(g, edges=g.edges.join(longer, ["src", "dst"], "left_anti").select("src", "dst", "weight"))


def _replaced(g: Graph) -> DataFrame:
    """(src, dst) of what a longer way joins."""
    pairs = checkpoint(paths.reach(g, g.nodes.select("id")).filter("src <> dst").select("src", "dst"))
    back = pairs.join(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    if not back.isEmpty():
        raise CyclicGraphError("the graph has a cycle")
    first = g.edges.select("src", F.col("dst").alias("via")).distinct()
    return first.join(pairs.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()


def contract(g: Graph, first, second, keep=None) -> Graph:
    """Merge two labels into one of them (``keep``, the first unless given).

    Loops go.  An undirected graph keeps the smallest weight of edges that
    became parallel; a directed one keeps them all.
    """
    keep = first if keep is None else keep
    a, b = g.id_of(first), g.id_of(second)
    if a is None or b is None:
        raise ValueError("both labels must be nodes")
    if keep not in (first, second):
        raise ValueError("keep must be one of the two labels")
    stay, go = (a, b) if keep == first else (b, a)

    def moved(c: str):
        return F.when(F.col(c) == go, F.lit(stay)).otherwise(F.col(c)).cast("long").alias(c)

    edges = g.edges.select(moved("src"), moved("dst"), "weight").filter("src <> dst") if a != b else g.edges
    if not g.directed:
        edges = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    nodes = g.nodes.filter(F.col("id") != go) if a != b else g.nodes
    return replace(g, nodes=nodes, edges=edges.select("src", "dst", "weight"), distinct=False)


def closure_of_bounded_depth(g: Graph, depth: int) -> DataFrame:
    """(src, dst, hops) by a recursive common table expression: for graphs without cycles."""
    g.edges.select("src", "dst").distinct().createOrReplaceTempView("loomgraph_closure_edges")
    return g.spark.sql(
        f"""with recursive walk(src, dst, hops) as (
              select src, dst, 1 from loomgraph_closure_edges
              union all
              select w.src, e.dst, w.hops + 1 from walk w join loomgraph_closure_edges e on w.dst = e.src where w.hops < {int(depth)})
            select src, dst, min(hops) as hops from walk group by src, dst"""
    )


