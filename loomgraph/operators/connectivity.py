"""Components, cores, cuts, bipartite structure and orders of directed graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..loop import fixpoint
from ..model import CyclicGraphError, Graph, NotBipartiteError
from ..storage import checkpoint, materialise
from . import kernels, matching, paths
from .components import component_labels, contracted


#: Edges for each node from which components are found over a forest first.
DENSE = 4


def weakly_connected(g: Graph) -> DataFrame:
    """(id, component): the smallest id connected with it."""
    if g.distinct and not g.directed and g.pairs().count() > DENSE * g.n():
        found = contracted(g.pairs(), sides=False).select("id", "component")
    else:
        rows = g.pairs() if g.distinct and not g.directed else g.edges
        found = component_labels(rows.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def by_component(g: Graph, rows: DataFrame) -> DataFrame:
    """Edge rows with the component of their source."""
    part = weakly_connected(g).select(F.col("id").alias("src"), "component")
    return rows.join(part, "src")


def strongly_connected(g: Graph) -> DataFrame:
    """(id, component): the smallest id of its strong component.

    Each round spreads the smallest id along the edges; what reaches the node
    of that id backward within its colour is one component and leaves.
    """
    left = checkpoint(g.nodes.select("id"))
    edges = checkpoint(g.edges.filter("src <> dst").select("src", "dst").distinct())
    done = []
    while not left.isEmpty():
        def spread(state: DataFrame) -> DataFrame:
            offers = state.filter("moved").select(F.col("id").alias("src"), "color").join(edges, "src").select(F.col("dst").alias("id"), "color", F.lit(None).cast("long").alias("own"))
            merged = state.select("id", "color", F.col("color").alias("own")).unionAll(offers).groupBy("id").agg(F.min("color").alias("color"), F.max("own").alias("own"))
            return merged.select("id", "color", (F.col("color") < F.col("own")).alias("moved"))

        colored = fixpoint(left.select("id", F.col("id").alias("color"), F.lit(True).alias("moved")), spread, F.col("moved"), 1 << 20).select("id", "color")
        same = edges.join(colored.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(colored.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst").filter("a = b")
        back = checkpoint(same.select(F.col("dst").alias("at"), F.col("src").alias("to")))

        def gather(state: DataFrame) -> DataFrame:
            new = state.filter("moved").select(F.col("id").alias("at"), "component").join(back, "at").select(F.col("to").alias("id"), "component", F.lit(True).alias("moved"))
            both = state.select("id", "component", F.lit(False).alias("moved")).unionAll(new)
            return both.groupBy("id").agg(F.min("component").alias("component"), F.min("moved").alias("moved"))

        roots = colored.filter("id = color").select("id", F.col("id").alias("component"), F.lit(True).alias("moved"))
        found = fixpoint(roots, gather, F.col("moved"), 1 << 20).select("id", "component")
        done.append(found)
        left = checkpoint(left.join(found, "id", "left_anti"))
        edges = checkpoint(edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
    if not done:
        return g.nodes.select("id", F.col("id").alias("component"))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def core_numbers(g: Graph) -> DataFrame:
    """(id, core) of the simple undirected view: whole components in batches, larger ones in rounds."""
    from . import parts

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        found = kernels.core_numbers(kernels.neighbours(zip(part["src"].tolist(), part["dst"].tolist())))
        return pd.DataFrame({"id": list(found), "core": list(found.values())}, dtype="int64")

    small, large = parts.split(g, g.pairs())
    found = small.groupBy("batch").applyInPandas(kernel, "id long, core long")
    if large is not None:
        found = found.unionAll(_core_rounds(parts.rest(g, large)))
    return g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("core", F.lit(0).cast("long")).alias("core"))


def _core_rounds(g: Graph) -> DataFrame:
    """(id, core) of nodes with neighbours.

    From the degrees, every node repeatedly takes the H-index of its
    neighbours' values, which settles at the core numbers (Lu et al., 2016).
    """
    links = g.simple().repartition("dst").persist()
    degree = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("core"))

    def step(state: DataFrame) -> DataFrame:
        offers = links.join(state.select(F.col("id").alias("dst"), F.col("core").alias("c")), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("c")))
        h = offers.withColumn("h", F.least(F.col("c"), above)).groupBy("id").agg(F.max("h").alias("h"))
        return state.join(h, "id").select("id", F.least("h", "core").alias("core"), (F.col("h") < F.col("core")).alias("moved"))

    found = fixpoint(degree.withColumn("moved", F.lit(True)), step, F.col("moved"), 1 << 20)
    links.unpersist()
    return found.select("id", "core")


def k_core(g: Graph, k: int) -> Graph:
    """The subgraph of nodes whose core number is at least ``k``; loops are dropped."""
    g.require_undirected("the k-core")
    from .transform import induced

    keep = core_numbers(g).filter(F.col("core") >= k).select("id")
    return Graph(g.nodes.join(keep, "id", "left_semi"), induced(g.edges.filter("src <> dst"), keep), False)


def bridges_and_articulation_points(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Bridges (u, v) with u < v, and articulation points (id), of the simple undirected view; a task takes a batch of components."""
    from . import parts

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        bridges, cuts = kernels.bridges_and_cuts(kernels.neighbours(zip(part["src"].tolist(), part["dst"].tolist())))
        return pd.DataFrame([(u, v) for u, v in bridges] + [(c, None) for c in cuts], columns=["u", "v"]).astype({"u": "Int64", "v": "Int64"})

    rows = materialise(by_component(g, g.pairs()), "parts")
    found = checkpoint(parts.batched(rows).groupBy("batch").applyInPandas(kernel, "u long, v long"))
    return found.filter("v is not null"), found.filter("v is null").select(F.col("u").alias("id"))


def two_coloring(g: Graph) -> DataFrame:
    """(id, color): parity of the distance to the smallest id of the component, for any graph."""
    links = g.simple().repartition("src").persist()

    def step(state: DataFrame) -> DataFrame:
        new = state.filter("moved").select(F.col("id").alias("src"), "hops").join(links, "src").select(F.col("dst").alias("id"), (F.col("hops") + 1).alias("hops"), F.lit(True).alias("moved"))
        both = state.select("id", "hops", F.lit(False).alias("moved")).unionAll(new)
        return both.groupBy("id").agg(F.min(F.struct("hops", "moved")).alias("b")).select("id", "b.hops", "b.moved")

    roots = weakly_connected(g).filter("id = component").select("id", F.lit(0).alias("hops"), F.lit(True).alias("moved"))
    found = fixpoint(roots, step, F.col("moved"), 1 << 20)
    links.unpersist()
    return found.select("id", (F.col("hops") % 2).cast("long").alias("color"))


def _sides(g: Graph) -> DataFrame | None:
    """(id, color) with colour 0 for the smallest id of each component; None where an edge joins nodes of one side."""
    if not g.edges.filter("src = dst").isEmpty():
        return None
    found = contracted(g.pairs() if g.distinct else checkpoint(g.pairs()), sides=True)
    if found is None:
        return None
    return checkpoint(g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce(F.col("p").cast("long"), F.lit(0).cast("long")).alias("color")))


def is_bipartite(g: Graph) -> DataFrame:
    """One row (bipartite)."""
    return g.spark.createDataFrame([(_sides(g) is not None,)], "bipartite boolean")


def bipartite_partition(g: Graph) -> DataFrame:
    """(id, color) with colour 0 for the smallest id of each component; raises NotBipartiteError."""
    colors = _sides(g)
    if colors is None:
        raise NotBipartiteError("an edge joins nodes of one side")
    return colors


def maximum_matching(g: Graph) -> DataFrame:
    """(left, right): a largest matching of a bipartite graph; left nodes have colour 0."""
    colors = bipartite_partition(g)
    color = F.col("color") == 0
    rows = g.pairs().join(colors.select(F.col("id").alias("src"), "color"), "src")
    edges = rows.select(F.when(color, F.col("src")).otherwise(F.col("dst")).alias("l"), F.when(color, F.col("dst")).otherwise(F.col("src")).alias("r"))
    return matching.largest(materialise(edges, "sides")).toDF("left", "right")


def layers(g: Graph) -> DataFrame:
    """(id, layer): rounds of removing nodes without predecessors; nodes on or behind cycles have no row."""
    edges = checkpoint(g.edges.select("src", "dst").distinct())
    left = checkpoint(g.nodes.select("id"))
    out = []
    while True:
        free = checkpoint(left.join(edges.select(F.col("dst").alias("id")), "id", "left_anti"))
        if free.isEmpty():
            break
        out.append(free.select("id", F.lit(len(out)).alias("layer")))
        left = checkpoint(left.join(free, "id", "left_anti"))
        edges = checkpoint(edges.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
    if not out:
        return g.nodes.select("id", F.lit(0).alias("layer")).limit(0)
    found = out[0]
    for o in out[1:]:
        found = found.unionAll(o)
    return found


def topological_sort(g: Graph, algorithm: str = "kahn") -> DataFrame:
    """(id, position) of a topological order, by (layer, id); raises CyclicGraphError.

    ``kahn`` and ``dfs`` are both valid orders of the same graph; each is
    served by the layered order.
    """
    if algorithm not in ("kahn", "dfs"):
        raise ValueError("algorithm must be kahn or dfs")
    from ..functions.ordering import with_row_numbers

    found = checkpoint(layers(g))
    if found.count() < g.n():
        raise CyclicGraphError("the graph has a cycle")
    return with_row_numbers(found, ["layer", "id"], "position").select("id", "position")


def is_acyclic(g: Graph) -> DataFrame:
    """One row (acyclic); a loop is a cycle, and so is an undirected edge."""
    found, n = layers(g), g.node_count()
    return found.agg(F.count(F.lit(1)).alias("k")).crossJoin(n).select((F.col("k") == F.col("node_count")).alias("acyclic"))  # one row each


def is_cyclic(g: Graph) -> DataFrame:
    return is_acyclic(g).select((~F.col("acyclic")).alias("cyclic"))


reachable = paths.reachable
