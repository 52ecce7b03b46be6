"""Centrality scores: (id, score) for every node."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..loop import power_iteration
from ..model import Graph
from ..storage import checkpoint
from . import kernels, parts, paths


def _links(g: Graph) -> DataFrame:
    """Edges with the out-degree of their source, partitioned once for all rounds."""
    degree = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    return g.edges.select("src", "dst").join(degree, "src").repartition("src").persist()


def _received(state: DataFrame, links: DataFrame, share: Column) -> DataFrame:
    """(id, sum): what every node receives from its in-neighbours."""
    sent = state.select(F.col("id").alias("src"), "score").join(links, "src")
    return sent.groupBy(F.col("dst").alias("id")).agg(F.sum(share).alias("sum"))


def pagerank(g: Graph, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """Unweighted PageRank; sinks spread their rank over all nodes."""
    n = g.n()
    if n < 2:
        return g.nodes.select("id", F.lit(1.0).alias("score"))
    links = _links(g)
    sinks = g.nodes.select("id").join(links.select(F.col("src").alias("id")).distinct(), "id", "left_anti").withColumn("sink", F.lit(True))
    start = g.nodes.select("id").join(sinks, "id", "left").select("id", F.coalesce("sink", F.lit(False)).alias("sink"), F.lit(1.0 / n).alias("score"), F.lit(0.0).alias("moved"))

    def step(state: DataFrame) -> DataFrame:
        lost = state.filter("sink").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        got = _received(state, links, F.col("score") / F.col("out"))
        new = F.lit((1 - damping) / n) + damping * (F.col("lost") / n + F.coalesce("sum", F.lit(0.0)))
        rows = state.join(got, "id", "left").crossJoin(F.broadcast(lost))  # one row
        return rows.select("id", "sink", new.alias("score"), F.abs(new - F.col("score")).alias("moved"))

    out = power_iteration(start, step, F.sum("moved"), tolerance, max_iterations)
    links.unpersist()
    return out.select("id", "score")


def _linear(g: Graph, start: float, alpha: float, beta: float, max_iterations: int, tolerance: float) -> DataFrame:
    links = _links(g)
    state = g.nodes.select("id", F.lit(float(start)).alias("score"), F.lit(0.0).alias("moved"))

    def step(state: DataFrame) -> DataFrame:
        got = _received(state, links, F.col("score"))
        new = F.lit(float(alpha)) * F.coalesce("sum", F.lit(0.0)) + F.lit(float(beta))
        return state.join(got, "id", "left").select("id", new.alias("score"), F.abs(new - F.col("score")).alias("moved"))

    out = power_iteration(state, step, F.sum("moved"), tolerance, max_iterations)
    links.unpersist()
    return out.select("id", "score")


def katz(g: Graph, alpha: float = 0.1, beta: float = 1.0, max_iterations: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """x = alpha * (sum over in-neighbours) + beta."""
    return _linear(g, beta, alpha, beta, max_iterations, tolerance)


def alpha_centrality(g: Graph, alpha: float = 0.5, initial: float = 1.0, max_iterations: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """x = alpha * (sum over in-neighbours), from ``initial``; without an outside term."""
    return _linear(g, initial, alpha, 0.0, max_iterations, tolerance)


def eigenvector(g: Graph, max_iterations: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """Power iteration over in-neighbours from 1 + i / 1000 (i: rank of the id).

    A zero vector becomes uniform; where the vector swings between two states,
    the normalised mean of both is the result.
    """
    from ..functions.ordering import with_row_numbers

    n = g.n()
    if n < 2:
        return g.nodes.select("id", F.lit(1.0).alias("score"))
    links = _links(g)
    start = with_row_numbers(g.nodes.select("id"), ["id"], "i")
    state = checkpoint(start.select("id", (1.0 + F.col("i") / 1000.0).alias("score"), F.lit(0.0).alias("last")))
    for _ in range(max_iterations):
        got = _received(state, links, F.col("score"))
        raw = checkpoint(state.join(got, "id", "left").select("id", F.coalesce("sum", F.lit(0.0)).alias("new"), F.col("score").alias("was"), F.col("last").alias("before")))
        norm = raw.agg(F.sqrt(F.sum(F.col("new") * F.col("new")))).first()[0]
        scaled = F.col("new") / F.lit(norm) if norm > 0 else F.lit(n**-0.5)
        state = checkpoint(raw.select("id", scaled.alias("score"), F.col("was").alias("last"), "before"))
        one, two, both = state.agg(
            F.sqrt(F.sum(F.pow(F.col("score") - F.col("last"), 2))), F.sqrt(F.sum(F.pow(F.col("score") - F.col("before"), 2))), F.sqrt(F.sum(F.pow((F.col("score") + F.col("last")) / 2, 2)))
        ).first()
        if one < tolerance or norm == 0:
            break
        if two < tolerance and both > 0:
            state = state.select("id", ((F.col("score") + F.col("last")) / 2 / F.lit(both)).alias("score"))
            break
    links.unpersist()
    return state.select("id", "score")


def closeness(g: Graph) -> DataFrame:
    """(n - 1) over the sum of distances; 0 unless a node reaches all others."""
    n = g.n()
    if n < 2:
        return g.nodes.select("id", F.lit(0.0).alias("score"))
    sums = paths.all_pairs(g).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("reached"), F.sum("dist").alias("total"))
    return g.nodes.select("id").join(sums, "id", "left").select("id", F.when((F.col("reached") == n) & (F.col("total") > 0), F.lit(float(n - 1)) / F.col("total")).otherwise(0.0).alias("score"))


def harmonic(g: Graph) -> DataFrame:
    """Sum of inverse distances to other nodes, over n - 1; zero distances don't count."""
    n = g.n()
    if n < 2:
        return g.nodes.select("id", F.lit(0.0).alias("score"))
    sums = paths.all_pairs(g).filter("dist > 0").groupBy(F.col("src").alias("id")).agg(F.sum(1.0 / F.col("dist")).alias("total"))
    return g.nodes.select("id").join(sums, "id", "left").select("id", (F.coalesce("total", F.lit(0.0)) / (n - 1)).alias("score"))


def betweenness(g: Graph, weighted: bool = False) -> DataFrame:
    """Brandes' betweenness, ends excluded, halved for undirected graphs: whole components in batches, larger ones by rounds.

    Weights must be positive; parallel edges count apart.
    """
    if g.n() < 3:
        return g.nodes.select("id", F.lit(0.0).alias("score"))
    if weighted and not g.edges.filter("weight <= 0").isEmpty():
        raise ValueError("weighted betweenness needs positive weights")

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        found = kernels.betweenness(zip(part["src"].tolist(), part["dst"].tolist(), part["weight"].tolist()), weighted)
        return pd.DataFrame({"id": pd.Series(list(found), dtype="int64"), "total": pd.Series(list(found.values()), dtype="float64")})

    small, large = parts.split(g, g.edges.filter("src <> dst").select("src", "dst", F.col("weight") if weighted else F.lit(1.0).alias("weight")))
    total = small.groupBy("batch").applyInPandas(kernel, "id long, total double")
    if large is not None:
        total = total.unionAll(_dependencies(parts.rest(g, large, True)))
    return g.nodes.select("id").join(total, "id", "left").select("id", (F.coalesce("total", F.lit(0.0)) * (1.0 if g.directed else 0.5)).alias("score"))


def _dependencies(g: Graph) -> DataFrame:
    """(id, total): the dependencies of all sources on a node, for components too large for a task.

    Shortest-path edges come from all-pairs distances; path counts flow
    forward and dependencies backward over them, by number of hops, for all
    sources at once.
    """
    edges = g.edges
    dist = checkpoint(paths.relax(Graph(g.nodes, edges, True), g.nodes.select("id"), tolerate_negative=False))
    a = dist.select(F.col("src").alias("s"), F.col("dst").alias("u"), F.col("dist").alias("du"))
    b = dist.select(F.col("src").alias("s"), F.col("dst").alias("v"), F.col("dist").alias("dv"))
    tight = a.join(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight"), "u").join(b, ["s", "v"]).filter("du + weight = dv").select("s", "u", "v")
    tight = checkpoint(tight)
    # path counts by number of hops, summed over hop counts
    front = checkpoint(g.nodes.select(F.col("id").alias("s"), F.col("id").alias("u"), F.lit(1.0).alias("sigma")))
    fronts = []
    while not front.isEmpty():
        fronts.append(front)
        front = checkpoint(front.join(tight, ["s", "u"]).groupBy("s", F.col("v").alias("u")).agg(F.sum("sigma").alias("sigma")))
    sigma = fronts[0]
    for f in fronts[1:]:
        sigma = sigma.unionAll(f)
    sigma = checkpoint(sigma.groupBy("s", "u").agg(F.sum("sigma").alias("sigma")))
    share = tight.join(sigma.select("s", "u", F.col("sigma").alias("su")), ["s", "u"]).join(sigma.select("s", F.col("u").alias("v"), F.col("sigma").alias("sv")), ["s", "v"])
    share = checkpoint(share.select("s", "u", "v", (F.col("su") / F.col("sv")).alias("share")))
    # every node's own unit of dependency walks back along the shares
    wave = checkpoint(sigma.filter("s <> u").select("s", F.col("u").alias("v"), F.lit(1.0).alias("unit")))
    waves = []
    while True:
        wave = checkpoint(wave.join(share, ["s", "v"]).filter("u <> s").groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("unit") * F.col("share")).alias("unit")))
        if wave.isEmpty():
            break
        waves.append(wave)
    if not waves:
        return g.nodes.select("id", F.lit(0.0).alias("total"))
    total = waves[0]
    for w in waves[1:]:
        total = total.unionAll(w)
    return total.groupBy(F.col("v").alias("id")).agg(F.sum("unit").alias("total"))
