"""Shortest paths and reachability.

One relaxation serves all of it: rows (src, dst, dist) for any set of sources
are improved along edges, only from what changed in the round before, until
nothing changes.  Negative weights need no potentials; a negative cycle shows
as rows that still move after n rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import HEURISTICS, heuristic
from ..loop import fixpoint
from ..model import Graph, NegativeCycleError
from ..storage import checkpoint


def relax(g: Graph, sources: DataFrame, *, tolerate_negative: bool = True) -> DataFrame:
    """(src, dst, dist): least weights of walks from each of ``sources`` (id); unreachable pairs have no row."""
    if not tolerate_negative and not g.edges.filter("weight < 0").isEmpty():
        raise ValueError("weights must not be negative")
    steps = g.edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")).select(F.col("src").alias("via"), F.col("dst").alias("to"), "weight").repartition("via").persist()

    def step(state: DataFrame) -> DataFrame:
        moved = state.filter("moved").select("src", F.col("dst").alias("via"), "dist").join(steps, "via")
        offers = moved.select("src", F.col("to").alias("dst"), (F.col("dist") + F.col("weight")).alias("dist"), F.lit(None).cast("double").alias("own"))
        held = state.select("src", "dst", "dist", F.col("dist").alias("own"))
        best = held.unionAll(offers).groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.max("own").alias("own"))
        return best.select("src", "dst", "dist", (F.col("own").isNull() | (F.col("dist") < F.col("own"))).alias("moved"))

    start = sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"), F.lit(True).alias("moved"))
    out = fixpoint(start, step, F.col("moved"), max(1, g.n()), NegativeCycleError("a cycle of negative weight is reachable"))
    steps.unpersist()
    return out.select("src", "dst", "dist")


def johnson(g: Graph) -> DataFrame:
    """All pairs (src, dst, dist) by relaxation from every node: for sparse graphs."""
    return relax(g, g.nodes.select("id"))


all_pairs = johnson


def floyd_warshall(g: Graph) -> DataFrame:
    """All pairs by min-plus squaring, in about log2(n) rounds: for dense graphs."""
    loops = g.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"))
    best = checkpoint(g.edges.select("src", "dst", F.col("weight").alias("dist")).unionAll(loops).groupBy("src", "dst").agg(F.min("dist").alias("dist")))
    hops, n = 1, max(1, g.n())
    while True:
        if not best.filter("src = dst and dist < 0").isEmpty():
            raise NegativeCycleError("the graph has a cycle of negative weight")
        if hops >= n:
            return best
        a = best.select("src", F.col("dst").alias("via"), F.col("dist").alias("d1"))
        b = best.select(F.col("src").alias("via"), "dst", F.col("dist").alias("d2"))
        both = a.join(b, "via").groupBy("src", "dst").agg(F.min(F.col("d1") + F.col("d2")).alias("dist"))
        before, best = best, checkpoint(both)
        hops *= 2
        if before.join(best, ["src", "dst", "dist"]).count() == best.count():
            hops = n


def _single(g: Graph, start: int, goal: int, bound: DataFrame | None) -> DataFrame:
    """Rows (v, best) with best = (dist, hops, prev) from ``start``; ``bound`` (id, h) prunes what can't beat the goal."""
    steps = g.edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")).persist()
    kind = "struct<dist:double,hops:int,prev:long>"

    def step(state: DataFrame) -> DataFrame:
        moved = state.filter("moved").select(F.col("v").alias("src"), "best").join(steps, "src")
        offer = F.struct((F.col("best.dist") + F.col("weight")).alias("dist"), (F.col("best.hops") + 1).alias("hops"), F.col("src").alias("prev"))
        offers = moved.select(F.col("dst").alias("v"), offer.alias("best"), F.lit(None).cast(kind).alias("own"))
        if bound is not None:
            reached = state.filter(F.col("v") == goal).agg(F.min("best.dist").alias("limit"))
            offers = offers.join(bound.withColumnRenamed("id", "v"), "v").crossJoin(F.broadcast(reached))  # one row
            offers = offers.filter("limit is null or best.dist + h < limit").select("v", "best", "own")
        held = state.select("v", "best", F.col("best").alias("own"))
        new = held.unionAll(offers).groupBy("v").agg(F.min("best").alias("best"), F.max("own").alias("own"))
        return new.select("v", "best", (F.col("own").isNull() | (F.col("best.dist") < F.col("own.dist"))).alias("moved"))

    first = g.spark.createDataFrame([(start,)], "v long").select("v", F.struct(F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(-1).cast("long").alias("prev")).alias("best"), F.lit(True).alias("moved"))
    out = fixpoint(first, step, F.col("moved"), max(1, g.n()), NegativeCycleError("a cycle of negative weight is reachable from the start"))
    steps.unpersist()
    return out


def _path(g: Graph, start, goal, bound: DataFrame | None = None) -> DataFrame:
    label = g.nodes.schema["label"].dataType
    schema = f"path array<{label.simpleString()}>, weight double"
    a, b = g.id_of(start), g.id_of(goal)
    if a is None or b is None:
        return g.spark.createDataFrame([], schema)
    if a == b and bound is not None:
        return g.spark.createDataFrame([([start], 0.0)], schema)
    found = _single(g, a, b, bound)
    last = found.filter(F.col("v") == b).first()
    if last is None:
        return g.spark.createDataFrame([], schema)
    if a == b:
        return g.spark.createDataFrame([([start], 0.0)], schema)
    ids, row = [b], last
    while row["best"]["prev"] >= 0 and ids[-1] != a:  # one look-up per hop of the result
        ids.append(row["best"]["prev"])
        row = found.filter(F.col("v") == ids[-1]).first()
    spots = g.spark.createDataFrame(list(enumerate(reversed(ids))), "at int, id long")
    ordered = spots.join(g.nodes.select("id", "label"), "id").agg(F.sort_array(F.collect_list(F.struct("at", "label"))).alias("rows"))
    return ordered.select(F.col("rows.label").alias("path"), F.lit(last["best"]["dist"]).alias("weight"))


def dijkstra(g: Graph, start, goal) -> DataFrame:
    """One row (path, weight), labels from start to goal; no row without a path.  Weights must not be negative."""
    if not g.edges.filter("weight < 0").isEmpty():
        raise ValueError("weights must not be negative")
    return _path(g, start, goal)


def bellman_ford(g: Graph, start, goal) -> DataFrame:
    """As ``dijkstra``, with negative weights; a negative cycle reachable from the start raises NegativeCycleError."""
    return _path(g, start, goal)


def astar(g: Graph, start, goal, kind: str = "euclidean") -> DataFrame:
    """As ``dijkstra``, leaving out what the heuristic shows to be no better than the goal; nodes need x and y."""
    if kind not in HEURISTICS:
        raise ValueError(f"heuristic must be one of {', '.join(HEURISTICS)}")
    if not {"x", "y"} <= set(g.nodes.columns) or not g.nodes.filter("x is null or y is null").isEmpty():
        raise ValueError("every node needs coordinates x and y")
    at = g.nodes.filter(F.col("label") == F.lit(goal)).select("x", "y").first()
    if at is None:
        return _path(g, start, goal)
    bound = g.nodes.select("id", heuristic(kind, F.col("x"), F.col("y"), at[0], at[1]).alias("h"))
    return _path(g, start, goal, bound)


def reach(g: Graph, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """(src, dst, hops): everything within ``rounds`` hops of each source (id), itself included."""
    links = g.edges.filter("src <> dst").select(F.col("src").alias("via"), F.col("dst").alias("to")).distinct().repartition("via").persist()

    def step(state: DataFrame) -> DataFrame:
        new = state.filter("moved").select("src", F.col("dst").alias("via"), "hops").join(links, "via").select("src", F.col("to").alias("dst"), (F.col("hops") + 1).alias("hops"), F.lit(True).alias("moved"))
        all_rows = state.select("src", "dst", "hops", F.lit(False).alias("moved")).unionAll(new)
        return all_rows.groupBy("src", "dst").agg(F.min(F.struct("hops", "moved")).alias("b")).select("src", "dst", "b.hops", "b.moved")

    start = sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("hops"), F.lit(True).alias("moved"))
    out = fixpoint(start, step, F.col("moved"), max(1, g.n()) if rounds is None else rounds)
    links.unpersist()
    return out.select("src", "dst", "hops")


def reachable(g: Graph, start, goal) -> DataFrame:
    """One row (reachable): whether a walk leads from start to goal; false for unknown labels."""
    a, b = g.id_of(start), g.id_of(goal)
    found = False
    if a is not None and b is not None:
        found = not reach(g, g.spark.createDataFrame([(a,)], "id long")).filter(F.col("dst") == b).isEmpty()
    return g.spark.createDataFrame([(found,)], "reachable boolean")
