"""Structural metrics; scalars come as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import lowest_one, lowest_zero_index
from ..model import Graph
from ..storage import checkpoint
from . import triangles as three


def density(g: Graph) -> DataFrame:
    """Stored rows over n(n - 1); 0 below two nodes."""
    return g.node_count().crossJoin(g.edge_count()).select(
        F.when(F.col("node_count") < 2, F.lit(0.0)).otherwise(F.expr("try_divide(cast(edge_count as double), node_count * (node_count - 1))")).alias("density")
    )  # two one-row tables


def triangles(g: Graph, multi: bool = False) -> DataFrame:
    """(a, b, c): each triangle once, or once for each choice of parallel edges."""
    found = three.rows(g)
    if not multi:
        return found
    rows = g.edges.filter("src <> dst")
    if not g.directed:
        rows = rows.filter("src < dst")  # the other direction is the same edge
    times = rows.groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.count(F.lit(1)).alias("m"))
    for k, (s, t) in enumerate((("a", "b"), ("a", "c"), ("b", "c"))):
        here = found.withColumns({"x": F.least(s, t), "y": F.greatest(s, t)})
        found = here.join(times.withColumnRenamed("m", f"m{k}"), ["x", "y"]).drop("x", "y")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("m0 * m1 * m2")))).select("a", "b", "c")


def triangle_count(g: Graph, multi: bool = False) -> DataFrame:
    return triangles(g, multi).agg(F.count(F.lit(1)).alias("triangle_count")) if multi else three.count(g)


def local_clustering(g: Graph) -> DataFrame:
    """(id, score): the share of a node's neighbour pairs that are linked; 0 below two neighbours."""
    return g.nodes.select("id").join(three.corners(g), "id", "left").select(
        "id", F.when(F.col("k") >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("score")
    )


def average_clustering(g: Graph) -> DataFrame:
    return local_clustering(g).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_clustering"))


def assortativity(g: Graph) -> DataFrame:
    """Pearson correlation of the out-degrees at both ends of the stored rows; 0 where undefined."""
    d = g.out_degrees()
    ends = g.edges.join(d.select(F.col("id").alias("src"), F.col("degree").cast("double").alias("x")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").cast("double").alias("y")), "dst")
    sums = ends.agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(n) for n, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")), ("sxy", F.col("x") * F.col("y")))])
    vx, vy = F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    return sums.select(F.when((F.col("n") > 0) & (vx > 0) & (vy > 0), F.expr("n * sxy - sx * sy") / F.sqrt(vx * vy)).otherwise(0.0).alias("assortativity"))


def modularity(g: Graph, communities: DataFrame, weighted: bool = True) -> DataFrame:
    """Of a partition (id, community); nodes it lacks are in community 0."""
    member = g.nodes.select("id").join(communities.select("id", F.col("community").cast("long").alias("community")), "id", "left").select("id", F.coalesce("community", F.lit(0).cast("long")).alias("c"))
    weight = F.col("weight") if weighted else F.lit(1.0)
    e = g.edges.select("src", "dst", weight.alias("w")).join(member.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(member.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
    by = e.groupBy("cs").agg(F.sum("w").alias("deg"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = by.agg(F.sum("deg").alias("m2"))
    q = F.sum(F.expr("try_divide(inside, m2) - try_divide(deg, m2) * try_divide(deg, m2)"))
    return by.crossJoin(total).agg(F.coalesce(q, F.lit(0.0)).alias("modularity"))  # one row of totals


def community_density(g: Graph, communities: DataFrame) -> DataFrame:
    """(community, density): rows within over k(k - 1); 0 below two members."""
    member = communities.select("id", "community")
    inside = (
        g.edges.join(member.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(member.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
        .filter("a = b").groupBy(F.col("a").alias("community")).agg(F.count(F.lit(1)).alias("e"))
    )
    sizes = member.groupBy("community").agg(F.count(F.lit(1)).alias("k"))
    return sizes.join(inside, "community", "left").select("community", F.when(F.col("k") < 2, 0.0).otherwise(F.coalesce("e", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).alias("density"))


def degree_centrality(g: Graph, mode: str = "total") -> DataFrame:
    """(id, score): in, out or total degree over n - 1."""
    ends = {"out": ["src"], "in": ["dst"], "total": ["src", "dst"]}[mode]
    rows = g.edges.select(F.explode(F.array(*ends)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    n = g.node_count()
    return g.nodes.select("id").join(rows, "id", "left").crossJoin(n).select("id", F.when(F.col("node_count") > 1, F.coalesce("d", F.lit(0)) / (F.col("node_count") - 1)).otherwise(0.0).alias("score"))


def _hash32(x):
    return ((F.shiftrightunsigned(x, 16)).bitwiseXOR(x) * F.lit(0x45D9F3B)).bitwiseAND(F.lit(0xFFFFFFFF))


def anf_register(node: Column, i: int) -> Column:
    """One random bit for a node, lower bits likelier."""
    x = node.bitwiseXOR(F.lit(i).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
    x = _hash32(_hash32(x))
    x = F.shiftrightunsigned(x, 16).bitwiseXOR(x)
    x = F.when(x == 0, F.lit(1).cast("long")).otherwise(x)
    return F.least(lowest_one(x), F.lit(1 << 31))


def anf(g: Graph, registers: int = 64, max_steps: int = 30) -> DataFrame:
    """(step, size): estimated number of pairs within that many steps, by Flajolet-Martin registers; a row holds a node's registers."""
    links = g.edges.filter("src <> dst").select("src", "dst")
    if not g.distinct:
        links = links.distinct()
    names = [f"r{i}" for i in range(registers)]

    def estimate(state: DataFrame) -> float:
        z = sum((lowest_zero_index(F.col(r)) for r in names), F.lit(0)) / F.lit(float(registers))
        return state.agg(F.coalesce(F.sum(F.pow(F.lit(2.0), z)), F.lit(0.0)) / F.lit(0.77351)).first()[0]

    def step(state: DataFrame) -> DataFrame:
        seen = state.select(F.col("id").alias("dst"), *names).join(links, "dst").groupBy(F.col("src").alias("id")).agg(*[F.bit_or(r).alias(f"_{r}") for r in names])
        merged = state.select("id", *names).join(seen, "id", "left")
        new = [F.coalesce(F.col(r).bitwiseOR(F.col(f"_{r}")), F.col(r)) for r in names]
        moved = F.coalesce(sum((F.when(n != F.col(r), 1).otherwise(0) for r, n in zip(names, new)), F.lit(0)) > 0, F.lit(False))
        return merged.select("id", *[n.alias(r) for r, n in zip(names, new)], moved.alias("moved"))

    state = checkpoint(g.nodes.select("id", *[anf_register(F.col("id"), i).alias(r) for i, r in enumerate(names)]))
    sizes = [estimate(state)]
    for _ in range(max_steps):
        state = checkpoint(step(state))
        if state.filter("moved").isEmpty():
            break
        sizes.append(estimate(state))
    return g.spark.createDataFrame(list(enumerate(sizes)), "step int, size double")


def effective_diameter(sizes: DataFrame, share: float = 0.9) -> DataFrame:
    """The interpolated number of steps that reach ``share`` of all reachable pairs."""
    rows = sorted((r[0], r[1]) for r in sizes.collect())  # a row per step, ``max_steps`` at most
    goal, found = share * rows[-1][1], float(rows[-1][0])
    for (_, low), (t, high) in zip([(-1, 0.0), *rows], rows):
        if high >= goal:
            found = float(t) if t == 0 or high == low else t - 1 + (goal - low) / (high - low)
            break
    return sizes.sparkSession.createDataFrame([(found,)], "effective_diameter double")
