"""Queries over the driver's tables, one or more for each operator, and their SQL.

Every query returns plain columns; floating results are rounded to six places
on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import centrality, cliques, community, connectivity, flow, health, metrics, mst, paths, transform
from ..sources import files, generators
from ..storage import checkpoint, fresh_path
from . import graphs as G

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, graph: Callable[..., Graph], run: Callable[[Graph], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, sf_dir: run(graph(spark, sf_dir))
    if sql is not None:
        _SQL[name] = sql


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _score(df: DataFrame) -> DataFrame:
    return _rounded(df.select("id", "score"), "score")


# --- counts and degrees ----------------------------------------------------

_query("node_count", G.copurchase_full, lambda g: g.node_count(), f"with {G.COPURCHASE_FULL} select count(*) as node_count from v")
_query("edge_count", G.copurchase_full, lambda g: g.edge_count(), f"with {G.COPURCHASE_FULL} select count(*) as edge_count from e")
_query("node_degrees", G.copurchase_full, lambda g: g.out_degrees(), f"with {G.COPURCHASE_FULL} select id, count(src)::bigint as degree from v left join e on id = src group by id")
_query("labels_and_ids", G.event_flow, lambda g: g.nodes.select("id", "label"), f"with {G.EVENT_FLOW} select id, label from names")
_query("in_degrees", G.journeys, lambda g: g.in_degrees(), f"with {G.JOURNEYS} select id, count(dst)::bigint as degree from v left join e on id = dst group by id")
_query("predecessors", G.event_flow, lambda g: g.predecessors(g.label_of(0)), f"with {G.EVENT_FLOW} select label, w as weight from e join names on id = src where dst = 0")
_query("all_edges", G.event_flow, lambda g: g.all_edges(), f"with {G.EVENT_FLOW} select a as source, b as target, w as weight from flow")
_query(
    "degree_centrality", G.journeys, lambda g: _score(metrics.degree_centrality(g)),
    f"with {G.JOURNEYS}, d as (select src as a from e union all select dst from e) select id, round(count(a) / ((select count(*) from v) - 1.0), 6)::double as score from v left join d on a = id group by id",
)

# --- metrics ------------------------------------------------------------------

_query("density", G.copurchase_full, lambda g: _rounded(metrics.density(g), "density"), f"with {G.COPURCHASE_FULL} select round((select count(*) from e)::double / (n * (n - 1)), 6) as density from (select count(*) as n from v)")
_TRIANGLES = "select count(*) as triangle_count from e a join e b on a.dst = b.src and a.src < a.dst and b.src < b.dst join e c on c.src = a.src and c.dst = b.dst"
_query("triangle_count", G.copurchase_full, metrics.triangle_count, f"with {G.COPURCHASE_FULL} {_TRIANGLES}")
_CLUSTERING = (
    "k as (select src as id, count(*) as k from e group by 1), t as (select a.src as id, count(*) as t from e a join e b on a.src = b.src and a.dst < b.dst join e c on c.src = a.dst and c.dst = b.dst group by 1), "
    "cc as (select k.id, case when k >= 2 then 2.0 * coalesce(t, 0) / (k * (k - 1)) else 0 end::double as score from k left join t using (id))"
)
_query("local_clustering", G.copurchase_full, lambda g: _score(metrics.local_clustering(g)), f"with {G.COPURCHASE_FULL}, {_CLUSTERING} select id, round(score, 6) as score from cc")
_query("average_clustering", G.copurchase_full, lambda g: _rounded(metrics.average_clustering(g), "average_clustering"), f"with {G.COPURCHASE_FULL}, {_CLUSTERING} select round(avg(score), 6) as average_clustering from cc")
_query(
    "assortativity", G.copurchase_full, lambda g: _rounded(metrics.assortativity(g), "assortativity"),
    f"with {G.COPURCHASE_FULL}, k as (select src as id, count(*)::double as k from e group by 1) select round(corr(a.k, b.k), 6) as assortativity from e join k a on a.id = src join k b on b.id = dst",
)
_REGION = "m as (select n_nationkey::bigint as id, n_regionkey as c from nation)"


def _modularity_sql(weight: str) -> str:
    return (
        f"with {G.TRADE_FULL}, {_REGION}, x as (select a.c as c, sum({weight}) as deg, sum(case when a.c = b.c then {weight} else 0 end) as ins from e join m a on a.id = src join m b on b.id = dst group by 1), "
        "t as (select sum(deg) as m2 from x) select round(sum(ins / m2 - (deg / m2) * (deg / m2)), 6) as modularity from x, t"
    )


_QUERIES["modularity"] = lambda spark, d: _rounded(metrics.modularity(G.trade_full(spark, d), G.regions(spark, d)), "modularity")
_SQL["modularity"] = _modularity_sql("w")
_QUERIES["modularity_unweighted"] = lambda spark, d: _rounded(metrics.modularity(G.trade_full(spark, d), G.regions(spark, d), weighted=False), "modularity")
_SQL["modularity_unweighted"] = _modularity_sql("1.0::double")
_QUERIES["community_density"] = lambda spark, d: _rounded(metrics.community_density(G.trade_full(spark, d), G.regions(spark, d)), "density")
_SQL["community_density"] = (
    f"with {G.TRADE_FULL}, {_REGION}, k as (select c, count(*) as k from m group by 1), i as (select a.c, count(*) as n from e join m a on a.id = src join m b on b.id = dst and b.c = a.c group by 1) "
    "select k.c::bigint as community, round(case when k < 2 then 0 else coalesce(n, 0)::double / (k * (k - 1)) end, 6)::double as density from k left join i on i.c = k.c"
)


def _anf_sql(registers: int, steps: int) -> str:
    def mul(x: str) -> str:
        return f"((xor({x}, {x} >> 16) * 73244475) & 4294967295)"

    ctes = [
        f"h0 as (select id, i, xor(id, i)::bigint & 4294967295 as x from v, range({registers}) r(i))",
        f"h1 as (select id, i, {mul('x')} as x from h0)", f"h2 as (select id, i, {mul('x')} as x from h1)",
        "h3 as (select id, i, case when xor(x, x >> 16) = 0 then 1 else xor(x, x >> 16) end as x from h2)",
        "r0 as materialized (select id, i, least(x & (-x), 2147483648) as reg from h3)",
    ]
    for k in range(1, steps + 1):
        ctes.append(f"r{k} as materialized (select id, i, bit_or(reg) as reg from (select * from r{k - 1} union all select e.src, r.i, r.reg from e join r{k - 1} r on r.id = e.dst) group by 1, 2)")
    parts = [f"select {k} as step, sum(pow(2, z)) / 0.77351 as size from (select id, avg(bit_count(xor(reg, reg + 1)) - 1) as z from r{k} group by 1)" for k in range(steps + 1)]
    return f"with {G.JOURNEYS_UNDIRECTED}, {', '.join(ctes)} select step::int as step, round(size, 4) as size from ({' union all '.join(parts)})"


_query("anf", G.journeys_undirected, lambda g: _rounded(metrics.anf(g, 16, 4), "size", digits=4), _anf_sql(16, 4))
_query("effective_diameter", G.trade, lambda g: _rounded(metrics.effective_diameter(metrics.anf(g)), "effective_diameter"))

# --- centrality -----------------------------------------------------------------

_OUT = "o as (select src, count(*)::double as k from e group by 1)"


def _rounds_sql(graph: str, start: str, step: str, rounds: int, extra: str = "") -> str:
    ctes = [f"x0 as (select id, {start} as s from v)"]
    for k in range(1, rounds + 1):
        ctes.append(f"x{k} as materialized (" + step.format(x=f"x{k - 1}") + ")")
    return f"with {graph}{extra}, {', '.join(ctes)} select id, round(s, 6) as score from x{rounds}"


_PAGERANK = (
    "select v.id, 0.15 / n.n + 0.85 * (coalesce((select sum(s) from {x} where id not in (select src from o)), 0) / n.n + coalesce(r.s, 0)) as s from v cross join n "
    "left join (select e.dst as id, sum({x}.s / o.k) as s from e join {x} on {x}.id = e.src join o on o.src = e.src group by 1) r on r.id = v.id"
)
_N = ", n as (select count(*)::double as n from v)"
_query("pagerank", G.journeys, lambda g: _score(centrality.pagerank(g, max_iterations=10, tolerance=0)), _rounds_sql(G.JOURNEYS, "1.0 / (select n from n)", _PAGERANK, 10, f"{_N}, {_OUT}"))
_query("pagerank_copurchase", G.copurchase_full, lambda g: _score(centrality.pagerank(g, max_iterations=6, tolerance=0)), _rounds_sql(G.COPURCHASE_FULL, "1.0 / (select n from n)", _PAGERANK, 6, f"{_N}, {_OUT}"))
_LINEAR = "select v.id, {{a}} * coalesce(r.s, 0) + {{b}} as s from v left join (select e.dst as id, sum({x}.s) as s from e join {x} on {x}.id = e.src group by 1) r on r.id = v.id"
_query("katz", G.journeys, lambda g: _score(centrality.katz(g, max_iterations=8, tolerance=0)), _rounds_sql(G.JOURNEYS, "1.0::double", _LINEAR.replace("{{a}}", "0.1::double").replace("{{b}}", "1.0"), 8))
_query("alpha_centrality", G.journeys, lambda g: _score(centrality.alpha_centrality(g, max_iterations=6, tolerance=0)), _rounds_sql(G.JOURNEYS, "1.0::double", _LINEAR.replace("{{a}}", "0.5::double").replace("{{b}}", "0"), 6))
_EIGEN = (
    "with q as (select v.id, coalesce(r.s, 0) as s from v left join (select e.dst as id, sum({x}.s) as s from e join {x} on {x}.id = e.src group by 1) r on r.id = v.id) "
    "select id, s / (select sqrt(sum(s * s)) from q) as s from q"
)
_query("eigenvector", G.trade, lambda g: _score(centrality.eigenvector(g, max_iterations=5, tolerance=0)), _rounds_sql(G.TRADE, "(1.0 + (row_number() over (order by id) - 1) / 1000.0)::double", _EIGEN, 5))


def _distances_sql(graph: str, weight: str = "w", doublings: int = 5, name: str = "dist") -> str:
    """``dist`` (s, t, d): shortest distances by repeated squaring, 2**doublings hops at most."""
    ctes = [f"d0 as materialized (select s, t, min(d) as d from (select src as s, dst as t, {weight} as d from e union all select id, id, 0.0::double from v) group by 1, 2)"]
    for k in range(1, doublings + 1):
        ctes.append(f"{name if k == doublings else f'd{k}'} as materialized (select a.s, b.t, min(a.d + b.d) as d from d{k - 1} a join d{k - 1} b on a.t = b.s group by 1, 2)")
    return f"with {graph}, {', '.join(ctes)}"


_query("closeness", G.trade, lambda g: _score(centrality.closeness(g)), _distances_sql(G.TRADE) + ", n as (select count(*) as n from v) select s as id, round(case when count(*) = max(n) and sum(d) > 0 then (max(n) - 1) / sum(d) else 0 end, 6)::double as score from dist, n group by 1")
_query("harmonic", G.trade, lambda g: _score(centrality.harmonic(g)), _distances_sql(G.TRADE) + ", n as (select count(*) as n from v) select s as id, round(coalesce(sum(1 / d) filter (d > 0), 0) / (max(n) - 1), 6)::double as score from dist, n group by 1")


def _betweenness_sql(graph: str, weight: str) -> str:
    return (
        _distances_sql(graph, weight).replace("with ", "with recursive ", 1)
        + f", walk(s, t, d) as (select id, id, 0.0::double from v union all select p.s, e.dst, p.d + {weight} from walk p join e on e.src = p.t join dist x on x.s = p.s and x.t = e.dst and x.d = p.d + {weight} where e.dst <> p.s), "
        "sigma as (select s, t, count(*)::double as n, any_value(d) as d from walk group by 1, 2) "
        "select v.id, round(coalesce(b, 0), 6) as score from v left join (select a.t as id, sum(a.n * b.n / c.n) as b from sigma a join sigma b on a.t = b.s join sigma c on c.s = a.s and c.t = b.t and c.d = a.d + b.d "
        "where a.t <> a.s and a.t <> b.t and a.s <> b.t group by 1) x on x.id = v.id"
    )


_query("betweenness", G.journeys, lambda g: _score(centrality.betweenness(g)), _betweenness_sql(G.JOURNEYS, "1.0::double"))
_query("betweenness_weighted", G.trade, lambda g: _score(centrality.betweenness(g, weighted=True)), _betweenness_sql(G.TRADE, "w"))

# --- paths and health -------------------------------------------------------------

_PAIRS = " select s as src, t as dst, round(d, 6) as dist from dist"
_query("floyd_warshall", G.trade, lambda g: _rounded(paths.floyd_warshall(g), "dist"), _distances_sql(G.TRADE) + _PAIRS)
_query("johnson", G.trade, lambda g: _rounded(paths.johnson(g), "dist"), _distances_sql(G.TRADE) + _PAIRS)
_FROM_TO = _distances_sql(G.TRADE) + " select round(d, 6) as weight from dist where s = {a} and t = {b}"


_query("dijkstra", G.trade, lambda g: _rounded(paths.dijkstra(g, 0, 7).select("weight"), "weight"), _FROM_TO.format(a=0, b=7))
_query("dijkstra_full", G.trade_full, lambda g: _rounded(paths.dijkstra(g, 3, 12).select("weight"), "weight"), _distances_sql(G.TRADE_FULL) + " select round(d, 6) as weight from dist where s = 3 and t = 12")


def _bellman_ford(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first to the last order of the first customer, over steps of which some have negative weights; the path's own sum as well."""
    g = G.order_dag(spark, sf_dir, skips=True)
    weighted = Graph(g.nodes, g.edges.withColumn("weight", F.expr("cast((src * 7 + dst * 13) % 19 - 6 as double)")), True)
    orders = G.table(spark, sf_dir, "orders")
    own = orders.filter(F.col("o_custkey") == orders.agg(F.min("o_custkey")).first()[0])
    when = F.struct("o_orderdate", "o_orderkey")
    start, goal = own.agg(F.min_by("o_orderkey", when), F.max_by("o_orderkey", when)).first()
    found = paths.bellman_ford(weighted, start, goal)
    steps = found.select("weight", F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path") - 1).alias("dst"))).alias("s"))
    along = steps.select(F.col("weight").alias("found"), "s.src", "s.dst").join(weighted.edges, ["src", "dst"])
    return along.groupBy(F.col("found").alias("weight")).agg(F.sum("weight").alias("path_weight"))


_QUERIES["bellman_ford"] = _bellman_ford
_SQL["bellman_ford"] = (
    f"with {G.ORDER_DAG_SKIPS.replace('pairs as', 'steps as', 1).replace('from pairs', 'from steps')}, own as (select o_orderkey as id, o_orderdate as day from orders where o_custkey = (select min(o_custkey) from orders)), "
    "d0 as materialized (select src as s, dst as t, ((src * 7 + dst * 13) % 19 - 6)::double as d from e where src in (select id from own) union all select id, id, 0.0::double from own), "
    + ", ".join(f"d{k} as materialized (select a.s, b.t, min(a.d + b.d) as d from d{k - 1} a join d{k - 1} b on a.t = b.s group by 1, 2)" for k in range(1, 8))
    + " select d as weight, d as path_weight from d7 where s = (select id from own order by day, id limit 1) and t = (select id from own order by day desc, id desc limit 1)"
)

def _astar(spark: SparkSession) -> DataFrame:
    g = generators.grid_2d(spark, 6, 7)
    flat = Graph(g.nodes.select("id", F.col("id").alias("label"), "x", "y"), g.edges, False)
    return paths.astar(flat, 0, 41, "manhattan").select("weight", F.size("path").alias("hops"))


_QUERIES["astar"] = lambda spark, d: _astar(spark)
_SQL["astar"] = "select 11.0::double as weight, 12::int as hops"
_query("reachable", G.trade, lambda g: paths.reachable(g, 0, 7), _distances_sql(G.TRADE) + " select count(*) > 0 as reachable from dist where s = 0 and t = 7")
_query("eccentricity", G.trade, lambda g: _rounded(health.eccentricity(g), "eccentricity"), _distances_sql(G.TRADE) + " select s as id, round(max(d), 6) as eccentricity from dist group by 1")
_HEALTH = _distances_sql(G.TRADE) + ", x as (select s, max(d) as m from dist group by 1) "
_query(
    "health_metrics", G.trade, lambda g: _rounded(health.analyze(g), "diameter", "radius", "average_path_length"),
    _HEALTH + "select round(max(m), 6) as diameter, round(min(m), 6) as radius, (select round(avg(d), 6) from dist where s <> t) as average_path_length from x",
)

_LAYERS = "walk(id, k) as (select id, 0 from v where id not in (select dst from e) union select e.dst, k + 1 from walk join e on e.src = walk.id), depth as (select id, max(k) as layer from walk group by 1)"
_query("topological_layers", G.order_dag, connectivity.layers, f"with recursive {G.ORDER_DAG}, {_LAYERS} select id, layer::int as layer from depth")
_query("topological_sort", G.order_dag, connectivity.topological_sort, f"with recursive {G.ORDER_DAG}, {_LAYERS} select id, row_number() over (order by layer, id) - 1 as position from depth")
_query("is_acyclic", G.order_dag, connectivity.is_acyclic, f"with recursive {G.ORDER_DAG}, {_LAYERS} select (select count(*) from depth) = (select count(*) from v) as acyclic")
_REACH = "reach(src, dst) as (select id, id from v union select r.src, e.dst from reach r join e on e.src = r.dst)"
_query("is_cyclic", G.journeys, connectivity.is_cyclic, f"with recursive {G.JOURNEYS}, {_REACH} select count(*) > 0 as cyclic from reach r join e on e.dst = r.src and e.src = r.dst")
_query("transitive_closure", G.order_dag, lambda g: transform.transitive_closure(g).edges, f"with recursive {G.ORDER_DAG}, {_REACH} select src, dst, 1.0::double as weight from reach")
_QUERIES["transitive_reduction"] = lambda spark, d: transform.transitive_reduction(G.order_dag(spark, d, skips=True)).edges
_SQL["transitive_reduction"] = (
    f"with recursive {G.ORDER_DAG_SKIPS}, {_REACH} select src, dst, w as weight from e where not exists (select 1 from e f join reach r on r.src = f.dst and r.dst = e.dst and f.dst <> e.dst where f.src = e.src)"
)
_query(
    "ego_graph", G.journeys, lambda g: transform.ego_graph(g, g.nodes.agg(F.min("id")).first()[0], 1).edges,
    f"with {G.JOURNEYS}, c as (select min(id) as id from v), k as (select id from c union select dst from e where src in (from c) union select src from e where dst in (from c)) select src, dst, w as weight from e where src in (select id from k) and dst in (select id from k)",
)
_query("subgraph", G.trade, lambda g: transform.subgraph(g, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 99]).edges, f"with {G.TRADE} select src, dst, w as weight from e where src < 10 and dst < 10")
_query(
    "contract", G.trade, lambda g: transform.contract(g, 0, 1).edges,
    f"with {G.TRADE} select s as src, t as dst, w as weight from (select case when src = 1 then 0 else src end as s, case when dst = 1 then 0 else dst end as t, w from e) where s <> t",
)

# --- connectivity -------------------------------------------------------------------

_query("weakly_connected", G.journeys_undirected, connectivity.weakly_connected, f"with recursive {G.JOURNEYS_UNDIRECTED}, {_REACH} select src as id, min(dst) as component from reach group by 1")
_MIN_LABELS = ", ".join(["l0 as (select id, id as c from v)"] + [f"l{k} as materialized (select id, min(c) as c from (select id, c from l{k - 1} union all select e.src, l.c from e join l{k - 1} l on l.id = e.dst) group by 1)" for k in range(1, 9)])
_query("weakly_connected_full", G.copurchase_full, connectivity.weakly_connected, f"with {G.COPURCHASE_FULL}, {_MIN_LABELS} select id, c as component from l8")
_query("strongly_connected", G.trade, connectivity.strongly_connected, f"with recursive {G.TRADE}, {_REACH} select a.src as id, min(a.dst) as component from reach a join reach b on a.src = b.dst and a.dst = b.src group by 1")


def _core_sql(rounds: int = 14) -> str:
    ctes = ["c0 as (select src as id, count(*)::bigint as c from e group by 1)"]
    for k in range(1, rounds + 1):
        ctes.append(
            f"c{k} as materialized (select id, max(least(c, nth)) as c from (select e.src as id, x.c, row_number() over (partition by e.src order by x.c desc) as nth from e join c{k - 1} x on x.id = e.dst) group by 1)"
        )
    return f"with {G.JOURNEYS_UNDIRECTED}, {', '.join(ctes)} "


_query("core_numbers", G.journeys_undirected, connectivity.core_numbers, _core_sql() + "select id, coalesce(c, 0)::bigint as core from v left join c14 using (id)")
_query("k_core", G.journeys_undirected, lambda g: connectivity.k_core(g, 2).edges, _core_sql() + "select src, dst, w as weight from e where src in (select id from c14 where c >= 2) and dst in (select id from c14 where c >= 2)")
_query(
    "bridges", G.journeys_undirected, lambda g: connectivity.bridges_and_articulation_points(g)[0],
    f"with recursive {G.JOURNEYS_UNDIRECTED}, walk(u, v, pos) as (select src, dst, src from e where src < dst union select w.u, w.v, e.dst from walk w join e on e.src = w.pos and not (e.src = w.u and e.dst = w.v) and not (e.src = w.v and e.dst = w.u)) "
    "select src as u, dst as v from e where src < dst and not exists (select 1 from walk w where w.u = e.src and w.v = e.dst and w.pos = e.dst)",
)
_query(
    "articulation_points", G.journeys_undirected, lambda g: connectivity.bridges_and_articulation_points(g)[1],
    f"with recursive {G.JOURNEYS_UNDIRECTED}, walk(cut, pos) as (select src, min(dst) from e group by 1 union select w.cut, e.dst from walk w join e on e.src = w.pos and e.dst <> w.cut) "
    "select distinct src as id from e where not exists (select 1 from walk w where w.cut = e.src and w.pos = e.dst)",
)
_query(
    "bipartite_partition", G.cust_supp, connectivity.bipartite_partition,
    f"with recursive {G.CUST_SUPP}, root as (select min(id) as id from v), walk(id, p) as (select id, 0 from root union select e.dst, 1 - p from walk join e on e.src = walk.id) select id, p::bigint as color from walk",
)
_query("is_bipartite", G.cust_supp, connectivity.is_bipartite, "select true as bipartite")
_query(
    "is_bipartite_journeys", G.journeys_undirected, connectivity.is_bipartite,
    f"with recursive {G.JOURNEYS_UNDIRECTED}, walk(s, id, p) as (select id, id, 0 from v union select s, e.dst, 1 - p from walk join e on e.src = walk.id) select count(*) = 0 as bipartite from walk where s = id and p = 1",
)
_query("matching_size", G.cust_supp, lambda g: connectivity.maximum_matching(g).agg(F.count(F.lit(1)).alias("pairs")), "select count(distinct l_suppkey) as pairs from lineitem")
_query(
    "minimum_spanning_forest", G.journeys_undirected, mst.minimum_spanning_forest,
    f"with recursive {G.JOURNEYS_UNDIRECTED}, walk(u, v, w, pos) as (select src, dst, w, src from e where src < dst union select k.u, k.v, k.w, e.dst from walk k join e on e.src = k.pos and (e.w, least(e.src, e.dst), greatest(e.src, e.dst)) < (k.w, k.u, k.v)) "
    "select src, dst, w as weight from e where src < dst and not exists (select 1 from walk k where k.u = e.src and k.v = e.dst and k.pos = e.dst)",
)

# --- flows, cliques, colours, communities ----------------------------------------------

_CUT = "select min(c) as {name} from (select m.m, coalesce(sum(w), 0) as c from range(32) m(m) left join e on (m.m >> src) & 1 = 1 and (m.m >> dst) & 1 = 0 where {where} group by 1)"
_FLOW_SQL = f"with {G.EVENT_FLOW} " + _CUT.format(name="max_flow", where="m.m & 1 = 1 and (m.m >> 4) & 1 = 0")
_ENDS = lambda g: [r[0] for r in g.nodes.filter("id in (0, 4)").orderBy("id").select("label").collect()]
_query("max_flow_edmonds_karp", G.event_flow, lambda g: flow.max_flow(g, *_ENDS(g)).value, _FLOW_SQL)
_query("max_flow_push_relabel", G.event_flow, lambda g: flow.max_flow(g, *_ENDS(g), algorithm="push_relabel").value, _FLOW_SQL)
def _cut_weight(g: Graph) -> DataFrame:
    """The weight of the edges that lead from the source's side to the sink's."""
    side = flow.max_flow(g, *_ENDS(g)).sides
    ends = g.edges.join(side.select(F.col("id").alias("src"), F.col("side").alias("a")), "src").join(side.select(F.col("id").alias("dst"), F.col("side").alias("b")), "dst")
    return ends.filter("a = 'source' and b = 'sink'").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("max_flow"))


_PAIR = "least(src, dst) as a", "greatest(src, dst) as b"
_query("max_flow_cut", G.event_flow, _cut_weight, _FLOW_SQL)
_query(
    "max_flow_residual", G.event_flow, lambda g: flow.max_flow(g, *_ENDS(g)).residual.selectExpr(*_PAIR, "capacity").groupBy("a", "b").agg(F.sum("capacity").alias("capacity")),
    f"with {G.EVENT_FLOW} select {', '.join(_PAIR)}, sum(w) as capacity from e group by 1, 2",
)
_query("max_flow_sides", G.trade, lambda g: flow.max_flow(g, 0, 7).sides)
_query("global_min_cut", G.event_links, flow.global_min_cut, f"with {G.EVENT_LINKS} " + _CUT.format(name="min_cut", where="m.m between 1 and 30"))
_query("global_min_cut_trade", G.trade_full, flow.global_min_cut)
_CLIQUES = (
    "s as (select m.m as m, bit_count(m.m) as n from range(1, 32) m(m)), c as (select m, n from s where (select count(*) from e where src < dst and (s.m >> src) & 1 = 1 and (s.m >> dst) & 1 = 1) = n * (n - 1) // 2), "
    "mx as (select m, n from c where not exists (select 1 from c b where b.m <> c.m and b.m & c.m = c.m)), q as (select n, list_transform(list_filter(range(5), lambda i: (m >> i) & 1 = 1), lambda i: i::bigint) as clique from mx)"
)
_query("maximal_cliques", G.event_links, lambda g: cliques.maximal_cliques(g).select(F.concat_ws(",", F.col("clique").cast("array<string>")).alias("clique")), f"with {G.EVENT_LINKS}, {_CLIQUES} select array_to_string(clique, ',') as clique from q")
_ALL_CLIQUES = ", ".join(
    ["c1 as (select [id] as q, id as last from v)"]
    + [
        f"c{n + 1} as materialized (select list_append(any_value(q), dst) as q, dst as last from (select q, last, unnest(q) as m from c{n}) p join e on e.src = p.m and e.dst > p.last group by p.q, dst having count(*) = {n})"
        for n in range(1, 9)
    ]
    + [f"x{n} as (select any_value(q) as q from (select q, unnest(q) as m from c{n}) p join e on e.src = p.m group by p.q, dst having count(*) = {n})" for n in range(1, 10)]
)
_query(
    "maximal_clique_sizes", G.event_links, lambda g: cliques.maximal_cliques(g).groupBy(F.size("clique").alias("size")).agg(F.count(F.lit(1)).alias("cliques")),
    f"with {G.EVENT_LINKS}, {_ALL_CLIQUES} select size::int as size, count(*) as cliques from ("
    + " union all ".join(f"select {n} as size from c{n} where q not in (select q from x{n})" for n in range(1, 10)) + ") group by 1",
)
_query("max_clique", G.event_links, lambda g: cliques.max_clique(g).select(F.size("clique").alias("size")), f"with {G.EVENT_LINKS}, {_CLIQUES} select max(n)::int as size from q")
_query("coloring_dsatur", G.trade_full, lambda g: cliques.dsatur(g))
_COLORS = (
    "a as (select a0, a1, a2, a3, a4, [a0, a1, a2, a3, a4] as c from range(1, 6) t0(a0), range(1, 6) t1(a1), range(1, 6) t2(a2), range(1, 6) t3(a3), range(1, 6) t4(a4)) "
    "select min(list_max(c))::bigint as colors from a where not exists (select 1 from e where c[src + 1] = c[dst + 1])"
)
_query("coloring_exact", G.event_links, lambda g: cliques.chromatic_number(cliques.exact_coloring(g)), f"with {G.EVENT_LINKS}, {_COLORS}")
_query("label_propagation", G.trade_full, lambda g: community.label_propagation(g))
_query("louvain", G.trade_full, lambda g: community.louvain(g))
_query("leiden", G.trade_full, lambda g: community.leiden(g))
_query("leiden_hierarchical", G.trade_full, lambda g: community.leiden_hierarchical(g).levels)


def _conflicts(g: Graph) -> DataFrame:
    """Nodes with a colour, and edges whose ends share one."""
    colors = cliques.dsatur(g)
    ends = g.simple().join(colors.toDF("src", "a"), "src").join(colors.toDF("dst", "b"), "dst")
    return colors.agg(F.countDistinct("id").alias("nodes")).crossJoin(F.broadcast(ends.agg(F.count(F.when(F.col("a") == F.col("b"), 1)).alias("conflicts"))))  # one row each


def _community_laws(find: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
    """Nodes with a community, communities over several components, and whether modularity reaches the components' own."""

    def run(g: Graph) -> DataFrame:
        found, parts = checkpoint(find(g)), checkpoint(connectivity.weakly_connected(g))
        wide = found.join(parts, "id").groupBy("community").agg(F.countDistinct("component").alias("n"))
        score, least = metrics.modularity(g, found), metrics.modularity(g, parts.withColumnRenamed("component", "community"))
        rows = found.agg(F.countDistinct("id").alias("nodes")).crossJoin(F.broadcast(wide.agg(F.count(F.when(F.col("n") > 1, 1)).alias("wide"))))
        return rows.crossJoin(F.broadcast(score.toDF("found"))).crossJoin(F.broadcast(least.toDF("least"))).selectExpr("nodes", "wide", "found >= least - 1e-9 as reaches")  # one row each

    return run


_query("coloring_conflicts", G.trade_full, _conflicts, f"with {G.TRADE_FULL} select count(*) as nodes, 0::bigint as conflicts from v")
for _name, _find in (("louvain", community.louvain), ("leiden", community.leiden), ("leiden_finest", lambda g: community.leiden_hierarchical(g).finest())):
    _query(f"{_name}_laws", G.trade_full, _community_laws(_find), f"with {G.TRADE_FULL} select count(*) as nodes, 0::bigint as wide, true as reaches from v")

# --- files and generators -----------------------------------------------------------------


def _round_trip(format: str, undirected: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = G.journeys_undirected(spark, sf_dir) if undirected else G.trade(spark, sf_dir)
        path = fresh_path(spark, format)
        files.dump(g, path, format)
        return files.load(spark, path, format, directed=not undirected, integer_labels=True).edges

    return run


for _format in files.FORMATS:
    _QUERIES[f"io_{_format}"] = _round_trip(_format)
    _SQL[f"io_{_format}"] = f"with {G.TRADE} select src, dst, w as weight from e"
_QUERIES["io_undirected"] = _round_trip("edgelist", undirected=True)
_SQL["io_undirected"] = f"with {G.JOURNEYS_UNDIRECTED} select src, dst, w as weight from e"


def _pajek(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "pajek")
    files.dump(G.event_flow(spark, sf_dir), path, "pajek")
    return spark.read.text(path).select(F.col("value").alias("line"))


_QUERIES["io_pajek"] = _pajek
_SQL["io_pajek"] = (
    f"with {G.EVENT_FLOW} select '*Vertices ' || count(*) as line from names union all select (id + 1) || ' \"' || label || '\"' from names union all select '*Arcs' union all "
    "select (src + 1) || ' ' || (dst + 1) || ' ' || w from e"
)
_QUERIES["generate_grid"] = lambda spark, d: generators.grid_2d(spark, 30, 40).edges
_SQL["generate_grid"] = (
    "with p as (select i as s, i + 1 as t from range(1200) r(i) where i % 40 < 39 union all select i, i + 40 from range(1160) r(i)) select s as src, t as dst, 1.0::double as weight from p union all select t, s, 1.0 from p"
)
_QUERIES["generate_erdos_renyi"] = lambda spark, d: generators.erdos_renyi(spark, 60, 1.0).edges
_SQL["generate_erdos_renyi"] = "select a as src, b as dst, 1.0::double as weight from range(60) x(a), range(60) y(b) where a <> b"
_QUERIES["generate_barabasi_albert"] = lambda spark, d: generators.barabasi_albert(spark, 100, 3).edge_count()
_SQL["generate_barabasi_albert"] = "select 588::bigint as edge_count"
_QUERIES["generate_watts_strogatz"] = lambda spark, d: generators.watts_strogatz(spark, 100, 4, 0.2).edge_count()
_SQL["generate_watts_strogatz"] = "select 400::bigint as edge_count"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
