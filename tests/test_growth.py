"""What iterative and combinatorial operators read, and results over routes that only large inputs take."""

import itertools
import os
import random

import pytest

from loomgraph.model import CyclicGraphError, Graph
from loomgraph.operators import centrality, components, connectivity, matching, metrics, parts, transform, triangles
from loomgraph.plans import graphs

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("build", [graphs.trade, graphs.trade_full, graphs.event_flow, graphs.event_links])
def test_small_graphs_over_large_tables_are_written_once(spark, build):
    read = build(spark, SF).edges.inputFiles()
    assert read and not any(f"{name}.parquet" in path for path in read for name in ("lineitem", "orders", "customer", "supplier", "events"))


def random_graph(spark, seed, n=60, share=0.25, directed=False):
    rng = random.Random(seed)
    pairs = [(a, b) for a in range(n) for b in range(n) if a < b and rng.random() < share]
    return pairs, Graph.from_list(spark, [(a, b, 1.0) for a, b in pairs], directed=directed, labels=list(range(n)))


@pytest.mark.parametrize("buckets", [1, 2, 5, 12])
def test_triangles_meet_in_tasks_of_three_buckets(spark, monkeypatch, buckets):
    monkeypatch.setattr(triangles, "LEAST_BUCKETS", buckets)
    monkeypatch.setattr(triangles, "SLICE", 7)
    pairs, g = random_graph(spark, buckets)
    near = set(pairs)
    expected = {t for t in itertools.combinations(range(60), 3) if all(p in near for p in itertools.combinations(t, 2))}
    assert triangles.count(g).first()[0] == len(expected)
    found = [tuple(sorted(r)) for r in metrics.triangles(g).collect()]
    assert len(found) == len(expected) and set(found) == expected
    corners = {r.id: (r.k, r.t) for r in triangles.corners(g).collect()}
    assert corners == {v: (sum(v in p for p in pairs), sum(v in t for t in expected)) for v in range(60)}


def test_parallel_edges_multiply_triangles(graph):
    g = graph("a-b a-b b-c c-a c-a c-a d-a")
    assert metrics.triangle_count(g).first()[0] == 1 and metrics.triangle_count(g, multi=True).first()[0] == 6


def test_no_wedges_are_shuffled(spark):
    _, g = random_graph(spark, 3)
    plan = triangles.count(g)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("Join") <= 4  # ranks and their offsets, for both ends


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_copurchase_pairs_are_written_once_in_tasks_of_bounded_size(spark, monkeypatch):
    g = graphs.copurchase_full(spark, SF)
    assert not any("lineitem" in path for path in g.edges.inputFiles()) and g.distinct
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert graphs._tasks(lines, each=100) == lines.count() // 100 + 1


def matched(adj):
    """The size of a largest matching by augmenting paths, one left node at a time."""
    mate = {}

    def free(v, seen):
        for w in adj[v]:
            if w not in seen:
                seen.add(w)
                if w not in mate or free(mate[w], seen):
                    mate[w] = v
                    return True
        return False

    return sum(free(v, set()) for v in adj)


@pytest.mark.parametrize("seed, n, m", [(1, 30, 30), (2, 40, 20), (3, 20, 40)])
def test_matching_searches_where_offers_end_short(spark, seed, n, m):
    rng = random.Random(seed)
    adj = {a: [b for b in range(100, 100 + m) if rng.random() < 2 / m] for a in range(n)}
    edges = spark.createDataFrame([(a, b) for a, bs in adj.items() for b in bs], "l long, r long").repartition(3).cache()
    found = [tuple(r) for r in matching.largest(edges).collect()]
    assert len(found) == matched(adj) and all(r in adj[l] for l, r in found)
    assert len({l for l, _ in found}) == len({r for _, r in found}) == len(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_contraction_over_a_forest_finds_components_and_sides(spark, seed):
    rng = random.Random(seed)
    even = sorted({tuple(sorted((2 * rng.randrange(40), 2 * rng.randrange(40) + 1))) for _ in range(70)})
    pairs = spark.createDataFrame(even, "src long, dst long").cache()
    root = {v: v for p in even for v in p}
    for _ in range(80):
        for a, b in even:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.id: r.component for r in components.contracted(pairs, sides=False).collect()} == root
    assert {r.id: r.p for r in components.contracted(pairs, sides=True).collect()} == {v: (v - c) % 2 for v, c in root.items()}
    a = even[0][0]
    odd = pairs.unionAll(spark.createDataFrame([(even[0][1], 201), (200, 201), (a, 200), (a, 201)], "src long, dst long"))
    assert components.contracted(odd, sides=True) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_bought_pairs_are_written_once(spark):
    g = graphs.cust_supp(spark, SF)
    assert g.distinct and not any(f"{name}.parquet" in path for path in g.edges.inputFiles() for name in ("lineitem", "orders"))


def test_anf_keeps_a_row_per_node(spark, monkeypatch):
    _, g = random_graph(spark, 5, n=12)
    counts = []
    write = metrics.checkpoint
    monkeypatch.setattr(metrics, "checkpoint", lambda df: (counts.append(df.count()), write(df))[1])
    sizes = [r.size for r in metrics.anf(g, 16, 4).collect()]
    assert set(counts) == {12} and sizes == sorted(sizes)


@pytest.mark.parametrize("most", [0, 6, 500])
def test_components_in_batches_and_in_rounds_agree(spark, monkeypatch, most):
    monkeypatch.setattr(parts, "MOST", most)
    monkeypatch.setattr(parts, "BATCH", 5)
    rng = random.Random(7)
    rows = [(10 * c + a, 10 * c + b, float(rng.randint(1, 3))) for c in range(4) for a, b in itertools.combinations(range(3 + 2 * c), 2) if rng.random() < 0.5]
    nodes = sorted({v for a, b, _ in rows for v in (a, b)} | {90})
    g = Graph.from_ids(spark.createDataFrame([*rows, rows[0]], "src long, dst long, weight double"), directed=True, nodes=spark.createDataFrame([(v,) for v in nodes], "id long"))
    reached = {(v, v) for v in nodes}
    while True:
        more = {(s, b) for s, t in reached for a, b, _ in rows if a == t} - reached
        if not more:
            break
        reached |= more
    assert sorted((r.src, r.dst) for r in transform.transitive_closure(g).edges.collect()) == sorted(reached)
    kept = [e for e in [*rows, rows[0]] if not any(a == e[0] and b != e[1] and (b, e[1]) in reached for a, b, _ in rows)]
    assert sorted(tuple(r) for r in transform.transitive_reduction(g).edges.collect()) == sorted(kept)
    core = {r.id: r.core for r in connectivity.core_numbers(g).collect()}
    for k in range(1, 7):
        left = set(nodes)
        while weak := {v for v in left if sum((a == v and b in left) or (b == v and a in left) for a, b, _ in rows) < k}:
            left -= weak
        assert {v for v in nodes if core[v] >= k} == left
    for weighted in (False, True):
        paths_to = {}
        for s in nodes:
            best, ways = {s: 0.0}, {s: 1.0}
            for v in nodes:  # ids are a topological order here
                for a, b, w in [*rows, rows[0]]:
                    if b == v and a in best:
                        d = best[a] + (w if weighted else 1.0)
                        if d < best.get(v, float("inf")):
                            best[v], ways[v] = d, 0.0
                        if d == best[v]:
                            ways[v] += ways[a]
            paths_to[s] = best, ways
        expected = {}
        for v in nodes:
            expected[v] = sum(
                paths_to[s][1][v] * paths_to[v][1][t] / paths_to[s][1][t]
                for s, t in reached if s != v != t and s != t and (s, v) in reached and (v, t) in reached and paths_to[s][0][v] + paths_to[v][0][t] == paths_to[s][0][t]
            )
        assert {r.id: r.score for r in centrality.betweenness(g, weighted).collect()} == pytest.approx(expected)


def test_cycles_in_any_component_are_refused(spark, monkeypatch):
    g = Graph.from_ids(spark.createDataFrame([(1, 2), (5, 6), (6, 7), (7, 5)], "src long, dst long"), directed=True)
    for most in (0, 500):
        monkeypatch.setattr(parts, "MOST", most)
        with pytest.raises(CyclicGraphError):
            transform.transitive_reduction(g).edges.collect()


def test_bridges_come_from_batches_of_components(spark, monkeypatch):
    monkeypatch.setattr(parts, "BATCH", 1_000)
    pairs = [(10 * c + a, 10 * c + b) for c in range(50) for a, b in ((0, 1), (1, 2), (2, 0), (2, 3))]
    g = Graph.from_ids(spark.createDataFrame(pairs, "src long, dst long"), directed=False, distinct=True)
    seen = []
    batched = parts.batched
    monkeypatch.setattr(parts, "batched", lambda rows: (seen.append(batched(rows)), seen[0])[1])
    bridges, cuts = connectivity.bridges_and_articulation_points(g)
    assert sorted(tuple(r) for r in bridges.collect()) == [(10 * c + 2, 10 * c + 3) for c in range(50)] and sorted(r[0] for r in cuts.collect()) == [10 * c + 2 for c in range(50)]
    assert seen[0].select("batch").distinct().count() <= 4 < seen[0].select("component").distinct().count()
