import itertools
import math
import random

import pytest

from conftest import by_label
from loomgraph.model import CyclicGraphError, Graph, GraphBuilder, NegativeCycleError, NotBipartiteError
from loomgraph.operators import centrality, cliques, community, connectivity, flow, health, kernels, metrics, mst, paths, transform


def value(df):
    return df.collect()[0][0]


def test_builder_and_lookups(spark):
    g = GraphBuilder(directed=False).add_edge("b", "a", 2).add_node("c").add_edge("a", "a").build(spark)
    assert value(g.node_count()) == 3 and value(g.edge_count()) == 3
    assert [g.id_of(x) for x in "abcz"] == [0, 1, 2, None] and g.label_of(1) == "b" and g.label_of(9) is None
    assert by_label(g, g.out_degrees(), "degree") == {"a": 2, "b": 1, "c": 0}


def test_metrics(graph):
    triangle, chain = graph("A-B B-C C-A"), graph("A-B B-C")
    assert value(metrics.density(triangle)) == 1.0 and value(metrics.triangle_count(triangle)) == 1
    assert set(by_label(triangle, metrics.local_clustering(triangle), "score").values()) == {1.0}
    assert value(metrics.triangle_count(chain)) == 0 and value(metrics.density(chain)) == pytest.approx(2 / 3)
    assert value(metrics.triangle_count(graph("A-B B-C C-A B-D D-C"))) == 2
    star = graph("c-a c-b c-d")
    assert value(metrics.assortativity(star)) == pytest.approx(-1) and value(metrics.average_clustering(star)) == 0
    sizes = metrics.anf(triangle).collect()
    assert [r[0] for r in sizes][:2] == [0, 1] and sizes[-1][1] >= sizes[0][1]


def test_empty_and_single(graph, spark):
    empty, one = Graph.from_list(spark, [], directed=True), Graph.from_list(spark, [], directed=True, labels=["A"])
    assert value(metrics.density(empty)) == 0 and value(metrics.average_clustering(empty)) == 0
    assert centrality.betweenness(empty).collect() == [] and by_label(one, centrality.betweenness(one), "score") == {"A": 0.0}
    assert by_label(one, centrality.pagerank(one), "score") == {"A": 1.0}
    assert value(connectivity.is_acyclic(empty)) is True and value(connectivity.is_bipartite(empty)) is True
    assert cliques.maximal_cliques(empty).collect() == []


def test_centrality(graph):
    chain = graph("A-B B-C")
    scores = by_label(chain, centrality.closeness(chain), "score")
    assert scores["B"] == 1.0 and scores["A"] == pytest.approx(2 / 3)
    star = graph("c-a c-b c-d")
    assert by_label(star, centrality.betweenness(star), "score") == {"c": 3.0, "a": 0.0, "b": 0.0, "d": 0.0}
    way = graph("A>B:1 B>C:1 A>C:10")
    assert by_label(way, centrality.betweenness(way, weighted=True), "score")["B"] == 1.0
    lone = graph("A>B", ["C"])
    assert by_label(lone, centrality.closeness(lone), "score")["C"] == 0.0
    assert by_label(lone, centrality.harmonic(lone), "score") == {"A": 0.5, "B": 0.0, "C": 0.0}
    cycle = graph("A>B B>C C>A")
    assert max(by_label(cycle, centrality.eigenvector(cycle), "score").values()) == pytest.approx(3**-0.5, abs=0.01)
    into = graph("A>B C>B")
    assert by_label(into, centrality.katz(into), "score") == pytest.approx({"A": 1.0, "B": 1.2, "C": 1.0})
    assert sum(by_label(into, centrality.pagerank(into), "score").values()) == pytest.approx(1.0)


def matrix(g, df):
    ids = {r.id: r.label for r in g.nodes.collect()}
    return {(ids[r.src], ids[r.dst]): r.dist for r in df.collect()}


def test_all_pairs(graph):
    cycle = graph("A>B B>C C>A")
    found = matrix(cycle, paths.floyd_warshall(cycle))
    assert found[("A", "C")] == 2 and found[("C", "B")] == 2 and len(found) == 9 and found == matrix(cycle, paths.johnson(cycle))
    chain = graph("A>B:1 B>C:2")
    assert ("B", "A") not in matrix(chain, paths.floyd_warshall(chain)) and matrix(chain, paths.floyd_warshall(chain))[("A", "C")] == 3
    with pytest.raises(NegativeCycleError):
        paths.floyd_warshall(graph("A>B:1 B>C:-2 C>A:-1"))


def test_paths(graph):
    g = graph("A>B:10 B>D:10 A>C:1 C>D:1", ["E"])
    assert [tuple(r) for r in paths.dijkstra(g, "A", "D").collect()] == [(["A", "C", "D"], 2.0)]
    assert paths.dijkstra(g, "A", "E").collect() == [] and paths.dijkstra(g, "A", "Z").collect() == []
    assert [tuple(r) for r in paths.dijkstra(g, "A", "A").collect()] == [(["A"], 0.0)]
    b = graph("A>B:10 B>D:10 A>C:1 C>D:-5")
    assert [tuple(r) for r in paths.bellman_ford(b, "A", "D").collect()] == [(["A", "C", "D"], -4.0)]
    with pytest.raises(NegativeCycleError):
        paths.bellman_ford(graph("A>B:1 B>C:-3 C>A:1"), "A", "C")
    assert value(paths.reachable(g, "A", "D")) is True and value(paths.reachable(g, "D", "A")) is False and value(paths.reachable(g, "A", "Z")) is False


def test_astar(spark):
    from loomgraph.sources.generators import grid_2d

    grid = grid_2d(spark, 2, 3)
    flat = Graph(grid.nodes.selectExpr("id", "id as label", "x", "y"), grid.edges, False)
    for kind in ("euclidean", "manhattan", "chebyshev"):
        path, weight = paths.astar(flat, 0, 5, kind).collect()[0]
        assert weight == 3.0 and len(path) == 4
    with pytest.raises(ValueError):
        paths.astar(flat, 0, 5, "other")


def test_health(graph):
    assert tuple(health.analyze(graph("a>b b>c")).collect()[0]) == (2.0, 0.0, pytest.approx(4 / 3))
    diamond = graph("a>b:1 a>c:3 b>d:1 c>d:1")
    assert tuple(health.analyze(diamond).collect()[0]) == (3.0, 0.0, pytest.approx(8 / 5))
    assert health.strict(diamond).collect()[0][0] is None


def test_connectivity(graph):
    g = graph("0-1 1-2 2-3 3-0 0-4")
    assert sorted(by_label(g, connectivity.core_numbers(g), "core").values()) == [1, 2, 2, 2, 2]
    core = connectivity.k_core(g, 2)
    assert value(core.node_count()) == 4 and value(core.edge_count()) == 8
    with pytest.raises(ValueError):
        connectivity.k_core(graph("A>B"), 2)
    two = graph("0-1 1-2 2-0 2-3 3-4 4-5 5-3")
    bridges, cuts = connectivity.bridges_and_articulation_points(two)
    assert [tuple(r) for r in bridges.collect()] == [(2, 3)] and sorted(r[0] for r in cuts.collect()) == [2, 3]
    strong = graph("0>1 1>2 2>0 2>3")
    assert by_label(strong, connectivity.strongly_connected(strong), "component") == {"0": 0, "1": 0, "2": 0, "3": 3}
    weak = graph("0>1 2>3")
    assert by_label(weak, connectivity.weakly_connected(weak), "component") == {"0": 0, "1": 0, "2": 2, "3": 2}


def test_bipartite(graph):
    for text, good in (("0-1 1-2", True), ("0-1 1-2 2-3 3-0", True), ("0-1 1-2 2-0", False), ("0-1 2-3 3-4 4-2", False)):
        assert value(connectivity.is_bipartite(graph(text))) is good
    assert connectivity.maximum_matching(graph("0-1 1-2 2-3")).count() == 2
    assert connectivity.maximum_matching(graph("a-x a-y a-z b-x b-y b-z")).count() == 2
    with pytest.raises(NotBipartiteError):
        connectivity.maximum_matching(graph("0-1 1-2 2-0"))


def test_orders(graph):
    g = graph("0>1 0>2 1>3 2>3 3>4")
    order = by_label(g, connectivity.topological_sort(g), "position")
    assert order["0"] == 0 and order["4"] == 4 and order["1"] < order["3"]
    with pytest.raises(CyclicGraphError):
        connectivity.topological_sort(graph("0>1 1>0"))
    assert value(connectivity.is_cyclic(graph("0>0"))) is True and value(connectivity.is_cyclic(g)) is False


def test_spanning_tree(graph):
    g = graph("1-2:10 2-3:5 1-3:20")
    assert {tuple(r) for r in mst.minimum_spanning_forest(g).collect()} == {(0, 1, 10.0), (1, 2, 5.0)}
    with pytest.raises(ValueError):
        mst.minimum_spanning_forest(graph("A>B"))


CLRS = "s>a:16 s>b:13 a>b:10 a>c:12 b>a:4 b>d:14 c>b:9 c>t:20 d>c:7 d>t:4"


@pytest.mark.parametrize("algorithm", flow.ALGORITHMS)
def test_max_flow(graph, algorithm):
    g = graph(CLRS)
    found = flow.max_flow(g, "s", "t", algorithm)
    sides = by_label(g, found.sides, "side")
    assert value(found.value) == 23.0 and sides["s"] == "source" and sides["t"] == "sink"
    assert value(flow.max_flow(g, "s", "s", algorithm).value) == 0.0


def test_min_cut(graph):
    g = graph("a-b:10 b-c:10 a-c:10 x-y:10 y-z:10 x-z:10 c-x:2")
    assert value(flow.global_min_cut(g)) == 2.0
    sides = by_label(g, flow.global_min_cut_sides(g), "side")
    assert len({sides[x] for x in "abc"}) == 1 and sides["a"] != sides["x"]
    assert value(flow.global_min_cut(graph("a-b c-d"))) == 0.0


def test_cliques_and_colors(graph):
    k4 = graph("A-B A-C A-D B-C B-D C-D", ["E"])
    assert sorted(r[0] for r in cliques.maximal_cliques(k4).collect()) == [[0, 1, 2, 3], [4]]
    assert value(cliques.max_clique(k4)) == [0, 1, 2, 3]
    c5 = graph("0-1 1-2 2-3 3-4 4-0")
    exact = cliques.exact_coloring(c5)
    assert value(cliques.chromatic_number(exact)) == 3 and value(cliques.chromatic_number(cliques.dsatur(c5))) >= 3
    colors = by_label(c5, exact, "color")
    assert all(colors[str(i)] != colors[str((i + 1) % 5)] for i in range(5))


@pytest.mark.parametrize("method", [community.louvain, community.leiden, community.label_propagation])
def test_communities(graph, method):
    g = graph("a-b b-c c-a x-y y-z z-x")
    found = method(g)
    groups = by_label(g, found, "community")
    assert len(set(groups.values())) == 2 and groups["a"] == groups["c"] and groups["x"] == groups["z"]
    assert value(metrics.modularity(g, found)) == pytest.approx(0.5)
    assert value(community.num_communities(found)) == 2


def test_hierarchy(graph):
    g = graph("a-b b-c c-a x-y y-z z-x c-x", ["q"])
    tree = community.leiden_hierarchical(g)
    levels = value(tree.num_levels())
    assert tree.finest().count() == 7 and tree.coarsest().count() == 7 and tree.level(levels - 1).count() == 7
    assert value(community.num_communities(tree.at_most(7))) <= 7


def test_transforms(graph):
    g = graph("A>B B>C")
    assert value(transform.transitive_closure(g).edge_count()) == 6
    with pytest.raises(ValueError):
        transform.transitive_closure(graph("A-B"))
    assert value(transform.transitive_reduction(graph("A>B B>C A>C")).edge_count()) == 2
    with pytest.raises(CyclicGraphError):
        transform.transitive_reduction(graph("A>B B>A"))
    merged = transform.contract(graph("A>B B>C:2"), "A", "B")
    assert value(merged.node_count()) == 2 and value(merged.edge_count()) == 1
    both = transform.contract(graph("A-B B-C:2"), "A", "B", keep="B")
    assert value(both.edge_count()) == 2 and sorted(r[0] for r in both.nodes.select("label").collect()) == ["B", "C"]
    with pytest.raises(ValueError):
        transform.contract(g, "A", "Z")
    assert value(transform.ego_graph(g, "B").node_count()) == 3 and value(transform.ego_graph(g, "A", 0).node_count()) == 1
    part = transform.subgraph(graph("A>B B>C C>D"), ["A", "B", "C", "Z"], renumber=True)
    assert value(part.node_count()) == 3 and value(part.edge_count()) == 2


def test_random_graphs_against_brute_force(spark):
    rng = random.Random(5)
    for trial in range(3):
        n = 9
        rows = [(a, b, float(rng.randint(1, 9))) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.35]
        g = Graph.from_list(spark, rows, directed=False, labels=list(range(n)))
        dist = [[0.0 if i == j else math.inf for j in range(n)] for i in range(n)]
        for a, b, w in rows:
            dist[a][b] = dist[b][a] = min(dist[a][b], w)
        for k, i, j in itertools.product(range(n), repeat=3):
            dist[i][j] = min(dist[i][j], dist[i][k] + dist[k][j])
        expected = {(i, j): dist[i][j] for i in range(n) for j in range(n) if dist[i][j] < math.inf}
        assert {(r.src, r.dst): r.dist for r in paths.johnson(g).collect()} == expected
        adj = {v: {b for a, b, _ in rows if a == v} | {a for a, b, _ in rows if b == v} for v in range(n)}
        sets = [set(c) for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(y in adj[x] for x, y in itertools.combinations(c, 2))]
        maximal = sorted(sorted(s) for s in sets if not any(s < t for t in sets))
        assert sorted(r[0] for r in cliques.maximal_cliques(g).collect()) == maximal
        tree = mst.minimum_spanning_forest(g).collect()
        parent = list(range(n))

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        total = 0.0
        for w, a, b in sorted((w, a, b) for a, b, w in rows):
            if root(a) != root(b):
                parent[root(a)] = root(b)
                total += w
        assert sum(r.weight for r in tree) == total


def test_flow_and_cut_kernels_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(2, 6)
        rows = [(a, b, float(rng.randint(0, 9))) for a in range(n) for b in range(n) if a != b and rng.random() < 0.5]
        rows += [(0, n - 1, 0.0)]
        best = min(sum(w for a, b, w in rows if a in s and b not in s) for k in range(n) for c in itertools.combinations(range(1, n - 1), k) for s in [{0, *c}]) if n > 1 else 0
        for algorithm in flow.ALGORITHMS:
            assert kernels.max_flow(rows, 0, n - 1, algorithm)[0] == best
        both = [(a, b, w) for a, b, w in rows for a, b in ((a, b), (b, a))] + [(v, v + 1, 1.0) for v in range(n - 1)] + [(v + 1, v, 1.0) for v in range(n - 1)]
        cut = min(sum(w for a, b, w in both if a in s and b not in s) for k in range(1, n) for s in map(set, itertools.combinations(range(n), k)))
        assert kernels.stoer_wagner(both)[0] == cut


def test_coloring_kernel_against_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(1, 7)
        adj = {v: set() for v in range(n)}
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                adj[a].add(b)
                adj[b].add(a)
        need = next(k for k in range(1, n + 1) if any(all(c[a] != c[b] for a in adj for b in adj[a]) for c in itertools.product(range(k), repeat=n)))
        found, proven = kernels.exact_coloring(adj, 10)
        assert proven and max(found.values()) == need and all(found[a] != found[b] for a in adj for b in adj[a])


def test_closure_by_recursive_sql(graph):
    rows = transform.closure_of_bounded_depth(graph("A>B B>C"), 5).collect()
    assert {tuple(r) for r in rows} == {(0, 1, 1), (1, 2, 1), (0, 2, 2)}


def test_edges_and_neighbours(graph):
    g = graph("A>B:2 A>C B>C C>C")
    assert g.has_edge("A", "B") and not g.has_edge("B", "A") and not g.has_edge("A", "Z")
    assert {(r.label, r.weight) for r in g.successors("A").collect()} == {("B", 2.0), ("C", 1.0)}
    assert {r.label for r in g.predecessors("C").collect()} == {"A", "B", "C"} and g.predecessors("Z").count() == 0
    assert by_label(g, g.in_degrees(), "degree") == {"A": 0, "B": 1, "C": 3}


@pytest.mark.parametrize("seed", range(4))
def test_maximal_cliques_against_all_subsets(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.2 + 0.2 * seed]
    g = Graph.from_list(spark, [(a, b, 1.0) for a, b in pairs], directed=False, labels=list(range(9)))
    near = {frozenset(p) for p in pairs}
    full = [set(c) for n in range(1, 10) for c in itertools.combinations(range(9), n) if all(frozenset(p) in near for p in itertools.combinations(c, 2))]
    expected = {tuple(sorted(c)) for c in full if not any(c < d for d in full)}
    label = {r.id: r.label for r in g.nodes.collect()}
    assert {tuple(sorted(label[i] for i in r.clique)) for r in cliques.maximal_cliques(g).collect()} == expected


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from loomgraph import storage

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="a"), conf=conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(cluster)
