import os

import pytest

from loomgraph.model import Graph
from loomgraph.operators import connectivity
from loomgraph.sources import files, generators


def write(tmp_path, text, name="g.txt"):
    path = os.path.join(tmp_path, name)
    with open(path, "w", newline="") as out:
        out.write(text)
    return path


def edges(g):
    return sorted(tuple(r) for r in g.all_edges().collect())


def test_edgelist_rules(spark, tmp_path):
    path = write(tmp_path, "# note\nSource Target\nA\tB,1.5\r\n\nB C x\nlone\n")
    g = files.read_edgelist(spark, path)
    assert edges(g) == [("A", "B", 1.5), ("B", "C", 1.0)]


def test_undirected_load(spark, tmp_path):
    g = files.read_edgelist(spark, write(tmp_path, "0 1 2\n1 0 3\n5 5\n"), directed=False, integer_labels=True)
    assert sorted(tuple(r) for r in g.edges.collect()) == [(0, 1, 2.0), (1, 0, 2.0), (5, 5, 1.0)]
    assert g.n() == 6


def test_integer_rows(spark, tmp_path):
    g = files.read_edgelist(spark, write(tmp_path, "0 1 1.5\nx 2\n2 0\n"), integer_labels=True)
    assert sorted(tuple(r) for r in g.edges.collect()) == [(0, 1, 1.5), (2, 0, 1.0)]


def test_adjlist_and_tgf(spark, tmp_path):
    g = files.read_adjlist(spark, write(tmp_path, "0: 1,1.5 2,2.0\n1:\n2: 0,1.0\nskip me\n"), integer_labels=True)
    assert g.n() == 3 and sorted(tuple(r) for r in g.edges.collect()) == [(0, 1, 1.5), (0, 2, 2.0), (2, 0, 1.0)]
    t = files.read_tgf(spark, write(tmp_path, "a first\nb\n#\na b 1.5\nb a\n", "t.tgf"))
    assert edges(t) == [("a", "b", 1.5), ("b", "a", 1.0)]


@pytest.mark.parametrize("format", files.FORMATS)
def test_round_trip(spark, tmp_path, format):
    g = Graph.from_list(spark, [("A", "B", 1.5), ("B", "C", 2.0), ("C", "A", 0.5)], directed=True)
    path = os.path.join(tmp_path, format)
    files.dump(g, path, format)
    assert edges(files.load(spark, path, format)) == edges(g)


def test_pajek_and_bad_formats(spark, tmp_path):
    g = Graph.from_list(spark, [("A", "B", 1.5)], directed=True)
    path = os.path.join(tmp_path, "p")
    files.dump(g, path, "pajek")
    assert [r[0] for r in spark.read.text(path).collect()] == ["*Vertices 2", '1 "A"', '2 "B"', "*Arcs", "1 2 1.5"]
    with pytest.raises(ValueError):
        files.load(spark, path, "gml")
    with pytest.raises(ValueError):
        files.dump(g, path + "x", "gml")


def test_stream(spark, tmp_path):
    from loomgraph.streaming.edges import stream_edgelist, streaming_out_degrees

    write(tmp_path, "a b\na c 2\nb c\n")
    query = streaming_out_degrees(stream_edgelist(spark, str(tmp_path))).writeStream.format("memory").queryName("degrees").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("degrees").collect()) == [("a", 2), ("b", 1)]


def test_generators(spark):
    assert generators.erdos_renyi(spark, 10, 0).edges.count() == 0
    assert generators.erdos_renyi(spark, 10, 1).edges.count() == 90 == generators.erdos_renyi(spark, 10, 1, directed=True).edges.count()
    assert generators.barabasi_albert(spark, 100, 3).edges.count() == 588
    assert generators.watts_strogatz(spark, 100, 4, 0.3).edges.count() == 400
    grid = generators.grid_2d(spark, 3, 4)
    assert grid.n() == 12 and grid.edges.count() == 34
    assert connectivity.weakly_connected(grid).select("component").distinct().count() == 1
    for bad in (lambda: generators.watts_strogatz(spark, 5, 3, 0.1), lambda: generators.barabasi_albert(spark, 3, 3)):
        with pytest.raises(ValueError):
            bad()
