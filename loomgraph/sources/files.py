"""Graphs from and to text files.

Readers split lines with built-in functions and keep no driver state.  Labels
are strings unless ``integer_labels`` is set; then ids are the integers, and
rows that hold none are skipped.  An undirected load keeps the first weight of
each pair in file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Graph, mirrored, weight_of

FORMATS = ("edgelist", "csv", "adjlist", "tgf")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of all files, in order; ``line`` grows within a file."""
    rows = spark.read.text(path).select(F.regexp_replace("value", r"^[ \t\r]+|[ \t\r]+$", "").alias("value"), F.monotonically_increasing_id().alias("line"))
    return rows


def _assemble(rows: DataFrame, nodes: DataFrame, directed: bool, integer_labels: bool) -> Graph:
    """A graph from (line, s, d, weight) and node labels (label)."""
    if integer_labels:
        s, d = F.col("s").try_cast("long"), F.col("d").try_cast("long")
        rows = rows.select("line", s.alias("s"), d.alias("d"), "weight").filter("s is not null and d is not null")
        nodes = nodes.select(F.col("label").try_cast("long").alias("label")).filter("label is not null")
    if not directed:
        low, high = F.least("s", "d"), F.greatest("s", "d")
        first = F.row_number().over(Window.partitionBy("low", "high").orderBy("line"))
        rows = rows.withColumns({"low": low, "high": high}).withColumn("nth", first).filter("nth = 1").select("line", F.col("low").alias("s"), F.col("high").alias("d"), "weight")
    if integer_labels:
        top = rows.select(F.greatest("s", "d").alias("id")).unionAll(nodes.select(F.col("label").alias("id"))).agg(F.max("id")).first()[0]
        every = rows.sparkSession.range(0 if top is None else top + 1)
        edges = rows.select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight")
        return Graph(every.select("id", F.col("id").alias("label")), edges if directed else mirrored(edges), directed)
    return Graph.from_edges(rows, "s", "d", "weight", directed=directed, labels=nodes)


def _no_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "label string")


def read_edgelist(spark: SparkSession, path: str, *, directed: bool = True, integer_labels: bool = False) -> Graph:
    """Lines ``source target [weight]``, parted by blanks, tabs or commas; # comments and a header are skipped."""
    parts = F.split("value", r"[ \t,]+")
    rows = _lines(spark, path).filter("value <> '' and not startswith(value, '#')").select("line", parts.alias("p")).filter(F.size("p") >= 2)
    rows = rows.filter(~((F.lower(F.col("p")[0]) == "source") & (F.lower(F.col("p")[1]) == "target")))
    return _assemble(rows.select("line", F.col("p")[0].alias("s"), F.col("p")[1].alias("d"), weight_of(F.get("p", F.lit(2))).alias("weight")), _no_labels(spark), directed, integer_labels)


def read_csv(spark: SparkSession, path: str, *, directed: bool = True, integer_labels: bool = False) -> Graph:
    """The same lines as ``read_edgelist``."""
    return read_edgelist(spark, path, directed=directed, integer_labels=integer_labels)


def read_adjlist(spark: SparkSession, path: str, *, directed: bool = True, integer_labels: bool = False) -> Graph:
    """Lines ``source: target[,weight] target[,weight] ...``; lines without a colon are skipped."""
    lines = _lines(spark, path).filter("value like '%:%' and not startswith(value, '#')").select("line", F.trim(F.substring_index("value", ":", 1)).alias("s"), F.expr("trim(substr(value, instr(value, ':') + 1))").alias("rest"))
    each = lines.select("line", "s", F.posexplode(F.split("rest", r"[ \t]+")).alias("at", "token")).filter("token <> ''")
    rows = each.select(F.struct("line", "at").alias("line"), "s", F.split("token", ",")[0].alias("d"), weight_of(F.get(F.split("token", ","), F.lit(1))).alias("weight"))
    return _assemble(rows, lines.select(F.col("s").alias("label")), directed, integer_labels)


def read_tgf(spark: SparkSession, path: str, *, directed: bool = True, integer_labels: bool = False) -> Graph:
    """Node lines up to a line ``#``, then lines ``source target [weight]``."""
    lines = _lines(spark, path)
    mark = lines.filter("value = '#'").agg(F.min("line").alias("mark"))
    rows = lines.filter("value <> ''").crossJoin(F.broadcast(mark)).select("line", "mark", F.split("value", r"[ \t]+").alias("p"))  # one row
    nodes = rows.filter("mark is null or line < mark").select(F.col("p")[0].alias("label"))
    edges = rows.filter("line > mark").filter(F.size("p") >= 2)
    return _assemble(edges.select("line", F.col("p")[0].alias("s"), F.col("p")[1].alias("d"), weight_of(F.get("p", F.lit(2))).alias("weight")), nodes, directed, integer_labels)


def load(spark: SparkSession, path: str, format: str = "edgelist", **options) -> Graph:
    readers = {"edgelist": read_edgelist, "csv": read_csv, "adjlist": read_adjlist, "tgf": read_tgf}
    if format not in readers:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    return readers[format](spark, path, **options)


def _weight(column: str = "weight"):
    return F.col(column).cast("string")


def _written(g: Graph, mirror: bool) -> DataFrame:
    """Edges with labels; of an undirected graph one direction unless ``mirror``."""
    rows = g if g.directed or mirror else Graph(g.nodes, g.edges.filter("src <= dst"), False)
    return rows.all_edges()


def _sections(parts: list[DataFrame], path: str) -> None:
    """Sections (pos, value) one after the other in one file, as the format demands."""
    rows = None
    for i, part in enumerate(parts):
        part = part.select(F.lit(i).alias("section"), "pos", "value")
        rows = part if rows is None else rows.unionAll(part)
    rows.coalesce(1).sortWithinPartitions("section", "pos").select("value").write.text(path)


def dump(g: Graph, path: str, format: str = "edgelist", mirror: bool = False) -> None:
    """Write a graph; ``mirror`` writes both stored directions of undirected edges."""
    spark, label = g.spark, F.col("label").cast("string")
    if format == "edgelist":
        _written(g, mirror).select(F.concat_ws(" ", F.col("source").cast("string"), F.col("target").cast("string"), _weight())).write.text(path)
    elif format == "csv":
        _written(g, mirror).select(F.col("source").alias("Source"), F.col("target").alias("Target"), F.col("weight").alias("Weight")).write.option("header", True).csv(path)
    elif format == "adjlist":
        rows = g.edges if g.directed or mirror else g.edges.filter("src <= dst")
        named = rows.join(g.nodes.select(F.col("id").alias("dst"), label.alias("to")), "dst")
        lists = named.groupBy(F.col("src").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", "to", _weight()))), " ").alias("rest"))
        g.nodes.join(lists, "id", "left").select(F.concat(label, F.lit(":"), F.coalesce(F.concat(F.lit(" "), F.col("rest")), F.lit("")))).write.text(path)
    elif format == "tgf":
        nodes = g.nodes.select(F.col("id").alias("pos"), label.alias("value"))
        mark = spark.createDataFrame([(0, "#")], "pos long, value string")
        edges = _written(g, mirror).select(F.lit(0).cast("long").alias("pos"), F.concat_ws(" ", F.col("source").cast("string"), F.col("target").cast("string"), _weight()).alias("value"))
        _sections([nodes, mark, edges], path)
    elif format == "pajek":
        from ..functions.ordering import with_row_numbers

        numbered = with_row_numbers(g.nodes, ["id"], "nth")
        spots = numbered.select("id", (F.col("nth") + 1).alias("k"), "label")
        head = g.node_count().select(F.lit(0).cast("long").alias("pos"), F.concat(F.lit("*Vertices "), F.col("node_count").cast("string")).alias("value"))
        nodes = spots.select(F.col("k").alias("pos"), F.concat(F.col("k").cast("string"), F.lit(' "'), label, F.lit('"')).alias("value"))
        mark = spark.createDataFrame([(0, "*Arcs" if g.directed else "*Edges")], "pos long, value string")
        rows = g.edges if g.directed or mirror else g.edges.filter("src <= dst")
        edges = rows.join(spots.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(spots.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst")
        _sections([head, nodes, mark, edges.select(F.lit(0).cast("long").alias("pos"), F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string"), _weight()).alias("value"))], path)
    else:
        raise ValueError("format must be edgelist, csv, adjlist, tgf or pajek")
