"""The graph: a table of nodes and a table of stored edge rows.

``nodes`` has ``id`` (long) and ``label``, and ``x``, ``y`` where nodes have
coordinates; ``edges`` has ``src``, ``dst`` (long) and ``weight`` (double).  An
undirected graph stores both directions of an edge, a loop once.  Graphs are
immutable; every method returns new tables and runs nothing by itself.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ordering import with_row_numbers


def weight_of(column: Column | str) -> Column:
    """A weight as double; null and what is no number count as 1."""
    return F.coalesce(F.expr(f"try_cast({column} AS DOUBLE)") if isinstance(column, str) else column.try_cast("double"), F.lit(1.0))


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; loops once."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").unionAll(back)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool
    #: Whether no two stored rows have the same ends.
    distinct: bool = False

    @staticmethod
    def from_ids(edges: DataFrame, *, directed: bool, nodes: DataFrame | None = None, mirror: bool = True, distinct: bool = False) -> Graph:
        """Edges between integer ids (src, dst[, weight]); ``nodes`` (id) may add isolated ones.

        ``distinct`` vouches that no pair of ends occurs twice, in either direction for undirected graphs.
        """
        weight = weight_of("weight") if "weight" in edges.columns else F.lit(1.0)
        rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"))
        ids = rows.select(F.explode(F.array("src", "dst")).alias("id"))
        if nodes is not None:
            ids = ids.unionAll(nodes.select(F.col("id").cast("long").alias("id")))
        stored = rows if directed or not mirror else mirrored(rows)
        return Graph(ids.distinct().select("id", F.col("id").alias("label")), stored, directed, distinct)

    @staticmethod
    def from_edges(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, *, directed: bool, labels: DataFrame | None = None) -> Graph:
        """Edges between labels; ids follow the sorted distinct labels from 0."""
        rows = edges.select(F.col(src).alias("s"), F.col(dst).alias("d"), (weight_of(weight) if weight else F.lit(1.0)).alias("weight"))
        found = rows.select(F.explode(F.array("s", "d")).alias("label"))
        if labels is not None:
            found = found.unionAll(labels.select("label"))
        nodes = with_row_numbers(found.filter(F.col("label").isNotNull()).distinct(), ["label"], "id").select("id", "label")
        ids = rows.join(nodes.select(F.col("id").alias("src"), F.col("label").alias("s")), "s").join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("d")), "d").select("src", "dst", "weight")
        return Graph(nodes, ids if directed else mirrored(ids), directed)

    @staticmethod
    def from_list(spark: SparkSession, rows: list, *, directed: bool, labels: list | None = None) -> Graph:
        """A small graph from Python tuples (src, dst[, weight]) and further labels."""
        sample = (labels or []) + [x for r in rows for x in r[:2]]
        kind = "long" if sample and all(isinstance(x, int) for x in sample) else "string"
        edges = spark.createDataFrame([(r[0], r[1], float(r[2]) if len(r) > 2 and isinstance(r[2], (int, float)) else 1.0) for r in rows], f"src {kind}, dst {kind}, weight double")
        more = spark.createDataFrame([(x,) for x in labels or []], f"label {kind}")
        return Graph.from_edges(edges, weight="weight", directed=directed, labels=more)

    @staticmethod
    def from_dataframes(nodes: DataFrame, edges: DataFrame, *, directed: bool) -> Graph:
        """Take over tables that already have the form described above."""
        return Graph(nodes, edges.select("src", "dst", "weight"), directed)

    def to_dataframes(self) -> tuple[DataFrame, DataFrame]:
        return self.nodes, self.edges

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def persist(self) -> Graph:
        """Keep both tables, edges partitioned by ``src``, across algorithms."""
        level = StorageLevel.MEMORY_AND_DISK
        return replace(self, nodes=self.nodes.persist(level), edges=self.edges.repartition("src").persist(level))

    def unpersist(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()

    def node_count(self) -> DataFrame:
        return self.nodes.agg(F.count(F.lit(1)).alias("node_count"))

    def edge_count(self) -> DataFrame:
        return self.edges.agg(F.count(F.lit(1)).alias("edge_count"))

    def n(self) -> int:
        return self.nodes.count()

    def all_labels(self) -> DataFrame:
        return self.nodes.select("label").orderBy("id")

    def all_edges(self) -> DataFrame:
        """Stored rows with labels."""
        a = self.nodes.select(F.col("id").alias("src"), F.col("label").alias("source"))
        b = self.nodes.select(F.col("id").alias("dst"), F.col("label").alias("target"))
        return self.edges.join(a, "src").join(b, "dst").select("source", "target", "weight")

    def id_of(self, label) -> int | None:
        row = self.nodes.filter(F.col("label") == F.lit(label)).select("id").first()
        return None if row is None else row[0]

    def label_of(self, node: int):
        row = self.nodes.filter(F.col("id") == node).select("label").first()
        return None if row is None else row[0]

    def out_degrees(self) -> DataFrame:
        """(id, degree): stored rows that leave each node."""
        counts = self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))

    def in_degrees(self) -> DataFrame:
        """(id, degree): stored rows that enter each node."""
        return self.transpose().out_degrees()

    def has_edge(self, source, target) -> bool:
        """Whether a stored row leads from one label to the other."""
        a, b = self.id_of(source), self.id_of(target)
        return a is not None and b is not None and not self.edges.filter((F.col("src") == a) & (F.col("dst") == b)).isEmpty()

    def successors(self, label) -> DataFrame:
        """(label, weight) of the rows that leave a node; none for an unknown label."""
        a = self.id_of(label)
        return self.labelled(self.edges.filter(F.col("src") == F.lit(a)).select(F.col("dst").alias("id"), "weight"))

    def predecessors(self, label) -> DataFrame:
        """(label, weight) of the rows that enter a node; none for an unknown label."""
        return self.transpose().successors(label)

    def simple(self) -> DataFrame:
        """(src, dst): both directions of every distinct edge without loops."""
        rows = self.edges.filter("src <> dst").select("src", "dst")
        if self.distinct and not self.directed:
            return rows
        return rows.unionAll(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()

    def pairs(self) -> DataFrame:
        """(src, dst) with src < dst: every distinct edge once, whatever its direction, without loops."""
        if self.distinct and not self.directed:
            return self.edges.filter("src < dst").select("src", "dst")
        return self.edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    def labelled(self, result: DataFrame) -> DataFrame:
        """Replace ``id`` by ``label``."""
        return result.join(self.nodes.select("id", "label"), "id").select("label", *[c for c in result.columns if c != "id"])

    def transpose(self) -> Graph:
        return replace(self, edges=self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def require_undirected(self, what: str) -> None:
        if self.directed:
            raise ValueError(f"{what} needs an undirected graph")

    def require_directed(self, what: str) -> None:
        if not self.directed:
            raise ValueError(f"{what} needs a directed graph")


class GraphBuilder:
    """Collects nodes and edges one by one, for small graphs."""

    def __init__(self, *, directed: bool):
        self.directed, self.labels, self.rows = directed, [], []

    def add_node(self, label) -> GraphBuilder:
        if label not in self.labels:
            self.labels.append(label)
        return self

    ensure_node = add_node

    def add_edge(self, src, dst, weight=1.0) -> GraphBuilder:
        self.add_node(src).add_node(dst)
        self.rows.append((src, dst, weight))
        return self

    def add_unweighted_edge(self, src, dst) -> GraphBuilder:
        return self.add_edge(src, dst)

    def build(self, spark: SparkSession) -> Graph:
        return Graph.from_list(spark, self.rows, directed=self.directed, labels=self.labels)


class NegativeCycleError(ValueError):
    """A cycle of negative weight makes distances meaningless."""


class CyclicGraphError(ValueError):
    """The operation is defined for graphs without cycles."""


class NotBipartiteError(ValueError):
    """The nodes can't be split in two sides."""
