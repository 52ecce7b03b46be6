"""Graphs derived from the driver's tables, as DataFrames and as SQL.

Each SQL text defines ``e`` (src, dst, w): the stored edge rows, both
directions for undirected graphs, and ``v`` (id): the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Graph
from ..storage import default_partitions, materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UNDIRECTED = ", e as (select s as src, t as dst, w from pairs union all select t, s, w from pairs), v as (select distinct src as id from e)"
DIRECTED = ", e as (select s as src, t as dst, w from pairs), v as (select src as id from e union select dst from e)"


def _tasks(rows: DataFrame, each: int = 500_000) -> int:
    """Tasks for a shuffle of ``rows``, so that the memory of one doesn't grow with the table."""
    return max(default_partitions(rows.sparkSession), rows.count() // each + 1)


def copurchase_full(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts bought in one order, whatever the quantity; the pairs are written once."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p"))
    tasks = _tasks(lines)
    baskets = lines.filter("l_orderkey is not null").repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("p").alias("ps")).filter(F.size("ps") > 1)
    pairs = baskets.select(F.explode("ps").alias("src"), "ps").select("src", F.explode(F.filter("ps", lambda p: p > F.col("src"))).alias("dst"))
    return Graph.from_ids(materialise(pairs.repartition(tasks, "src", "dst").distinct(), "copurchase"), directed=False, distinct=True)


COPURCHASE_FULL = (
    "pairs as (select distinct a.l_partkey as s, b.l_partkey as t, 1.0::double as w from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey)" + UNDIRECTED
)


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight), a row for each two nations at most: written once, since iterative operators read it in every round."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    buyers = orders.join(customers, "o_custkey").select("l_orderkey", "src")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(buyers, "l_orderkey").join(suppliers, "l_suppkey")
    return materialise(rows.filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")), "trade")


_TRADE = (
    "trade as (select c_nationkey::bigint as s, s_nationkey::bigint as t, count(*)::double as w from lineitem join orders on l_orderkey = o_orderkey "
    "join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2)"
)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations to the nations that sell to them; weights count lines."""
    return Graph.from_ids(_trade(spark, sf_dir), directed=True)


TRADE = _TRADE + ", pairs as (select s, t, w from trade)" + DIRECTED


def trade_full(spark: SparkSession, sf_dir: str) -> Graph:
    """All nations that trade, without direction; weights of both ways add up."""
    rows = _trade(spark, sf_dir).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return Graph.from_ids(rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), directed=False)


TRADE_FULL = _TRADE + ", pairs as (select least(s, t) as s, greatest(s, t) as t, sum(w) as w from trade group by 1, 2)" + UNDIRECTED


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("community"))


def cust_supp(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and the suppliers they bought from, written once; suppliers' ids are offset by ten million."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + 10_000_000).alias("dst"))
    tasks = _tasks(lines)
    rows = lines.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "l_orderkey"), "l_orderkey")
    last = orders.agg(F.max("src")).first()[0]
    pairs = rows.select("src", "dst").repartition(tasks, "src", "dst").distinct()
    return Graph.from_ids(materialise(pairs, "bought"), directed=False, distinct=last is None or last <= 10_000_000)


CUST_SUPP = "pairs as (select distinct o_custkey as s, l_suppkey + 10000000 as t, 1.0::double as w from lineitem join orders on l_orderkey = o_orderkey)" + UNDIRECTED


def order_dag(spark: SparkSession, sf_dir: str, skips: bool = False) -> Graph:
    """Each customer's orders in time: every order to the next, with ``skips`` to the one after it as well."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    steps = [F.lead("o_orderkey", k).over(w) for k in ((1, 2) if skips else (1,))]
    pairs = rows.select(F.col("o_orderkey").alias("src"), F.array(*steps).alias("to")).select("src", F.explode("to").alias("dst"))
    return Graph.from_ids(pairs.filter("dst is not null"), directed=True, nodes=rows.select(F.col("o_orderkey").alias("id")))


def _order_dag(*steps: int) -> str:
    parts = " union all ".join(f"select o_orderkey as s, lead(o_orderkey, {k}) over (partition by o_custkey order by o_orderdate, o_orderkey) as t, 1.0::double as w from orders" for k in steps)
    return f"pairs as (select * from ({parts}) where t is not null), e as (select s as src, t as dst, w from pairs), v as (select o_orderkey as id from orders)"


ORDER_DAG, ORDER_DAG_SKIPS = _order_dag(1), _order_dag(1, 2)


_JOURNEY_WEIGHT = "(1 + (src * 31 + dst * 17) % 97)"


def _journey_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = ["o_orderdate", "o_orderkey"]
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy(*when))
    alike = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy(*when))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.array(following, alike).alias("to"))
    return rows.select("src", F.explode("to").alias("dst")).filter("dst is not null")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))


def journeys(spark: SparkSession, sf_dir: str) -> Graph:
    """From every order to its customer's next one, and back to the one before of the same priority; weights spread by the orders' numbers."""
    steps = _journey_steps(spark, sf_dir).withColumn("weight", F.expr(f"cast({_JOURNEY_WEIGHT} as double)"))
    return Graph.from_ids(steps, directed=True, nodes=_orders(spark, sf_dir))


def journeys_undirected(spark: SparkSession, sf_dir: str) -> Graph:
    """The same steps without direction, each pair of orders once."""
    pairs = _journey_steps(spark, sf_dir).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    pairs = materialise(pairs, "journeys")  # most operators read them in every round
    return Graph.from_ids(pairs.withColumn("weight", F.expr(f"cast({_JOURNEY_WEIGHT} as double)")), directed=False, nodes=_orders(spark, sf_dir), distinct=True)


_JOURNEY_STEPS = (
    "steps as (select o_orderkey as s, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as t from orders "
    "union all select o_orderkey, lag(o_orderkey) over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) from orders), "
)
JOURNEYS = _JOURNEY_STEPS + "e as (select s as src, t as dst, (1 + (s * 31 + t * 17) % 97)::double as w from steps where t is not null), v as (select o_orderkey as id from orders)"
JOURNEYS_UNDIRECTED = _JOURNEY_STEPS + (
    "pairs as (select s, t, (1 + (s * 31 + t * 17) % 97)::double as w from (select distinct least(s, t) as s, greatest(s, t) as t from steps where t is not null)), "
    "e as (select s as src, t as dst, w from pairs union all select t, s, w from pairs), v as (select o_orderkey as id from orders)"
)


def event_flow(spark: SparkSession, sf_dir: str) -> Graph:
    """From each kind of event to the next kind of the same user; ids are ranks of the kinds' names."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kinds = table(spark, sf_dir, "events")
    rows = kinds.select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return Graph.from_edges(materialise(rows, "flow"), "a", "b", "weight", directed=True)  # a row for each two kinds at most


EVENT_FLOW = (
    "flow as (select a, b, count(*)::double as w from (select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events) where a <> b group by 1, 2), "
    "names as (select label, row_number() over (order by label) - 1 as id from (select a as label from flow union select b from flow)), "
    "e as (select x.id as src, y.id as dst, w from flow join names x on a = x.label join names y on b = y.label), v as (select id from names)"
)


def event_links(spark: SparkSession, sf_dir: str) -> Graph:
    """The event kinds that follow each other, without direction; weights of both ways add up."""
    flow = event_flow(spark, sf_dir)
    pairs = flow.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return Graph.from_ids(pairs.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), directed=False, nodes=flow.nodes)


EVENT_LINKS = EVENT_FLOW.replace("e as (", "d as (").replace("v as (select id from names)", "") + (
    "pairs as (select least(src, dst) as s, greatest(src, dst) as t, sum(w) as w from d group by 1, 2), "
    "e as (select s as src, t as dst, w from pairs union all select t, s, w from pairs), v as (select id from names)"
)
