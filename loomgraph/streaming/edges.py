"""Edge lists that keep arriving: the same line format as the batch reader, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import weight_of


def stream_edgelist(spark: SparkSession, path: str) -> DataFrame:
    """A streaming table (source, target, weight) of the edge-list files that appear below ``path``."""
    value = F.regexp_replace("value", r"^[ \t\r]+|[ \t\r]+$", "")
    parts = spark.readStream.text(path).select(value.alias("value")).filter("value <> '' and not startswith(value, '#')").select(F.split("value", r"[ \t,]+").alias("p")).filter(F.size("p") >= 2)
    parts = parts.filter(~((F.lower(F.col("p")[0]) == "source") & (F.lower(F.col("p")[1]) == "target")))
    return parts.select(F.col("p")[0].alias("source"), F.col("p")[1].alias("target"), weight_of(F.get("p", F.lit(2))).alias("weight"))


def streaming_out_degrees(edges: DataFrame) -> DataFrame:
    """(source, degree), kept up to date as edges arrive."""
    return edges.groupBy("source").agg(F.count(F.lit(1)).alias("degree"))
