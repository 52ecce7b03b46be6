"""Consecutive numbers in a sort order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import default_partitions, materialise


def with_row_numbers(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the order of ``keys``.

    Rows are range-partitioned and sorted within partitions; only one count
    per partition goes through the driver.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(default_partitions(spark), *keys).sortWithinPartitions(*keys)
    rows = materialise(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("__at", 33)
    bases, base = [], 0
    for p, n in sorted(tuple(r) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect()):
        bases.append((p, base))
        base += n
    offsets = spark.createDataFrame(bases, "__part long, __base long")
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(offsets, part == F.col("__part")).select(*df.columns, (F.col("__base") + local).alias(name))
