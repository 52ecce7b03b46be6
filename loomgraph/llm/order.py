"""Global positions in a sort order, without ever sorting in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import default_partitions, materialise


def with_positions(df: DataFrame, keys: list[str], weight: str | None = None) -> tuple[DataFrame, int]:
    """Add ``position``: the sum of ``weight`` (or the count of rows) in front of each row, ordered by ``keys``.

    Rows are dealt by range and sorted within tasks; each task's total, one
    number per task, goes through the driver.  Also returns the grand total.
    Rows with equal keys follow each other in any order, fixed once written.
    """
    names = df.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            size = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64) if weight else np.ones(n, np.int64)
            local = base + np.cumsum(size) - size
            base += int(size.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(local), pa.array(size)], [*names, "__part", "__local", "__size"])

    spark = df.sparkSession
    dealt = df.repartitionByRange(default_partitions(spark), *keys).sortWithinPartitions(*keys)
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    rows = materialise(dealt.mapInArrow(number, f"{fields}, __part int, __local long, __size long"), "positions")
    bases, total = [], 0
    for part, size in sorted(tuple(r) for r in rows.groupBy("__part").agg(F.sum("__size")).collect()):
        bases.append((part, total))
        total += size
    offsets = spark.createDataFrame(bases, "__part int, __base long")
    placed = rows.join(offsets, "__part").select(*names, (F.col("__base") + F.col("__local")).alias("position"))
    return placed, total
