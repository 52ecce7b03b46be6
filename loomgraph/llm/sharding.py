"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised by its quantiles over all rows, which keeps the
order of its values, so that a run of the curve covers a small box in every
dimension and files can be pruned by the minimum and maximum of any of them.
Rows are sorted by curve index and cut into runs whose row counts differ by
one at most.

Defined cases: nulls take the lowest cell of a dimension; a null text has no
bytes; rows with equal keys follow each other in any order; an empty table
gives no rows; columns named hilbert, shard, slot or position are replaced, and
others stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import with_positions

BITS = 6


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of ``cells`` (rows x dimensions, values below 2**bits), after Skilling (2004)."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] ^= np.where(high, p, t)
            x[i] ^= np.where(high, np.uint64(0), t)
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= t
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << one) | ((x[i] >> np.uint64(b)) & one)
    return index.astype(np.int64)


def quantile_edges(df: DataFrame, column: str, bits: int) -> list:
    """The least value of each of at most 2**bits cells of about equal row counts."""
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed, total = with_positions(values, ["value"], "n")
    cell = F.floor(F.col("position") * (1 << bits) / F.lit(max(total, 1)))
    return sorted(r[0] for r in placed.groupBy(cell.alias("cell")).agg(F.min("value").alias("edge")).select("edge").collect())


def with_hilbert(df: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """Add ``hilbert``, the curve index of the quantised ``dimensions``."""
    edges = {c: np.array(quantile_edges(df, c, bits), dtype=object) for c in dimensions}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, len(dimensions)), np.int64)
            for i, c in enumerate(dimensions):
                coded = batch.column(c).dictionary_encode()
                spots = [max(0, int(np.searchsorted(edges[c], v, side="right")) - 1) for v in coded.dictionary.to_pylist()]
                at = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                cells[:, i] = np.where(at >= 0, np.array([*spots, 0])[at], 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_index(cells, bits))], [*batch.schema.names, "hilbert"])

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(index, f"{fields}, hilbert long")


def hilbert_shards(df: DataFrame, dimensions: list[str], shards: int, ties: list[str], bits: int = BITS) -> DataFrame:
    """Add ``shard`` and ``slot``: runs of the curve with row counts at most one apart."""
    df = df.drop("hilbert", "shard", "slot", "position")
    placed, total = with_positions(with_hilbert(df, dimensions, bits), ["hilbert", *ties])
    placed = placed.withColumn("shard", F.expr(f"cast(position * {shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("slot", F.col("position") - first).drop("position")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, rows in curve order, for pruning by the dimensions' minima and maxima."""
    rows = sharded.repartition("shard").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
