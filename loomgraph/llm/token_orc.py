"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters.

``write_token_orc`` range-partitions documents by id, so each file holds a
closed run of ids in ascending order, and writes one row per document: the
ids are an ``array<int>`` column, which ORC stores with its integer
run-length encoding.  Row indexes and stripe statistics on ``doc_id`` prune by
range, Bloom filters on ``doc_id`` prune point look-ups, and a reader may
split a file at its stripes.

Defined cases: a null text counts as empty and gives the end id alone; a null
``doc_id`` sorts first; rows with equal ids stand next to each other in any
order; an empty table gives no rows; other columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import default_partitions
from .tokens import append_id, shared_encoder, text_slices

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1_000
#: Files whose offsets are broadcast (16 bytes each).
BROADCAST_FILES = 200_000


def write_token_orc(docs: DataFrame, path: str, vocabulary: str, end_id: int, *, spaced: bool, files: int | None = None) -> None:
    """Write ``docs`` (doc_id, text) as ORC files below ``path``; ``part`` numbers them in id order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = shared_encoder(vocabulary, spaced), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in text_slices(batch):
                values, totals = append_id(*encoder.encode(piece.column("text")), end_id)
                ends = np.cumsum(totals)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(totals), part, np.int32)), pa.array(start + ends - totals), pa.array(totals), ids],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                start += int(totals.sum())

    files = files or default_partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    out = rows.mapInArrow(encode, SCHEMA)
    options = {
        "compression": "zstd",
        "orc.stripe.size": str(STRIPE_BYTES),
        "orc.create.index": "true",
        "orc.row.index.stride": str(ROW_INDEX_STRIDE),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    out.write.options(**options).orc(path)


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files with ``start``, the ids of all documents before each one.

    The offsets of files come from their ``n_tokens`` columns alone: one
    number per file reaches the driver, and goes back as a broadcast of as
    many rows as there are files, unless these are over ``BROADCAST_FILES``.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum("n_tokens")).collect())
    bases, base = [], 0
    for part, total in totals:
        bases.append((part, base))
        base += total
    offsets = spark.createDataFrame(bases, "part int, base long")
    if len(bases) <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def ids_checksum(df: DataFrame) -> DataFrame:
    """Replace ``ids`` by the unsigned crc32 of the ids as little-endian 32-bit integers."""
    kept = [c for c in df.columns if c != "ids"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, offsets = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(crc, pa.int64())], [*kept, "ids_crc32"])

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "ids")
    return df.mapInArrow(digest, f"{fields}, ids_crc32 long")
