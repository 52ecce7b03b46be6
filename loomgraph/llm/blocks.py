"""Blocks of documents and exchanges between them.

Finding repeated windows takes a few rounds in which every block of documents
asks questions about its content and gets answers.  Blocks are packed where
the documents are read, so texts are never shuffled; they are written once, as
a bucketed table, and later rounds join the small answers to them without
moving them again.

A question travels as one row per (block, shard) with an array of entries, and
the answer comes back in the order of the question, so it needs no keys.
Equal entries of a block are asked once: a key that a third of all documents
share costs one entry per block.  Shards and buckets grow with the input, so
what a task holds stays the same; there are never more rows than entries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import default_partitions, fresh_path, materialise
from .tokens import release_memory

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20
#: Shards of questions for each shuffle partition, and the most blocks of text for each shard.
SHARDS = 2
SHARD_BLOCKS = 6
#: Buckets that Spark allows a table to have.
MOST_BUCKETS = 100_000
#: Stands for a null id: no id is larger.
NO_ID = np.iinfo(np.int64).max

class Block:
    """Documents of a block: their ids, and their texts one after another in ``buffer``."""

    def __init__(self, payload: bytes):
        batch = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.known_id = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        self.doc_id = batch.column("doc_id").fill_null(NO_ID).to_numpy()
        texts = batch.column("text")
        texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        self.buffer = data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b""
        self.starts, self.ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        self.kept = {n: batch.column(n).combine_chunks() for n in batch.column_names[3:]}
        extra = batch.column("extra").chunk(0)
        self.extra = np.frombuffer(extra[0].as_py(), np.uint32).astype(np.int64) if len(extra) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.doc_id)

    def ids(self) -> pa.Array:
        return pa.array(self.doc_id, mask=~self.known_id)


def _pack(rows: pa.Table, prepare: Callable[[Block], np.ndarray]) -> bytes:
    """The rows (doc_id, text, extra, kept columns) as an Arrow stream; ``extra`` holds what ``prepare`` finds."""

    def payload(extra: bytes) -> bytes:
        table = rows.set_column(2, "extra", pa.array([extra] + [None] * (len(rows) - 1), pa.binary()))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    return payload(prepare(Block(payload(b""))).astype(np.uint32).tobytes())


def make_blocks(docs: DataFrame, prepare: Callable[[Block], np.ndarray], keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, payload): a bucketed table of packed documents, with what ``prepare`` finds in each block.

    Columns named by ``keep`` travel along.
    """
    spark = docs.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, held, size
            payload = _pack(pa.concat_tables(held).combine_chunks(), prepare)
            out = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([payload], pa.binary())], ["block", "payload"])
            block, held, size = block + 1, [], 0
            return out

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.set_column(1, "text", table.column("text").cast(pa.large_binary()))
            table = table.add_column(2, "extra", pa.nulls(len(table), pa.binary()))
            ends = np.cumsum(pc.binary_length(table.column("text")).to_numpy())
            at = 0
            while at < len(table):
                base = ends[at - 1] if at else 0
                stop = int(np.searchsorted(ends, base + block_bytes - size, side="right"))
                if stop > at or not held:
                    stop = max(stop, at + 1)
                    held.append(table.slice(at, stop - at))
                    size += int(ends[stop - 1] - base)
                    at = stop
                if at < len(table) or size >= block_bytes:
                    yield flush()
        if held:
            yield flush()
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(keep or []))
    name = f"blocks_{uuid.uuid4().hex}"
    packed = rows.mapInArrow(pack, "block long, payload binary")
    buckets = min(max(default_partitions(spark), packed._jdf.queryExecution().toRdd().getNumPartitions() // 2), MOST_BUCKETS)
    packed.write.format("parquet").option("compression", "none").option("path", fresh_path(spark, name)).bucketBy(buckets, "block").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalog; the files stay, and the DataFrame knows them and their buckets
    return blocks


def shard_count(blocks: DataFrame) -> int:
    """Shards for the questions of these blocks, so that each meets a bounded share of the text."""
    return max(SHARDS * default_partitions(blocks.sparkSession), -(-blocks.count() // SHARD_BLOCKS))


def _answers(row: dict) -> dict[int, bytes]:
    return {x["shard"]: x["data"] for x in row or []}


def _with_answers(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Blocks with a column ``answer<i>`` for each round so far; only answers are shuffled."""
    out = blocks
    for i, rows in enumerate(answers):
        grouped = rows.groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias(f"answer{i}"))
        out = out.join(grouped.hint("merge"), "block", "left")
    return out


def _blocks_in(batches: Iterator[pa.RecordBatch], rounds: int) -> Iterator[tuple[int, Block, list[dict[int, bytes]]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            payload = batch.column("payload")[i].as_py()
            answers = [_answers(batch.column(f"answer{r}")[i].as_py()) for r in range(rounds)]
            yield batch.column("block")[i].as_py(), Block(payload), answers


def ask(blocks: DataFrame, answers: list[DataFrame], question: Callable, answer: Callable, name: str, shards: int) -> DataFrame:
    """One round: each block's ``question`` goes by shard to ``answer``; returns the answers, materialised.

    ``question(block, answers, shards)`` gives the entries for each shard as
    bytes, ``answer(list of entries)`` the replies in the same order.
    """
    rounds = len(answers)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, content, given in _blocks_in(batches, rounds):
            entries = question(content, given, shards)
            if entries:
                keys = sorted(entries)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(keys)), pa.array(keys, pa.int32()), pa.array([entries[k] for k in keys], pa.binary())], ["block", "shard", "data"])
        release_memory()

    def reply(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        found = answer(table.column("data").to_pylist())
        release_memory()
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "data": pa.array(found, pa.binary())})

    schema = "block long, shard int, data binary"
    sent = _with_answers(blocks, answers).mapInArrow(send, schema)
    dealt = sent.repartition(-(-shards // SHARDS), "shard")
    return materialise(dealt.groupBy("shard").applyInArrow(reply, schema), name)


def finish(blocks: DataFrame, answers: list[DataFrame], result: Callable[[Block, list[dict[int, bytes]], int], pa.RecordBatch], schema: str, shards: int) -> DataFrame:
    """Rows that ``result(block, answers, shards)`` gives for each block."""
    rounds = len(answers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, content, given in _blocks_in(batches, rounds):
            yield result(content, given, shards)
        release_memory()

    return _with_answers(blocks, answers).mapInArrow(run, schema)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def split_entries(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by shard, and the bounds of each shard in it."""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))
