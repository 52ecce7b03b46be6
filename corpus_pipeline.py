"""From raw documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.

1. toxicity: documents scored 0.7 or more go; the model learns from ``labels``;
2. near-duplicates: one document of each group stays (SimHash finds candidates;
   links are those whose 5-word shingles have a Jaccard similarity of
   ``NEAR_FROM`` or more);
3. substring dedup: words of 20-word windows that occur earlier go;
4. decontamination: documents with a passage of ``benchmark`` go;
5. packing: what is left becomes sequences of 2048 tokens.

Defined cases: a document whose text is null or becomes empty stays, with an
empty text after stage 3; rows with one doc_id and text count as one document,
those with other texts as documents of their own; a null doc_id comes last; an
empty table passes through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, near_copies, packing, phrase_dedup, toxicity
from loomgraph.llm.tokens import vocabulary_path
from loomgraph.storage import materialise

TOXIC_FROM = 0.7
#: Jaccard similarity over 5-word shingles from which documents are near copies.
NEAR_FROM = 0.8
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(*COLUMNS).filter(toxicity.score(F.col("text"), model) < TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    extra = near_copies.near_copies(docs, 5, NEAR_FROM).filter("not stays").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    own = docs.select(*COLUMNS)
    at = own["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(own["text"], F.lit(""))) == F.col("__key"))
    return own.join(extra, at, "left_anti")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = phrase_dedup.remove_repeats(docs, 20, keep=["lang", "source"])
    return left.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(docs, vocabulary_path("byte_bpe_50k.json"), 0, 2048, spaced=True)
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: SQL can express neither the learnt scores nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
