"""Queries over the driver's tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path
from . import decontamination, licenses, packing, phrase_dedup, quality, sharding, simhash, suffix_dedup, token_orc, toxicity
from .tokens import vocabulary_path

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
TOXIC_FROM = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    pieces = packing.token_pieces(docs, vocabulary_path(BYTE_VOCABULARY), 0, 2048, spaced=True)
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(digest, 2048)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), _table(spark, sf_dir, "labels")
    held_out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs.filter(~held_out), labels.filter(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _documents(spark, sf_dir).select("doc_id", "lang", "source", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    sharded = sharding.hilbert_shards(rows, ["lang", "source", "size"], 24, ["size", "text_crc32", "doc_id"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = phrase_dedup.remove_repeats(_documents(spark, sf_dir), 20)
    kept = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(_documents(spark, sf_dir), 50)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-orc")
    token_orc.write_token_orc(_documents(spark, sf_dir), path, vocabulary_path(WORD_VOCABULARY), 2, spaced=False)
    return token_orc.ids_checksum(token_orc.read_token_orc(spark, path))


def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = quality.document_counts(_documents(spark, sf_dir))
    trees = quality.train(counts, _table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = quality.with_verdict(counts, trees)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "quality_score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_license_scan": op2_license_scan,
        "op3_toxicity": op3_toxicity,
        "op4_hilbert_shards": op4_hilbert_shards,
        "op5_phrase_dedup": op5_phrase_dedup,
        "op6_simhash": op6_simhash,
        "op7_spaced_seeds": op7_spaced_seeds,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_token_orc": op9_token_orc,
        "op10_quality_trees": op10_quality_trees,
    }


PHRASE_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
p as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w)),
f as (select doc_id, i, row_number() over (partition by k order by doc_id, i) as nth from p),
g as (select distinct doc_id, i + j as pos from f, range(20) r(j) where nth > 1),
k as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from w),
t as (select doc_id, count(*) as n_words, count(g.pos) as n_removed, coalesce(string_agg(word, ' ' order by k.pos) filter (g.pos is null), '') as kept from k left join g using (doc_id, pos) group by doc_id)
select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join t using (doc_id)"""

BYTES_SQL = """
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
p as (select doc_id, i, unhex(substr(h, (2 * i + 1)::bigint, 100)) as k from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as i from d)),
m as (select k, min(doc_id) as first from p group by k having count(*) > 1),
f as (select doc_id, i, first from p join m using (k)),
s as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i) + 50, -1) as new from f where first < doc_id),
r as (select doc_id, i, sum(new::int) over (partition by doc_id order by i) as run from s),
x as (select doc_id, run, min(i) as a, max(i) + 50 as b from r group by all),
y as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as last from x),
z as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, (2 * last + 1)::bigint, (2 * (a - last))::bigint), '' order by a) || substr(any_value(h), (2 * max(b) + 1)::bigint) as kept from y join d using (doc_id) group by doc_id)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join z using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.scan_sql(), "op5_phrase_dedup": PHRASE_SQL, "op8_suffix_dedup": BYTES_SQL}
