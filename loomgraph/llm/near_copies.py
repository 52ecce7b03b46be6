"""Near copies by the exact Jaccard similarity of their word shingles.

Candidates come from operator 6's method: SimHash fingerprints, here of the sets
of shingles, whose bits are dealt into groups with thresholds as planned there.
A text has several words of 64 bits.  Within each word two fingerprints that
differ in fewer bits than there are groups are certain to meet; sets of
similarity s differ in a bit with probability acos(2s / (1 + s)) / pi at most,
so texts farther apart meet by one of the words, and their number is chosen so
that all miss a pair with probability ``MISS`` at most.  What meets is a
candidate where its first ``CHECKED`` words differ in few enough bits, which
turns away another ``MISS`` at most.  No radius of one word alone would do:
at 0.8 it would be 19 of 64 bits, too wide to probe.

Candidates by MinHash bands, ``BANDS`` keys of ``ROWS`` minima each, are there
to compare with (``candidates="minhash"``); a pair of similarity j shares no key
with probability (1 - j**ROWS)**BANDS, 1.5 in 10,000 at 0.8.

Candidates only say which texts to hold against each other: their components
are verified by the exact similarity of the shingle sets, and only verified
links join texts.  Within a component a text meets just those that no link has
reached yet.  Components of over ``MEMBERS`` are cut into chunks, every two of
which meet in a task of their own, so no task grows with a group.

Defined cases: texts are split and lowered as for SimHash; null and empty texts
have no shingles and are copies of each other; fewer words than a shingle count
as one; a null ``doc_id`` names a group only where there is no other; rows with
equal ids and other texts are documents of their own, rows equal in both stay or
go together; equal sets of shingles are one class from the start, by 64-bit
hashes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import component_labels
from ..storage import materialise
from . import simhash
from .tokens import release_memory, text_slices

#: What the fingerprints may miss of pairs at the similarity asked for: as much again where they meet and are checked.
MISS = 5e-5
#: Words of a fingerprint by which candidates are told from what shares a bucket.
CHECKED = 6
#: Groups of bits in a word, up to so many sets of shingles: keys of 10, 12 and 16 bits.
GROUPS = ((1 << 20, 6), (1 << 23, 5), (1 << 62, 4))
#: Members of a bucket that are all held against each other at once.
SQUARE = 512
BANDS, ROWS = 48, 8
#: Texts of a component that one task verifies without cutting it.
MEMBERS = 512
CHUNK = 2_048
_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) >= words else [b" ".join(tokens)]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles)), np.uint64))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function."""
    low, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), CHUNK):
        np.minimum(least, (_A * low[at : at + CHUNK] + _B).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """Keys of all bands, from rows of minima."""
    mixed = least.reshape(-1, BANDS, ROWS).astype(np.uint64) * _MIX
    mixed ^= mixed >> np.uint64(31)
    return (mixed * _MIX[::-1]).sum(axis=2, dtype=np.uint64)


def sketch(shingles: np.ndarray, words: int) -> np.ndarray:
    """The SimHash fingerprint of the set: a bit is 1 where over half the shingles have it."""
    counts = np.zeros(simhash.BITS * words, np.int64)
    seeds = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(shingles), 255):  # as many as a byte can count
        x = shingles[at : at + 255, None] + seeds
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(shingles)).view(np.int64)


def differing(similarity: float) -> float:
    """The probability that a bit differs, at most, between sets of this similarity."""
    return acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def sketch_plan(n: int, similarity: float) -> tuple[int, int, int]:
    """Words of a fingerprint, groups in each, and bits of the checked words in which candidates may differ."""
    differ, bits = differing(similarity), simhash.BITS * CHECKED
    groups = next(g for most, g in GROUPS if n <= most)
    missed = 1.0
    for i in range(groups):
        missed *= 1 - (1 - differ) ** (simhash.BITS // groups + (i < simhash.BITS % groups))
    words = max(CHECKED, ceil(log(MISS) / log(max(missed, MISS))))
    tail, most = 1.0, -1
    while tail > MISS:
        most += 1
        tail -= comb(bits, most) * differ**most * (1 - differ) ** (bits - most)
    return words, groups, most


def verified_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect whatever pairs of this similarity connect."""
    shingles, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    left, mark, found = order[sizes[order] > 0], np.zeros(len(shingles), bool), []
    while len(left):
        todo, left = [left[-1]], left[:-1]
        while todo and len(left):
            i = todo.pop()
            own = flat[starts[i] : starts[i] + sizes[i]]
            # ``left`` stays in order of size, and sets of other sizes cannot be similar enough
            a, b = np.searchsorted(sizes[left], [similarity * sizes[i] * (1 - 1e-9), sizes[i] / similarity * (1 + 1e-9)], side="left")
            near = left[a:b]
            if not len(near):
                continue
            mark[own] = True
            common = np.array([np.count_nonzero(mark[flat[starts[k] : starts[k] + sizes[k]]]) for k in near])
            mark[own] = False
            hit = common >= similarity * (sizes[i] + sizes[near] - common) * (1 - 1e-12)
            found += [(int(i), int(k)) for k in near[hit]]
            todo += near[hit].tolist()
            left = np.concatenate([left[:a], near[~hit], left[b:]])
    return found


def _prints(docs: DataFrame, words: int, width: int, digest: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, text_key, node, keys): ``node`` names the set of shingles, ``keys`` are ``width`` numbers of it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in text_slices(batch):
                sets = [shingle_set(t, words) for t in part.column("text").cast(pa.binary()).to_pylist()]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
                flat = pa.array(np.concatenate([digest(s) for s in sets]).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * width), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(nodes.view(np.int64)), lists], ["doc_id", "text_key", "node", "keys"])
        release_memory()

    return materialise(_texts(docs).mapInArrow(read, "doc_id long, text_key long, node long, keys array<long>"), "near-prints")


def bit_statistics(classes: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each of their words how often two bits are set together."""
    side = simhash.BITS**2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((words, simhash.BITS, simhash.BITS))
        for batch in batches:
            prints = batch.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(-1, words)
            n += len(prints)
            for k in range(words):
                bits = simhash.bit_matrix(prints[:, k]).astype(np.float32)
                both[k] += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, words * side)), pa.array([n, *both.ravel().astype(np.int64)], pa.int64())], ["at", "n"])

    found = {r[0]: r[1] for r in classes.select("keys").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect()}
    both = np.array([found.get(i, 0) for i in range(words * side)], float)
    return found.get(-1, 0), both.reshape(words, simhash.BITS, simhash.BITS)


def bucket_forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect whatever pairs of rows within ``most`` bits connect."""
    columns, left, found = np.ascontiguousarray(prints.T), np.arange(len(prints)), []
    if len(left) <= SQUARE:
        apart = np.zeros((len(left), len(left)), np.uint16)
        for c in columns:
            apart += np.bitwise_count(c[:, None] ^ c)
        left = np.flatnonzero((apart <= most).sum(axis=1) > 1)
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            apart = np.zeros(len(left), np.uint16)
            for c in columns:
                apart += np.bitwise_count(c[left] ^ c[i])
            hit = apart <= most
            near, left = left[hit], left[~hit]
            found += [(int(i), int(k)) for k in near]
            todo += near.tolist()
    return found


def _bucket_links(rows: DataFrame, most: int) -> DataFrame:
    """Links (u, v) that connect what is within ``most`` bits and has a key in common."""

    def links(table: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
        node = table.column("node").to_numpy()
        prints = np.stack([table.column(f"w{k}").to_numpy() for k in range(CHECKED)], axis=1).view(np.uint64)
        found = [(node[a + i], node[a + k]) for a, b in zip(edges, edges[1:]) if b - a > 1 for i, k in bucket_forest(prints[a:b], most)]
        if found:
            u, v = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([carry, table]) if carry is not None else table
            key = table.column("key").to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
            carry = table.slice(edges[-1])  # its bucket may go on in the next batch
            yield from links(table, edges)
        if carry is not None:
            yield from links(carry, [0, carry.num_rows])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "u long, v long").distinct()


def simhash_links(classes: DataFrame, words: int, groups: int, most: int) -> DataFrame:
    """Candidate links (u, v) between nodes, by the planned groups of bits of every word."""
    n, both = bit_statistics(classes, words)
    choices = []
    for k in range(words):
        for i, (bits, t) in enumerate(simhash.plan_probes(n, both[k], groups - 1, (groups,))):
            mask = simhash._signed(sum(1 << b for b in bits))
            choices += [(k, k * groups + i, mask, simhash._signed(flip)) for flip in [0, *simhash._flips(bits, t)]]
    names = [("k", "int"), ("part", "int"), ("mask", "long"), ("flip", "long")]
    table = F.array(*[F.struct(*[F.lit(x).cast(kind).alias(name) for x, (name, kind) in zip(c, names)]) for c in choices])
    rows = classes.select("node", "keys", F.explode(table).alias("c"))
    # buckets that a collision of this hash throws together are told apart by the checked words
    key = F.xxhash64("c.part", F.get("keys", F.col("c.k")).bitwiseAND(F.col("c.mask")).bitwiseXOR(F.col("c.flip")))
    return _bucket_links(rows.select("node", key.alias("key"), *[F.get("keys", F.lit(k)).alias(f"w{k}") for k in range(CHECKED)]), most)


def minhash_links(classes: DataFrame) -> DataFrame:
    """Candidate links (u, v) between nodes that share the key of a band."""
    keys = classes.select("node", F.posexplode("keys").alias("band", "key"))
    least = keys.groupBy("band", "key").agg(F.min("node").alias("u"), F.max("node").alias("last")).filter("u < last").drop("last")
    return keys.join(least, ["band", "key"]).filter("node > u").select("u", F.col("node").alias("v"))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _exact_links(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Verified links (u, v) within the groups of equal ``component``, ``a`` and ``b``."""

    def verify(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        sets = [shingle_set(t, words) for t in table.column("text").cast(pa.large_binary()).to_pylist()]
        u, v = np.array(verified_links(sets, similarity), np.int64).reshape(-1, 2).T
        del sets
        release_memory()
        return pa.table({"u": node[u], "v": node[v]})

    return texts.groupBy("component", "a", "b").applyInArrow(verify, "u long, v long")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, members: int = MEMBERS, candidates: str = "simhash") -> DataFrame:
    """(doc_id, text_key, component_id, stays), a row for each document.

    ``component_id`` is the smallest doc_id reachable over pairs of at least this
    similarity.  In each group the documents that share the smallest pair of
    ``doc_id`` (null last) and ``text_key``, the text's hash, stay.
    """
    if candidates not in ("simhash", "minhash"):
        raise ValueError(f"no such candidates: {candidates}")
    if candidates == "simhash":
        plan = sketch_plan(docs.count(), similarity)
        prints = _prints(docs, words, plan[0], lambda s: sketch(s, plan[0]))
    else:
        prints = _prints(docs, words, BANDS, lambda s: band_keys(minima(s)[None]).ravel())
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = prints.groupBy("node").agg(F.min(rank).alias("first"), F.min(F.struct("text_key", "doc_id")).alias("sample"), F.first("keys").alias("keys"))
    classes = materialise(classes, "near-classes")
    shared = component_labels(simhash_links(classes, *plan) if candidates == "simhash" else minhash_links(classes))
    shared = materialise(shared.withColumnRenamed("id", "node"), "near-candidates")
    sizes = shared.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / members).cast("int").alias("chunks"))
    asked = shared.join(sizes, "component").join(classes.select("node", F.col("sample.text_key").alias("text_key"), F.col("sample.doc_id").alias("sample_id")), "node")
    asked = materialise(asked, "near-asked")
    texts = _texts(docs)
    texts = texts.join(asked, (texts.text_key == asked.text_key) & texts.doc_id.eqNullSafe(asked.sample_id)).select("component", "node", "text", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("own"), "chunks")
    texts = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # two chunks meet once; a chunk alone is part of every such meeting
    met = texts.filter("chunks = 1 or own <> other").select("component", "node", "text", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    labels = component_labels(_exact_links(met, words, similarity)).withColumnRenamed("id", "node")
    labelled = materialise(classes.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")), "near-labels")
    # written, so that the join below may split a component that many texts share
    names = materialise(labelled.groupBy("component").agg(F.min("first").alias("least")), "near-names")
    groups = labelled.join(names, "component").select("node", "least")
    out = prints.select("doc_id", "text_key", "node").join(groups, "node")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    return out.select("doc_id", "text_key", F.col("least.doc_id").alias("component_id"), stays.alias("stays"))
