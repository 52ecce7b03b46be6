"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits from the XXH64 values of word shingles.  Two of them
link where at most ``radius`` bits differ.  Bits are grouped into partitions
so that correlated bits share one; a partition i gets its own threshold t_i
with sum(t_i + 1) = radius + 1, chosen by dynamic programming on the expected
number of candidates and probes.  Two linked fingerprints then differ in at
most t_i bits within some partition i, so probing every partition with all
values up to its threshold misses no link, and candidates are verified.

Work is on distinct fingerprints: equal ones form one class from the start.
Within a bucket only a spanning forest of the verified links is emitted, and
buckets over ``BUCKET`` members are split once more by the bits that their key
leaves free (with radius 3, at most 2**16 distinct fingerprints then share one).

A second fingerprint over longer shingles may verify links beyond the small
radius that one fingerprint alone can bear: two texts then link where both
fingerprints are near.

Defined cases: null and empty texts have fingerprint zero and link like any
other; fewer words than a shingle hash as one sequence; a null ``doc_id``
belongs to a group but never names it; equal rows share their group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import component_labels
from ..storage import materialise

BITS = 64
#: Members of a bucket that one task compares without a further split.
BUCKET = 2_048
#: What a shuffled probe row costs in units of one candidate comparison.
PROBE_COST = 256.0
CHUNK = 8_192
#: Numbers of bit groups among which the plan of least cost is taken.
PARTS = (2, 3, 4)


def fingerprint_bytes(text: bytes, words: int, seed: int) -> bytes:
    """The fingerprint of one text, most significant byte first."""
    import xxhash

    digest, tokens = xxhash.xxh64_digest, text.lower().split()
    if not tokens:
        return bytes(8)
    if len(tokens) < words:
        shingles = iter([b" ".join(tokens)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
        n = len(tokens) - words + 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = b"".join([digest(s, seed) for s, _ in zip(shingles, range(min(CHUNK, n - at)))])
        counts += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, verify_words: int | None = None) -> DataFrame:
    """(doc_id, node, fp, check): fingerprints as signed longs; ``node`` names what has the same ones.

    ``check`` is the fingerprint over ``verify_words``, or 0 without them.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fp, check = (np.frombuffer(b"".join([fingerprint_bytes(t, n, seed) for t in texts]) if n else bytes(8 * len(texts)), ">i8").astype(np.int64) for n in (words, verify_words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), pa.array(check)], ["doc_id", "fp", "check"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = materialise(rows.mapInArrow(digest, "doc_id long, fp long, check long"), "fingerprints")
    return found.withColumn("node", F.xxhash64("fp", "check") if verify_words else F.col("fp"))


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of distinct fingerprints, and how often each pair of bits is set together, over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = bit_matrix(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *i], pa.int32()), pa.array([-1, *j], pa.int32()), pa.array([n, *both.ravel().astype(np.int64)], pa.int64())], ["i", "j", "n"])

    found = classes.select("fp").mapInArrow(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect()
    both = np.zeros((BITS, BITS))
    n = 0
    for i, j, c in found:
        if i < 0:
            n = c
        else:
            both[i, j] = c
    return n, both


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones; column b is bit b."""
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Equal groups of bits; each bit follows the one before it in order of correlation."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    corr = np.abs(cov / scale)
    np.fill_diagonal(corr, -1.0)
    left, groups = set(range(BITS)), []
    for i in range(parts):
        width = BITS // parts + (i < BITS % parts)
        rest = sorted(left)
        seed = max(rest, key=lambda b: (corr[b, rest].max(), -b))
        group = [seed]
        while len(group) < width:
            rest = [b for b in sorted(left) if b not in group]
            group.append(max(rest, key=lambda b: (corr[b, group].mean(), -b)))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def thresholds(n: int, both: np.ndarray, groups: list[list[int]], radius: int) -> tuple[list[int], float]:
    """Thresholds t_i with sum(t_i + 1) = radius + 1 of least expected cost, and that cost.

    A partition's expected candidates come from the distribution of the number
    of differing bits between two fingerprints, a sum of independent bits with
    the frequencies of all rows; -1 leaves a partition out.
    """
    p = np.diag(both) / max(n, 1)
    costs = []
    for group in groups:
        distances = np.array([1.0])
        for b in group:
            differ = 2 * p[b] * (1 - p[b])
            distances = np.convolve(distances, [1 - differ, differ])
        near = np.cumsum(distances)
        row, probes = [0.0], 0
        for t in range(radius + 1):
            probes += comb(len(group), t)
            row.append(PROBE_COST * n * probes + n * n / 2 * near[min(t, len(group))])
        costs.append(row)
    best = [(0.0, [])] + [(np.inf, [])] * (radius + 1)
    for row in costs:
        best = [min(((best[s - k][0] + row[k], [*best[s - k][1], k - 1]) for k in range(s + 1)), key=lambda c: c[0]) for s in range(radius + 2)]
    return best[-1][1], best[-1][0]


def plan_probes(n: int, both: np.ndarray, radius: int, choices: tuple[int, ...]) -> list[tuple[list[int], int]]:
    """Bit groups with their thresholds, for the number of groups of least cost."""
    plans = []
    for parts in choices:
        groups = correlated_parts(n, both, parts)
        found, cost = thresholds(n, both, groups, radius)
        plans.append((cost, [(g, t) for g, t in zip(groups, found) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: list[int], most: int) -> list[int]:
    out, last = [], [(0, -1)]
    for _ in range(most):
        last = [(mask | 1 << bits[j], j) for mask, i in last for j in range(i + 1, len(bits))]
        out += [mask for mask, _ in last]
    return out


def _variants(rows: DataFrame, plan: list[tuple[list[int], int]], names: tuple[str, str]) -> DataFrame:
    """For each fingerprint its own key of every group, and the keys of all values within the group's threshold."""
    choices = []
    for i, (bits, t) in enumerate(plan):
        mask = sum(1 << b for b in bits)
        choices += [(i, _signed(mask), _signed(flip), flip == 0) for flip in [0, *_flips(bits, t)]]
    table = F.array(*[F.struct(F.lit(i).cast("int").alias("i"), F.lit(m).cast("long").alias("m"), F.lit(x).cast("long").alias("x"), F.lit(own).alias("own")) for i, m, x, own in choices])
    kept = [c for c in rows.columns if c != "own"]
    out = rows.select(*kept, F.explode(table).alias("__v"))
    return out.select(*kept, F.col("__v.i").alias(names[0]), F.col("fp").bitwiseAND(F.col("__v.m")).bitwiseXOR(F.col("__v.x")).alias(names[1]), F.col("__v.own").alias("own"))


def _forest(node: np.ndarray, fp: np.ndarray, check: np.ndarray, own: np.ndarray, radius: int, verify: int) -> list[tuple[int, int]]:
    """Links that connect whatever verified links connect within one bucket."""
    edges, label = [], np.arange(len(fp))
    for i in np.flatnonzero(own):
        near = np.flatnonzero(np.bitwise_count((fp ^ fp[i]).view(np.uint64)) <= radius)
        if len(near) > 1 and verify < BITS:
            near = near[np.bitwise_count((check[near] ^ check[i]).view(np.uint64)) <= verify]
        if len(near) < 2:
            continue
        roots, first = np.unique(label[near], return_index=True)
        if len(roots) > 1:
            edges += [(int(node[i]), int(node[near[k]])) for r, k in zip(roots, first) if r != label[i]]
            label[np.isin(label, roots)] = roots[0]
    return edges


def _bucket_links(rows: DataFrame, keys: list[str], radius: int, verify: int) -> DataFrame:
    """Links (u, v) found within the buckets named by ``keys``; rows hold node, fp, check and own."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None

        def runs(table: pa.Table, last: bool):
            nonlocal carry
            cols = [table.column(k).to_numpy() for k in keys]
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            edges = np.append(np.flatnonzero(new), table.num_rows)
            if not last:
                carry = table.slice(edges[-2])
                edges = edges[:-1]
            else:
                carry = None
            if len(edges) < 2:
                return
            node, fp, check, own = (table.column(c).to_numpy() for c in ("node", "fp", "check", "own"))
            sizes = np.diff(edges)
            owned = np.add.reduceat(own[: edges[-1]].astype(np.int64), edges[:-1])
            found = []
            for k in np.flatnonzero((sizes > 1) & (owned > 0)):
                a, b = edges[k], edges[k + 1]
                found += _forest(node[a:b], fp[a:b], check[a:b], own[a:b], radius, verify)
            if found:
                u, v = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                yield from runs(pa.concat_tables([carry, table]) if carry is not None else table, False)
        if carry is not None:
            yield from runs(carry, True)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(scan, "u long, v long")


def links(classes: DataFrame, radius: int = 3, verify: int = BITS, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """Links (u, v) between nodes of ``classes`` (node, fp, check): a spanning forest of every bucket's verified links.

    Linked are fingerprints that differ in ``radius`` bits at most and whose
    checks differ in ``verify`` bits at most.
    """
    n, both = bit_statistics(classes)
    plan = plan_probes(n, both, radius, parts)
    nodes = classes.select("node", "fp", "check")
    rows = _variants(nodes, plan, ("part", "key"))
    own = _variants(nodes, [(bits, 0) for bits, _ in plan], ("part", "key"))
    hot = materialise(own.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET).drop("n"), "hot-buckets")
    if hot.isEmpty():
        return _bucket_links(rows, ["part", "key"], radius, verify)
    found = _bucket_links(rows.join(hot, ["part", "key"], "left_anti"), ["part", "key"], radius, verify)
    crowded = rows.join(hot, ["part", "key"], "left_semi")
    pieces = (radius + 2) // 2  # of the other bits: one of them differs in one bit at most
    for i, (bits, _) in enumerate(plan):
        free = [b for b in range(BITS) if b not in bits]
        split = [(free[k::pieces], 1) for k in range(pieces)]
        inner = _variants(crowded.filter(F.col("part") == i), split, ("part2", "key2"))
        found = found.unionAll(_bucket_links(inner, ["part", "key", "part2", "key2"], radius, verify))
    return found


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 3, verify_words: int | None = None, verify_radius: int = BITS, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links between fingerprints."""
    prints = fingerprints(docs, words, seed, verify_words)
    classes = materialise(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("check").alias("check"), F.min("doc_id").alias("first")), "fingerprint-classes")
    if classes.isEmpty():
        return prints.select("doc_id", "fp", F.col("doc_id").alias("component_id"))
    labels = component_labels(links(classes, radius, verify_radius, parts)).withColumnRenamed("id", "node")
    labelled = materialise(classes.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")), "fingerprint-labels")
    # written, so that the join below may split a component that many fingerprints share
    names = materialise(labelled.groupBy("component").agg(F.min("first").alias("component_id")), "fingerprint-names")
    groups = labelled.join(names, "component").select("node", "component_id")
    return prints.join(groups, "node").select("doc_id", "fp", "component_id")
