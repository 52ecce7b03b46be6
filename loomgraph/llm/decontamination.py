"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words of which some are ignored, so
substituted words do not hide a passage.  Benchmark items and documents are
hashed under masks chosen by the items' lengths so that no passage which
counts goes without a hit; the masked hashes are joined, and around each hit
the item's words are laid over the document's and compared.  A passage counts
where a stretch of ``window`` laid-over words (the whole item if shorter) has
a share of at least ``similarity`` of equal words.

A document sends on only the hashes that a bitmap of all benchmark hashes
holds, each with the words that a stretch around it can reach; the bitmap has a
bounded size, and what it lets through by chance finds no partner in the join.
Seeds and items are broadcast up to ``BROADCAST_SEEDS`` and
``BROADCAST_WORDS``, and shuffled beyond.

Defined cases: words are runs of letters and digits in lower case; null and
empty texts have none; items shorter than ``window`` have masks of their own
length; items of under ``LEAST`` words count only where they are a whole
document; rows equal in id and text count once; rows with equal ids and other
texts are searched one by one; empty tables give no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .anchors import mix
from .tokens import ragged_take, release_memory, text_slices

#: By the length of a stretch and the changed words it may hold; 1: the word counts; 0: it is ignored (fixed values).
#: Wherever these words lie, one mask fits the stretch without them: the tests enumerate all places.
MASKS = {
    (13, 2): ("1111111", "11110111", "11101111", "1110100111"),
    (12, 2): ("1111111", "11110111", "11111101", "1100101111", "11011001011"),
    (11, 2): ("111111", "1110111", "1011111", "111001011"),
    (10, 2): ("11111", "111011", "11010011"),
    (9, 1): ("1111111", "11111011", "11101111", "11011111"),
    (8, 1): ("111111", "1111011", "1101111"),
    (7, 1): ("11111", "111011", "110111"),
    (6, 1): ("1111", "11011"),
    (5, 1): ("1111", "11101", "11011", "10111"),
}
WINDOW = 13
SIMILARITY = 0.8
#: Words from which an item may be part of a longer text.
LEAST = 5
#: Seeds and words of items up to which they are broadcast (28 bytes, some 10 bytes each).
BROADCAST_SEEDS = 500_000
BROADCAST_WORDS = 2_000_000
#: Most bits of the bitmap of benchmark hashes.
BITMAP_BITS = 24
#: Bytes of text that a task looks at in one step.
SLICE_BYTES = 2 << 20
WORD = re.compile(r"\w+")
FACTORS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def masks_for(words: int, window: int = WINDOW, similarity: float = SIMILARITY) -> tuple[str, ...]:
    """Masks that hit every passage which counts, for an item of so many words.

    Where no masks are listed, one run of equal words is left between the changed ones.
    """
    stretch = min(window, words)
    changed = max((k for k in range(stretch) if stretch - k >= similarity * stretch), default=0)
    return MASKS.get((stretch, changed)) or ("1" * (stretch // (changed + 1)),)


class Texts:
    """The words of some texts, one after another."""

    def __init__(self, texts: list[str | None]):
        import xxhash

        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        self.sizes = np.array([len(f) for f in found], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.vocabulary = coded.dictionary
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        self.symbols = self.hashes[self.codes]

    def words(self, a: np.ndarray, b: np.ndarray) -> pa.ListArray:
        """The words from ``a[i]`` to ``b[i]``."""
        words = self.vocabulary.take(pa.array(self.codes[ragged_take(a, b - a)]))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32)), words)


def mask_key(mask: str, whole: bool) -> int:
    """A number for a mask; ``whole`` for one that must cover its text."""
    return int(mask, 2) << 7 | len(mask) << 1 | whole


def masked_hashes(texts: Texts, mask: str, whole: bool, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place of the first word, hash) wherever the mask fits within a text and all counted words are ``known``."""
    span, n = len(mask), len(texts.codes)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = np.zeros(n + 1, np.int32)
    fits = (texts.sizes == span) if whole else (texts.sizes >= span)
    ok[texts.first[fits]] += 1
    ok[texts.first[fits] + texts.sizes[fits] - span + 1] -= 1
    ok = (np.cumsum(ok[:n]) > 0)[: n - span + 1]
    keep = [i for i, c in enumerate(mask) if c == "1"]
    if known is not None:
        for k in keep:
            ok &= known[k : k + len(ok)]
    at = np.flatnonzero(ok)
    h = np.full(len(at), mask_key(mask, whole), np.uint64)
    for i, k in enumerate(keep):
        h += texts.symbols[at + k] * FACTORS[i]
    filled = np.flatnonzero(texts.sizes)
    return filled[np.searchsorted(texts.first[filled], at, side="right") - 1], at, mix(h)


SEEDS = "hash long, item_key long, item_id long, item_place int"
ITEMS = "item_key long, item_id long, words array<string>"


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_key, item_id, words) of the different rows of a benchmark that have words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column("text").to_pylist())
            words = texts.words(texts.first, texts.first + texts.sizes)
            out = pa.RecordBatch.from_arrays([batch.column("item_key"), batch.column("item_id"), words], ["item_key", "item_id", "words"])
            yield out.filter(pa.array(texts.sizes > 0))

    rows = benchmark.filter("text is not null").select(F.xxhash64("text").alias("item_key"), F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return materialise(rows.mapInArrow(split, ITEMS), "benchmark-items")


def _seeds(items: DataFrame, window: int, similarity: float, least: int) -> DataFrame:
    """Masked hashes of all items; ``place`` is where the mask starts in the item."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in enumerate(batch.column("words").to_pylist()):
                texts, rows = Texts([" ".join(words)]), []
                for mask in masks_for(len(words), window, similarity):
                    _, at, h = masked_hashes(texts, mask, len(words) < least)
                    rows.append((h, at, np.full(len(at), mask_key(mask, len(words) < least))))
                h, at, key = (np.concatenate(c) for c in zip(*rows))
                item = pa.array(np.full(len(h), i, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), batch.column("item_key").take(item), batch.column("item_id").take(item), pa.array(at.astype(np.int32)), pa.array(key.astype(np.int64))],
                    ["hash", "item_key", "item_id", "item_place", "mask"],
                )

    return materialise(items.mapInArrow(hashes, SEEDS + ", mask long"), "benchmark-seeds")


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Which values the upper ``bits`` of a column of hashes take; 8 bytes for each 64 of them reach the driver at most."""
    spot = F.shiftrightunsigned("hash", 64 - bits)
    rows = hashes.select(F.shiftright(spot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))").alias("b"))
    out = np.zeros(max(1, (1 << bits) // 64), np.int64)
    for w, b in rows.groupBy("w").agg(F.bit_or("b")).collect():
        out[w] = b
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _bits_for(n: int) -> int:
    return min(BITMAP_BITS, max(10, int(16 * n).bit_length()))


def _hits(docs: DataFrame, masks: list[tuple[str, bool]], words: np.ndarray, seeds: np.ndarray, reach: int) -> DataFrame:
    """Masked hashes of documents that the bitmap of ``seeds`` holds, with the words around them.

    ``place`` is where the mask starts in the document, ``before`` how many of the words lie in front of it.
    """
    word_shift, seed_shift = (np.uint64(65 - len(b).bit_length()) for b in (words, seeds))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, SLICE_BYTES):
                texts = Texts(part.column("text").to_pylist())
                known = words[(mix(texts.hashes) >> word_shift).astype(np.int64)][texts.codes]
                for mask, whole in masks:
                    doc, at, h = masked_hashes(texts, mask, whole, known)
                    use = seeds[(h >> seed_shift).astype(np.int64)]
                    if not use.any():
                        continue
                    doc, at, h = doc[use], at[use], h[use]
                    a = np.maximum(texts.first[doc], at - reach)
                    b = np.minimum(texts.first[doc] + texts.sizes[doc], at + len(mask) + reach)
                    rows = pa.array(doc)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(rows), part.column("text_key").take(rows), pa.array(h.view(np.int64)), pa.array((at - texts.first[doc]).astype(np.int64)), pa.array((at - a).astype(np.int32)), pa.array(texts.sizes[doc]), texts.words(a, b)],
                        ["doc_id", "text_key", "hash", "place", "before", "doc_words", "around"],
                    )
            release_memory()

    return docs.mapInArrow(find, "doc_id long, text_key long, hash long, place long, before int, doc_words long, around array<string>")


def _coded(*columns: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, first place, length) of the lists of words in each column; equal words have equal codes."""
    flat = [c.flatten() for c in columns]
    codes = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy()
    ends = np.cumsum([len(f) for f in flat])
    out = []
    for column, values, end in zip(columns, flat, ends):
        lengths = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        out.append((codes[end - len(values) : end], np.cumsum(lengths) - lengths, lengths))
    return out


def _verified(pairs: DataFrame, window: int, similarity: float, least: int) -> DataFrame:
    """Hits whose passage counts: where it begins in the document, its words, and which of the item's are equal.

    Word ``item_place`` of the item lies on word ``before`` of ``around``. All
    hits of a batch are laid over at once; ``row`` is the hit of an overlap's word.
    """
    names = ["doc_id", "text_key", "item_key", "item_id", "shift", "low", "high", "equal"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (own, own_first, own_size), (text, text_first, text_size) = _coded(batch.column("words"), batch.column("around"))
            item_place, before, place, doc_words = (batch.column(c).to_numpy().astype(np.int64) for c in ("item_place", "before", "place", "doc_words"))
            shift = before - item_place
            low, high = np.maximum(0, -shift), np.minimum(own_size, text_size - shift)
            stretch = np.minimum(window, own_size)
            use = np.flatnonzero((high - low >= stretch) & ((own_size >= least) | (own_size == doc_words)))
            size, low, stretch = (high - low)[use], low[use], stretch[use]
            first = np.cumsum(size) - size
            row = np.repeat(np.arange(len(use)), size)
            at = np.arange(len(row)) - first[row]
            equal = own[ragged_take(own_first[use] + low, size)] == text[ragged_take(text_first[use] + low + shift[use], size)]
            sums = np.concatenate([[0], np.cumsum(equal)])
            starts = np.flatnonzero(at <= (size - stretch)[row])
            ends = starts + stretch[row[starts]]
            good = sums[ends] - sums[starts] >= similarity * stretch[row[starts]]
            starts, ends = starts[good], ends[good]
            if not len(starts):
                continue
            counts = np.cumsum(np.bincount(starts, minlength=len(row) + 1) - np.bincount(ends, minlength=len(row) + 1))[:-1] > 0
            hit, begin, n = np.unique(row[starts], return_index=True, return_counts=True)
            words = np.flatnonzero(equal & counts)
            split = np.searchsorted(row[words], np.append(hit, len(use)))
            lists = pa.ListArray.from_arrays(pa.array(split.astype(np.int32)), pa.array((low[row[words]] + at[words]).astype(np.int32)))
            kept = batch.take(pa.array(use[hit]))
            found = [(place - item_place)[use[hit]], (low[hit] + starts[begin] - first[hit]).astype(np.int32), (low[hit] + ends[begin + n - 1] - 1 - first[hit]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names[:4]), *map(pa.array, found), lists], names)

    return pairs.mapInArrow(verify, "doc_id long, text_key long, item_key long, item_id long, shift long, low int, high int, equal array<int>")


def passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """(doc_id, text_key, item_id, word_start, n_words, n_equal): the best place of each item in each document."""
    items = _items(benchmark)
    seeds = _seeds(items, window, similarity, least)
    lengths = items.select(F.size("words").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("items")).collect()  # as many rows as different lengths
    masks = sorted({(m, n < least) for n, _ in lengths for m in masks_for(n, window, similarity)})
    n_words, n_seeds = sum(n * k for n, k in lengths), seeds.count()
    words = items.select(F.explode("words").alias("word")).distinct().mapInArrow(_word_hashes, "hash long")
    found = _hits(
        docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"),
        masks, _bitmap(words, _bits_for(n_words)), _bitmap(seeds, _bits_for(n_seeds)), window - 1,
    )
    slim, whole = seeds.drop("mask"), items
    if n_seeds <= BROADCAST_SEEDS:
        slim = F.broadcast(slim)
    if n_words <= BROADCAST_WORDS:
        whole = F.broadcast(whole)
    pairs = found.join(slim, "hash").alias("f").join(whole.alias("i"), F.expr("f.item_key = i.item_key and f.item_id <=> i.item_id")).select("f.*", "i.words")
    pairs = materialise(pairs, "benchmark-pairs")  # so that no task needs two Python workers
    laid = _verified(pairs, window, similarity, least).groupBy("doc_id", "text_key", "item_key", "item_id", "shift")
    laid = laid.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_set("equal")))).alias("n_equal"))
    place = F.struct(F.col("n_equal").cast("long").alias("n_equal"), (-F.col("shift") - F.col("low")).alias("back"), (F.col("high") - F.col("low") + 1).cast("long").alias("n_words"))
    best = laid.groupBy("doc_id", "text_key", "item_key", "item_id").agg(F.max(place).alias("p"))
    return best.select("doc_id", "text_key", "item_id", (-F.col("p.back")).alias("word_start"), "p.n_words", "p.n_equal")


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        hashes = mix(np.array([xxhash.xxh64_intdigest(w) for w in batch.column("word").to_pylist()], np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])


def contaminated(docs: DataFrame, benchmark: DataFrame, **rule) -> DataFrame:
    """(doc_id, item_id, word_start, n_words, n_equal) of every benchmark passage found; ``rule`` as for ``passages``."""
    return passages(docs, benchmark, **rule).drop("text_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **rule) -> DataFrame:
    """The documents, all columns, that hold no benchmark passage."""
    found = passages(docs, benchmark, **rule).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    at = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    return docs.join(found, at, "left_anti")
