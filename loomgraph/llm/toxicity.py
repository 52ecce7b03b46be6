"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and beginnings of words is trained with numpy from
confirmed toxic documents and unlabelled ones.  The risk of the unlabelled
class is corrected by the class prior and kept from falling below zero (Kiryo
et al., 2017): R = prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)).

Training reads a bounded sample, in the order of a hash of the ids; scores
come from whole texts of all documents.

Defined cases: null and empty texts get the score of no word at all; without
a toxic example every score is 0; rows with equal ids are scored one by one;
only the text is an input of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .tokens import ragged_take, release_memory, text_slices

#: Documents that training reads at most.
POSITIVES = 3_000
UNLABELLED = 9_000
#: Features that the classifier looks at.
VOCABULARY = 4_096
#: Least G statistic of such a word; chance exceeds it for one word in 100,000.
SIGNIFICANT = 20.0
#: Bytes of the beginnings of words that count as features, and levels of distinct words with the same one.
STEMS = (4, 5, 6, 7, 8)
LEVELS = (1, 2, 4)
#: ASCII punctuation counts as blank.
BLANKS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
SOLID = np.array([b != 32 for b in BLANKS])
#: Bytes of text scored at once.
SLICE_BYTES = 1 << 20


def word_marks(word: bytes) -> list[bytes]:
    """A word itself and its proper beginnings, which stand for a stem."""
    return [word, *(word[:n] + b"*" for n in STEMS if n < len(word))]


def text_words(text: str) -> set[bytes]:
    """Distinct words in lower case, without ASCII punctuation."""
    return set(text.lower().encode().translate(BLANKS).split())


def text_features(text: str) -> list[bytes]:
    """Marks of the words of a text; a mark of several distinct words comes once more at each level it reaches."""
    counts = Counter(m for w in text_words(text) for m in word_marks(w))
    return [m if k == 1 else m + b"#%d" % k for m, n in counts.items() for k in LEVELS if n >= k]


def words_of_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, word) of the different words of each text, and the words; the same ones as ``text_words`` finds."""
    joined = "\0".join([(t or "").replace("\0", " ") for t in texts]).lower().encode()
    raw = np.frombuffer(joined, np.uint8)
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = SOLID[raw]
    step = np.diff(solid)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    owner = np.searchsorted(np.flatnonzero(raw == 0), begin)
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw[ragged_take(begin, end - begin)])])
    coded = words.dictionary_encode()
    n = max(1, len(coded.dictionary))
    owner, code = np.divmod(np.unique(owner * n + coded.indices.to_numpy()), n)
    return owner, code, coded.dictionary


@dataclass
class Model:
    """Weights of features: words, their beginnings (``*``), and levels of these (``#``)."""

    weights: dict[bytes, float]
    bias: float

    def __post_init__(self) -> None:
        marks = sorted({f.rsplit(b"#", 1)[0] for f in self.weights})
        self.at_level = np.array([[self.weights.get(m if k == 1 else m + b"#%d" % k, 0.0) for k in LEVELS] for m in marks]).reshape(-1, len(LEVELS))
        self.values = {0: ([], [])} | {n: ([], []) for n in STEMS}  # by the length of a beginning; 0: whole words
        for i, m in enumerate(marks):
            size = len(m) - 1 if m.endswith(b"*") else 0
            self.values[size][0].append(m.removesuffix(b"*"))
            self.values[size][1].append(i)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text."""
        owner, code, words = words_of_texts(texts)
        sizes = pc.binary_length(words).to_numpy()
        texts_of, marks_of = [], []
        for size, (values, marks) in self.values.items():
            if not values:
                continue
            heads = pc.binary_slice(words, 0, size) if size else words
            spot = pc.index_in(heads, pa.array(values, pa.large_binary())).fill_null(-1).to_numpy()
            spot = np.where((sizes > size) & (spot >= 0), np.array(marks)[spot], -1)[code]
            texts_of.append(owner[spot >= 0])
            marks_of.append(spot[spot >= 0])
        margin = np.full(len(texts), self.bias)
        if texts_of:
            n = len(self.at_level)
            found, counts = np.unique(np.concatenate(texts_of) * n + np.concatenate(marks_of), return_counts=True)
            own, mark = np.divmod(found, n)
            gain = sum(np.where(counts >= k, self.at_level[mark, i], 0.0) for i, k in enumerate(LEVELS))
            margin += np.bincount(own, gain, len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def nn_pu(pos: list[np.ndarray], unl: list[np.ndarray], width: int, prior: float, *, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from the non-negative risk with the logistic loss; rows list their features."""
    rows = pos + unl
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.concatenate([np.zeros(0, np.int64), *rows])
    n_pos = len(pos)
    is_pos = np.arange(len(rows)) < n_pos
    weight, bias = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(at, weight[cols], len(rows)) + bias
        p = 1 / (1 + np.exp(-z))
        loss_minus = np.logaddexp(0, z)
        gap = loss_minus[~is_pos].mean() - prior * loss_minus[is_pos].mean()
        minus = np.where(is_pos, -prior * p / n_pos, p / max(1, len(unl)))
        plus = np.where(is_pos, prior * (p - 1) / n_pos, 0.0)
        dz = plus + minus if gap >= 0 else -minus
        grad = np.append(np.bincount(cols, dz[at], width) + decay * weight, dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def _vocabulary(sample: DataFrame, size: int, least: float) -> list[bytes]:
    """Features that positive documents hold significantly more or less often, by the G statistic of their 2 x 2 table."""
    n_pos, n_all = sample.agg(F.sum("positive"), F.count(F.lit(1))).first()
    if not n_pos:
        return []
    n_unl = n_all - n_pos
    counts = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))

    def term(seen: Column, of: int, part: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (of * part))).otherwise(0.0)

    share = (F.col("p") + F.col("u")) / n_all
    g = 2 * (term(F.col("p"), n_pos, share) + term(F.col("u"), n_unl, share) + term(n_pos - F.col("p"), n_pos, 1 - share) + term(n_unl - F.col("u"), n_unl, 1 - share))
    return [bytes(r[0]) for r in counts.withColumn("g", g).filter(F.col("g") >= least).orderBy(F.desc("g"), "word").limit(size).select("word").collect()]


def train(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED, vocabulary: int = VOCABULARY, prior: float | None = None) -> Model:
    """A model from the toxic rows of ``labels`` and from ``docs`` as unlabelled; pass only rows meant for training.

    ``prior`` is the share of toxic documents among all, by default their share
    among the labelled ones; give it where labels were not drawn at random.
    """
    known = labels.filter("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n_toxic:
        return Model({}, -60.0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = known.filter("toxic = 1").select("doc_id").orderBy(*order).limit(positives).select("doc_id", F.lit(1).alias("positive"))
    others = docs.filter("doc_id is not null").select("doc_id").orderBy(*order).limit(unlabelled).select("doc_id", F.lit(0).alias("positive"))
    picked = toxic.unionAll(others)  # at most positives + unlabelled rows

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(text_features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(words, pa.list_(pa.binary()))], ["positive", "words"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    sample = materialise(texts.select("positive", "text").mapInArrow(split, "positive int, words array<binary>"), "toxicity-sample")
    words = _vocabulary(sample, vocabulary, SIGNIFICANT)
    index = {w: i for i, w in enumerate(words)}

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = [[index[w] for w in ws if w in index] for ws in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(spots, pa.list_(pa.int32()))], ["positive", "spots"])

    found = sorted((int(p), tuple(map(int, s))) for p, s in sample.mapInArrow(locate, "positive int, spots array<int>").collect())
    pos = [np.array(s, np.int64) for p, s in found if p]
    unl = [np.array(s, np.int64) for p, s in found if not p]
    if not pos:
        return Model({}, -60.0)
    weight, bias = nn_pu(pos, unl, len(words), n_toxic / n_known if prior is None else prior)
    return Model({w: float(x) for w, x in zip(words, weight)}, bias)


def score(text: Column, model: Model) -> Column:
    """The score of a text column, from 0 to 1."""

    @F.arrow_udf("double")
    def apply(texts: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([texts], ["text"])
        scores = [model.score(part.column("text").to_pylist()) for part in text_slices(rows, SLICE_BYTES)]
        release_memory()
        return pa.array(np.concatenate(scores or [np.zeros(0)]))

    return apply(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1
