"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from whole texts.  Trees are grown by histograms of binned
features with numpy and flattened into node arrays, so that scoring is a few
array look-ups per level for all documents of a batch.  Chosen features are
monotone: splits against the direction are refused and children stay within
the bounds of their ancestors' split values.

Defined cases: null and empty texts have no words and fail the base rules;
rows with equal ids are judged one by one; a corpus without labels of both
kinds keeps whatever passes the base rules; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

CONTINUATION = bytes(range(0x80, 0xC0))
#: Characters counted as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_pipes", "n_shouts", "n_distinct", "n_lines", "n_short"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "pipes", "shouts", "distinct", "line_words", "short"]
#: Features whose growth may only lower (-1) the score.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
#: Labelled rows that training reads at most, in the order of a hash of their ids.
TRAIN_ROWS = 20_000


def text_counts(text: bytes) -> tuple[int, ...]:
    """The counts named in ``COUNTS`` of one text in UTF-8."""
    words = text.split()
    solid = b"".join(words)
    chars = len(solid.translate(None, CONTINUATION))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        covered = -1
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeats += i + 2 - max(covered, i - 1)
                covered = i + 2
    return (
        len(words), chars, len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats,
        len(solid) - len(solid.translate(None, UPPER)), len(solid) - len(solid.translate(None, DIGITS)),
        solid.count(b"|"), solid.count(b"!"), len(set(words)), len(lines), sum([len(w) < 4 for w in words]),
    )


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id with the counts of its whole text, written to the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_counts(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], ["doc_id", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialise(rows.mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)), "document-counts")


def features(counts: np.ndarray) -> np.ndarray:
    """Rates from a (rows x COUNTS) array, in the order of ``FEATURES``."""
    c = dict(zip(COUNTS, counts.T.astype(np.float64)))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_upper"] / chars, c["n_digits"] / chars, c["n_pipes"] / words, c["n_shouts"] / words, c["n_distinct"] / words, c["n_words"] / lines, c["n_short"] / words,
    ], axis=1)


@dataclass
class Trees:
    """Complete binary trees in arrays: node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, leaf: float = 5.0) -> Trees:
    """Logistic gradient boosting with second-order leaf values and monotone features."""
    edges = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T]
    binned = np.stack([np.searchsorted(e, f, side="left") for e, f in zip(edges, x.T)], axis=1)
    prior = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(len(y), base)
    inner = 2**depth - 1
    all_f, all_t, all_v = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        bounds = {0: (-np.inf, np.inf)}
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            low, high = bounds[k]
            bounds[2 * k + 1] = bounds[2 * k + 2] = (low, high)
            rows = np.flatnonzero(node == k)
            best = (1e-6, None)
            if len(rows):
                gs, hs = g[rows].sum(), h[rows].sum()
                for f in range(x.shape[1]):
                    n_bins = len(edges[f]) + 1
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], n_bins))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], n_bins))[:-1]
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(gl / (hl + 1), low, high), np.clip(gr / (hr + 1), low, high)
                    gain = 2 * gl * vl - (hl + 1) * vl**2 + 2 * gr * vr - (hr + 1) * vr**2 - gs**2 / (hs + 1)
                    gain[(hl < leaf) | (hr < leaf) | (monotone[f] * (vr - vl) < 0)] = -np.inf
                    if len(gain) and gain.max() > best[0]:
                        at = int(gain.argmax())
                        best = (gain[at], (f, at, vl[at], vr[at]))
            if best[1] is not None:
                f, at, vl, vr = best[1]
                feature[k], threshold[k] = f, edges[f][at]
                if monotone[f]:
                    middle = (vl + vr) / 2
                    bounds[2 * k + 1] = (low, middle) if monotone[f] > 0 else (middle, high)
                    bounds[2 * k + 2] = (middle, high) if monotone[f] > 0 else (low, middle)
            node[rows] = 2 * k + 1 + (x[rows, feature[k]] > threshold[k])
        value = np.zeros(inner + 1)
        for leaf_id in range(inner + 1):
            rows = node == inner + leaf_id
            low, high = bounds[inner + leaf_id]
            value[leaf_id] = rate * np.clip(g[rows].sum() / (h[rows].sum() + 1), low, high)
        margin += value[node - inner]
        all_f.append(feature)
        all_t.append(threshold)
        all_v.append(value)
    return Trees(np.array(all_f), np.array(all_t), np.array(all_v), base, depth)


def train(counts: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees from at most ``rows`` labelled documents; None without labels of both kinds."""
    known = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    found = counts.join(F.broadcast(picked), "doc_id").select("quality", *COUNTS).toPandas().to_numpy(np.int64)
    y = found[:, 0].astype(np.float64)
    if len(np.unique(y)) < 2:
        return None
    order = np.lexsort(found.T)
    return boost(features(found[order, 1:]), y[order], np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def with_verdict(counts: DataFrame, trees: Trees | None, least: float = 0.5) -> DataFrame:
    """Add ``quality_score``, and ``good`` where it is at least ``least``."""
    names = counts.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1))
            score = trees.score(x) if trees else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(score >= least)], [*names, "quality_score", "good"])

    fields = ", ".join(f"`{c}` {t}" for c, t in counts.dtypes)
    return counts.mapInArrow(judge, f"{fields}, quality_score double, good boolean")
