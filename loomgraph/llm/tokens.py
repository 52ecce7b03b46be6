"""Token ids of whole texts by the tokenizers library, one call per distinct piece.

Both vocabularies used here split a text before merging, and no merge crosses
the place before a blank or a line feed that stands between two other
characters, nor the place between a letter and a punctuation mark.  A text
therefore encodes to the concatenation of its pieces' ids, and each distinct
piece of a batch is encoded once.  A text holding a piece for which this does
not hold (with further white space at an end) is encoded whole.  Vocabularies
that drop white space are the ones that fold case, so there pieces are folded
first.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces a worker remembers; beyond it the memory starts anew.
CACHE_PIECES = 700_000

#: Pieces encoded in one call.
GROUP = 2_000

#: Parts pieces; texts that hold it themselves are encoded whole.
CUT = "\x01"
#: A Latin letter and a punctuation mark behind it: no token holds both (an apostrophe may belong to a word).
BEFORE_MARKS, CUT_MARKS = r"([A-Za-z])([.,;:!?%&$#*|)])", "\\1" + CUT + "\\2"


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a file; strings of special tokens count as plain text."""
    import os

    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def vocabulary_path(name: str) -> str:
    """Where this machine keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def release_memory() -> None:
    """Give freed memory back to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - ends + lengths, lengths)


class Encoder:
    """Encodes batches of texts and remembers pieces between batches."""

    def __init__(self, path: str, spaced: bool):
        """``spaced``: a blank belongs to the piece behind it (byte-level vocabularies)."""
        self.tokenizer, self.spaced = load_tokenizer(path), spaced
        self.joint = "\n" if spaced else f" {CUT} "
        (self.joint_id,) = self._whole([self.joint])[0]
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.safe = (np.zeros(0, t) for t in (np.int64, np.int64, bool))
        self.values = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ragged(self, shown: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and each piece's number of ids; many pieces go in one call."""
        values, sizes = [], []
        for at in range(0, len(shown), GROUP):
            group = shown[at : at + GROUP]
            ids = np.array(self._whole([self.joint.join(group)])[0], np.uint32)
            cuts = np.flatnonzero(ids == self.joint_id)
            if len(cuts) == len(group) - 1:
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                values.append(np.delete(ids, cuts))
            else:  # a piece holds the joint itself
                each = self._whole(group)
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
                values.append(np.array([i for x in each for i in x], np.uint32))
        return np.concatenate(values), np.concatenate(sizes).astype(np.int64)

    def _learn(self, pieces: list[str]) -> None:
        if self.spaced:
            bodies = [p[1:] if p[:1] in ("\n", " ") else p for p in pieces]
            safe = [b.strip() == b and (b != "" or p == "") for p, b in zip(pieces, bodies)]
            lines = np.fromiter((p[:1] == "\n" for p in pieces), bool, len(pieces))
            shown = ["x" if b == "" else b if p[0] == "\n" else p for p, b in zip(pieces, bodies)]
        else:
            safe, lines = [True] * len(pieces), np.zeros(len(pieces), bool)
            shown = [p or "x" for p in pieces]
        values, lengths = self._ragged(shown)
        if "" in pieces:
            at = pieces.index("")
            ends = np.cumsum(lengths)
            values = np.delete(values, np.arange(ends[at] - lengths[at], ends[at]))
            lengths[at] = 0
        if lines.any():
            values, lengths = np.insert(values, (np.cumsum(lengths) - lengths)[lines], self.joint_id), lengths + lines
        at = len(self.known)
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(lengths) - lengths])
        self.values = np.concatenate([self.values, values])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.safe = np.concatenate([self.safe, np.array(safe, bool)])
        self.known.update(zip(pieces, range(at, at + len(pieces))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids."""
        n = len(texts)
        texts = texts.cast(pa.large_string())
        marked = np.flatnonzero(pc.match_substring(texts, CUT).to_numpy(zero_copy_only=False))
        cut = pc.replace_substring_regex(texts, BEFORE_MARKS, CUT_MARKS)
        if self.spaced:
            cut = pc.replace_substring(pc.replace_substring(cut, " ", CUT + " "), "\n", CUT + "\n")
        else:
            cut = pc.replace_substring(pc.replace_substring(pc.ascii_lower(cut), " ", CUT), "\n", CUT)
        lists = pc.split_pattern(cut, CUT)
        counts = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.known) + len(pieces) > CACHE_PIECES:
            self._reset()
        if fresh := [p for p in pieces if p not in self.known]:
            self._learn(fresh)
        slots = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        where = slots[coded.indices.to_numpy(zero_copy_only=False)]
        owner = np.repeat(np.arange(n), counts)
        bad = np.union1d(owner[~self.safe[where]], marked).astype(np.int64)
        sizes = self.lengths[where]
        if len(bad):
            sizes = np.where(np.isin(owner, bad), 0, sizes)
        values = self.values[ragged_take(self.starts[where], sizes)]
        totals = np.bincount(owner, weights=sizes, minlength=n).astype(np.int64)
        if len(bad):
            whole = self._whole([texts[int(i)].as_py() for i in bad])
            ends = np.cumsum(totals)
            parts, last = [], 0
            for i, ids in zip(bad, whole):
                parts += [values[last : ends[i]], np.array(ids, np.uint32)]
                last, totals[i] = ends[i], len(ids)
            values = np.concatenate([*parts, values[last:]])
        return values, totals


@lru_cache(maxsize=2)
def shared_encoder(path: str, spaced: bool) -> Encoder:
    """The encoder of this worker process, which keeps its pieces from task to task."""
    return Encoder(path, spaced)


def append_id(values: np.ndarray, totals: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``end_id`` behind each text's ids."""
    out = np.full(len(values) + len(totals), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(totals + 1) - 1] = False
    out[keep] = values
    return out, totals + 1


def text_slices(batch: pa.RecordBatch, limit: int = 4 << 20):
    """Cut a batch so that the texts of a slice hold about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    groups = np.cumsum(sizes, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
