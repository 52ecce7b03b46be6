"""Substring deduplication by suffix arrays.

A byte is removed where a string of ``length`` bytes that covers it also
starts in a document with a smaller id.  Texts are UTF-8; strings never cross
documents.

Snippets of text that may share such a string meet in one shard (see
``repeats``); other text cannot repeat and is not sorted.  In each shard the
different snippets are cut into arrays of ``ARRAY_BYTES``, and

1. all suffixes of an array are sorted: ranks by 5-byte prefixes are refined by
   prefix doubling (Larsson and Sadakane) in numpy, until ranks tell ``length``
   bytes apart;
2. strings that follow each other in that order are compared; runs that share
   ``length`` bytes are groups of equal strings.  Where the strings are so long
   that this costs more, common prefixes are computed in text order (Kasai et al.);
3. strings whose anchor occurs in several arrays are merged between the
   arrays by binary search in their sorted strings.

Groups alone tell which strings occur in which documents.

Defined cases: a null text is empty; a null ``doc_id`` counts as larger than
any id; rows with equal ids don't repeat each other; texts under ``length``
bytes lose nothing; an empty table gives no rows; removal may cut characters,
so the bytes left are binary; only the text column is looked at; any
``length`` of 1 or more will do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import BYTE_SYMBOLS, U, covered, find_anchors
from .blocks import Block, ask, finish, make_blocks, shard_count
from .repeats import Symbols, Windows, answer_anchors, answer_snippets, ask_anchors, ask_snippets, repeated_windows
from .tokens import ragged_take

#: Bytes of an anchor string; shorter windows have anchors of half their length.
GRAM = 24
#: Bits of a position in a suffix array; a rank and the rank further on share 64 bits with it.
SPOT = 21
#: Bytes of snippets in one suffix array (a longer snippet has one of its own).
ARRAY_BYTES = 1 << 20
#: Bytes compared for each byte of an array beyond which common prefixes are computed instead (a route; results are the same).
COMPARED = 64
#: Bytes of strings held at once.
CHUNK = 4 << 20


def windows_of(length: int) -> Windows:
    return Windows(byte_symbols, length, min(GRAM, (length + 1) // 2), False)


def byte_symbols(block: Block) -> Symbols:
    raw = np.frombuffer(block.buffer, np.uint8)
    return Symbols(BYTE_SYMBOLS[raw], block.starts, block.ends, raw)


def suffix_array(text: np.ndarray, depth: int | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """All suffixes in order; with ``depth``, in any order among those that agree in so many bytes.

    With ``wanted`` (a bit for each position) only those suffixes need to be in
    order among themselves; the last round, whose ranks nothing reads, leaves out the others.

    Ranks by 5 bytes are refined by doubling: a suffix's next key is the rank
    of the suffix h bytes on, and only groups of equal rank are sorted again.
    Keys and positions are sorted together as numbers of 64 bits.
    """
    n = len(text)
    if n >= 1 << SPOT:
        raise ValueError(f"a suffix array holds under {1 << SPOT} bytes")
    spot, mask = U(SPOT), U((1 << SPOT) - 1)
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for j in range(5):
        key = (key << U(8)) | padded[j : n + j]
    back = np.arange(n - 1, -1, -1, dtype=np.uint64)  # of equal heads the shorter suffix first: zero bytes are no end
    key = np.sort((key << spot) | back)
    sa = n - 1 - (key & mask).astype(np.int64)
    key >>= spot
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (sa[:-1] > n - 5)
    rank = np.zeros(n + 1, np.uint64)  # behind the end: below every rank
    h = 5
    rank[sa] = np.cumsum(new, dtype=np.uint64)
    while depth is None or h < depth:
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        last = depth is not None and 2 * h >= depth
        if last and wanted is not None:
            tied = tied[wanted[sa[tied]]]
        if not len(tied):
            break
        at = sa[tied]
        key = np.sort((rank[at] << U(2 * SPOT)) | (rank[np.minimum(at + h, n)] << spot) | back[at])
        sa[tied] = n - 1 - (key & mask).astype(np.int64)
        if last:
            break
        key >>= spot
        cut = np.ones(len(tied), bool)
        cut[1:] = key[1:] != key[:-1]
        new[tied] |= cut
        rank[sa] = np.cumsum(new, dtype=np.uint64)
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, up to ``depth``.

    Kasai's walk in text order, where the next suffix shares at least one byte
    less; all snippets (``starts``, ``sizes``) walk at the same time.
    """
    n = len(text)
    padded = np.zeros(n + depth + 1, np.int16)
    padded[:n] = text
    padded[n:] = -1
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    found = np.zeros(n, np.int64)
    h = np.zeros(len(starts), np.int64)
    for step in range(int(sizes.max(initial=0))):
        lane = np.flatnonzero(sizes > step)
        at = starts[lane] + step
        prev = before[at]
        have = np.where(prev >= 0, np.maximum(h[lane] - 1, 0), 0)
        go = np.flatnonzero((prev >= 0) & (have < depth))
        while len(go):
            p, q, x = at[go], prev[go], have[go]
            inside = (p + x < n) & (q + x < n)
            same = inside & (padded[np.minimum(p + x, n)] == padded[np.minimum(q + x, n)])
            go = go[same]
            have[go] += 1
            go = go[have[go] < depth]
        found[at] = have
        h[lane] = have
    return found


def same_as_before(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at ``order[i]`` are those at ``order[i - 1]``."""
    out = np.zeros(len(order), bool)
    strings = np.lib.stride_tricks.sliding_window_view(text, length)
    step = max(1, CHUNK // length)
    for a in range(1, len(order), step):
        held = strings[order[a - 1 : a + step]]
        out[a : a + step] = (held[1:] == held[:-1]).all(axis=1)
    return out


def equal_strings(text: np.ndarray, sizes: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Group numbers of ``windows`` (positions), in order of their strings: equal where their ``length`` bytes are equal."""
    group = np.empty(len(text), np.int64)
    if len(windows) * length > COMPARED * len(text):
        sa = suffix_array(text, length)
        lcp = common_prefixes(text, sa, np.cumsum(sizes) - sizes, sizes, length)
        group[sa] = np.cumsum(lcp[sa] < length)
    else:
        wanted = np.zeros(len(text), bool)
        wanted[windows] = True
        sa = suffix_array(text, length, wanted)
        order = sa[wanted[sa]]
        group[order] = np.cumsum(~same_as_before(text, order, length))
    return group[windows]


def _strings(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return np.ascontiguousarray(text[at[:, None] + np.arange(length)]).view(f"S{length}").ravel()


def merge_arrays(text: np.ndarray, windows: np.ndarray, group: np.ndarray, arrays: list[np.ndarray], length: int) -> np.ndarray:
    """Group numbers over several arrays; ``arrays`` lists the windows of each that others may hold."""
    strings, numbers = np.zeros(0, f"S{length}"), np.zeros(0, np.int64)
    out = group.copy()
    for own in arrays:
        _, first, inverse = np.unique(group[own], return_index=True, return_inverse=True)
        found = _strings(text, windows[own[first]], length)  # in order, as groups are
        number = group[own[first]]
        if len(strings):
            spot = np.minimum(np.searchsorted(strings, found), len(strings) - 1)
            same = strings[spot] == found
            number = np.where(same, numbers[spot], number)
            found, fresh = found[~same], number[~same]
        else:
            fresh = number
        out[own] = number[inverse]
        into = np.searchsorted(strings, found)
        strings, numbers = np.insert(strings, into, found), np.insert(numbers, into, fresh)
    return out


def shard_groups(text: np.ndarray, sizes: np.ndarray, counts: np.ndarray, keys: np.ndarray, length: int, most: int = ARRAY_BYTES) -> np.ndarray:
    """Group numbers of all windows of a shard's snippets, which come in order of their ``keys``."""
    begin = np.cumsum(sizes) - sizes
    windows = ragged_take(begin, counts)
    at = np.concatenate([[0], np.cumsum(counts)])
    group = np.zeros(len(windows), np.int64)
    edges, known = [0], 0
    while edges[-1] < len(sizes):
        a = edges[-1]
        edges.append(max(a + 1, int(np.searchsorted(begin + sizes, begin[a] + most, side="right"))))
    for a, b in zip(edges, edges[1:]):
        base, end = begin[a], begin[b - 1] + sizes[b - 1]
        part = slice(at[a], at[b])
        group[part] = known + equal_strings(text[base:end], sizes[a:b], windows[part] - base, length)
        known = int(group[part].max()) + 1
    shared = []
    for a, b in zip(edges, edges[1:]):  # an anchor stands in several arrays only at their edges
        wide = np.zeros(b - a, bool)
        if a:
            wide |= (keys[a:b] == keys[a]) & (keys[a - 1] == keys[a])
        if b < len(sizes):
            wide |= (keys[a:b] == keys[b - 1]) & (keys[b] == keys[b - 1])
        shared.append(ragged_take(at[a:b][wide], counts[a:b][wide]))
    return merge_arrays(text, windows, group, shared, length) if len(edges) > 2 else group


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): removed runs counted, and the bytes left."""
    windows = windows_of(length)

    def rows(block: Block, given: list, shards: int) -> pa.RecordBatch:
        _, starts = repeated_windows(windows, block, given, shards)
        gone = covered(starts, length, len(block.buffer))
        removed = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        solid = block.starts[block.ends > block.starts]
        begins[solid] = gone[solid]
        spans = np.concatenate([[0], np.cumsum(begins)])
        raw = np.frombuffer(block.buffer, np.uint8)
        kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(block.starts, block.ends)]
        n_removed, n_spans = removed[block.ends] - removed[block.starts], spans[block.ends] - spans[block.starts]
        return pa.RecordBatch.from_arrays([block.ids(), pa.array(block.ends - block.starts), pa.array(n_removed), pa.array(n_spans), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    def anchors(block: Block) -> np.ndarray:
        return find_anchors(byte_symbols(block).symbols, block.starts, block.ends, windows.gram, length)

    def judge(text, sizes, counts, keys, copied) -> np.ndarray:
        return shard_groups(text, sizes, counts, keys, length)

    blocks = make_blocks(docs, anchors)
    shards = shard_count(blocks)
    hot = ask(blocks, [], lambda b, given, n: ask_anchors(windows, b, n), answer_anchors, "repeated-anchors", shards)
    seen = ask(blocks, [hot], lambda b, given, n: ask_snippets(windows, b, given, n), lambda e: answer_snippets(windows, e, judge, False), "repeated-snippets", shards)
    return finish(blocks, [hot, seen], rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", shards)
