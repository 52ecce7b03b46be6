"""Windows that recur: the rounds that both substring operators share.

A window is ``length`` consecutive symbols (words or bytes) of one document.

1. Every block asks which of its anchor grams occur elsewhere (see
   ``anchors``); only windows with such an anchor can recur.
2. The snippet of all windows that an anchor stands for goes, as text, to the
   shard of the anchor, where all snippets that may share a window meet.
   Hashes only bring texts together: equal snippets become one after their
   bytes were compared, in a block and again in a shard, and the operator
   itself groups equal windows from the texts (``Judge``).
3. Blocks get two bits for each window: it recurs, and this snippet's first
   occurrence of it is the first of all.

Anchors of over ``FREQUENT`` occurrences send their windows one by one, routed
by content, so no shard depends on how often one anchor occurs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .anchors import U, anchor_keys, owned_windows, range_hashes
from .blocks import Block, shard_of, split_entries
from .tokens import ragged_take

#: Occurrences of an anchor beyond which its windows travel one by one (a route; results are the same).
FREQUENT = 2_000
#: Bytes compared at once.
CHUNK = 1 << 20


@dataclass
class Symbols:
    """The symbols of a block and the bytes they stand for: symbol i is ``raw[edges[i]:edges[i + 1]]``."""

    symbols: np.ndarray
    first: np.ndarray
    last: np.ndarray
    raw: np.ndarray
    edges: np.ndarray | None = None  # None: every byte is a symbol

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """The document of each symbol."""
        docs = np.flatnonzero(self.last > self.first)
        return docs[np.searchsorted(self.first[docs], at, side="right") - 1]

    def bytes_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the bytes of symbols ``a[i] .. b[i]``."""
        if self.edges is not None:
            a, b = self.edges[a], self.edges[b]
        return a, b - a


@dataclass(frozen=True)
class Windows:
    """What an operator looks for: ``within`` tells whether a window may recur within one document."""

    read: Callable[[Block], Symbols]
    length: int
    gram: int
    within: bool

    @property
    def count_type(self) -> np.dtype:
        """An anchor stands for ``length - gram + 1`` windows at most."""
        return np.min_scalar_type(self.length - self.gram + 1).newbyteorder("<")


# --- round 1 ------------------------------------------------------------------


class Anchors:
    """A block's anchors and their distinct keys."""

    def __init__(self, windows: Windows, block: Block):
        self.content = windows.read(block)
        self.pos = block.extra
        self.key = anchor_keys(self.content.symbols, self.pos, windows.gram)
        self.doc = self.content.doc_of(self.pos)
        order = np.argsort(self.key, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = self.key[order[1:]] != self.key[order[:-1]]
        self.unique = self.key[order[new]]
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.count = np.bincount(self.inverse, minlength=len(self.unique))
        if windows.within or not len(order):
            self.several = self.count > 1
        else:
            ids, bounds = block.doc_id[self.doc][order], np.flatnonzero(new)
            self.several = np.minimum.reduceat(ids, bounds) < np.maximum.reduceat(ids, bounds)


def ask_anchors(windows: Windows, block: Block, shards: int) -> dict[int, bytes]:
    """Entries: a key, whether it recurs in the block already, and how often it occurs."""
    a = Anchors(windows, block)
    tagged = (a.unique & ~U(1)) | a.several.astype(np.uint64)
    count = np.minimum(a.count, 0xFFFF).astype("<u2")
    order, bounds = split_entries(shard_of(a.unique, shards), shards)
    return {s: tagged[order[x:y]].tobytes() + count[order[x:y]].tobytes() for s, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x}


def answer_anchors(entries: list[bytes]) -> list[bytes]:
    """Two rows of bits: the key recurs; it is frequent."""
    sizes = [len(e) // 10 for e in entries]
    tagged = np.concatenate([np.frombuffer(e, np.uint64, n) for e, n in zip(entries, sizes)])
    count = np.concatenate([np.frombuffer(e, "<u2", n, 8 * n) for e, n in zip(entries, sizes)])
    _, inverse, blocks = np.unique(tagged >> U(1), return_inverse=True, return_counts=True)
    several = blocks > 1
    several[inverse[(tagged & U(1)) == 1]] = True
    frequent = several & (np.bincount(inverse, count) > FREQUENT)
    return _bit_rows([several[inverse], frequent[inverse]], sizes)


def _bit_rows(rows: list[np.ndarray], sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [np.packbits(np.stack([r[e - n : e] for r in rows]), axis=1).tobytes() for n, e in zip(sizes, ends)]


def _read_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(2, -1), axis=1, count=n).astype(bool)


# --- round 2 ------------------------------------------------------------------


def equal_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes at ``a[i]`` and ``b[i]`` are the same over ``sizes[i] > 0``."""
    out = np.ones(len(sizes), bool)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK)))
        part = slice(at, stop)
        same = raw[ragged_take(a[part], sizes[part])] == raw[ragged_take(b[part], sizes[part])]
        out[part] = np.logical_and.reduceat(same, ends[part] - sizes[part] - (ends[at] - sizes[at]))
        at = stop
    return out


def merge_equal(raw: np.ndarray, begin: np.ndarray, sizes: np.ndarray, counts: np.ndarray, order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaders, and each snippet's place among them.

    ``order`` lists snippets of one hash next to each other, ``new`` marks the
    first of each hash.  A snippet whose bytes differ from that one's leads itself.
    """
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # of each snippet in order
    same = np.ones(len(order), bool)
    rest = np.flatnonzero(~new)
    rest_of, head_of = order[rest], head[rest]
    alike = (sizes[rest_of] == sizes[head_of]) & (counts[rest_of] == counts[head_of])
    same[rest[~alike]] = False
    rest = rest[alike]
    same[rest] = equal_bytes(raw, begin[order[rest]], begin[head[rest]], sizes[order[rest]])
    leads = new | ~same
    lead = order[leads]
    number = np.cumsum(leads) - 1
    entry = np.empty(len(order), np.int64)
    entry[order] = np.where(same, number[np.flatnonzero(new)[np.cumsum(new) - 1]], number) if len(order) else 0
    return lead, entry


class Snippets:
    """A block's snippets: runs of windows with one recurring anchor; of equal ones the earliest leads."""

    def __init__(self, windows: Windows, block: Block, given: dict[int, bytes], shards: int):
        a = Anchors(windows, block)
        self.content = c = a.content
        recurs, frequent = np.zeros(len(a.unique), bool), np.zeros(len(a.unique), bool)
        order, bounds = split_entries(shard_of(a.unique, shards), shards)
        for s, (x, y) in enumerate(zip(bounds, bounds[1:])):
            if y > x:
                recurs[order[x:y]], frequent[order[x:y]] = _read_bits(given[s], y - x)
        lo, hi = owned_windows(a.pos, a.key, c.first[a.doc], c.last[a.doc], windows.gram, windows.length)
        use = recurs[a.inverse] & (hi >= lo)
        lo, hi, key, doc, often = lo[use], hi[use], a.key[use], a.doc[use], frequent[a.inverse][use]
        single = ragged_take(lo[often], hi[often] - lo[often] + 1)
        self.lo = np.concatenate([lo[~often], single])
        self.count = np.concatenate([hi[~often] - lo[~often] + 1, np.ones(len(single), np.int64)])
        self.doc = np.concatenate([doc[~often], np.repeat(doc[often], hi[often] - lo[often] + 1)])
        self.hash = range_hashes(c.symbols, self.lo, self.lo + self.count - 1 + windows.length)
        self.key = np.concatenate([key[~often], self.hash[len(self.lo) - len(single) :]])
        self.id = block.doc_id[self.doc]
        self.begin, self.size = c.bytes_of(self.lo, self.lo + self.count - 1 + windows.length)
        order = np.lexsort((self.lo, self.id, self.hash))
        new = np.ones(len(order), bool)
        new[1:] = self.hash[order[1:]] != self.hash[order[:-1]]
        self.lead, self.entry = merge_equal(c.raw, self.begin, self.size, self.count, order, new)
        self.leads = np.zeros(len(order), bool)
        self.leads[self.lead] = True
        if windows.within:
            self.several = np.bincount(self.entry, minlength=len(self.lead)) > 1
        else:
            self.several = np.zeros(len(self.lead), bool)
            self.several[self.entry[self.id > self.id[self.lead][self.entry]]] = True
        self.order, self.bounds = split_entries(shard_of(self.key[self.lead], shards), shards)


def _fields(windows: Windows) -> list[tuple[str, np.dtype]]:
    """``key`` and ``hash`` bring texts together, the lowest bit of ``hash`` tells that the block has the snippet again."""
    start = [("start", np.dtype("<u4"))] if windows.within else []
    return [("key", np.dtype("<u4")), ("hash", np.dtype("<u4")), ("id", np.dtype("<i8")), *start, ("count", windows.count_type)]


def ask_snippets(windows: Windows, block: Block, given: list[dict[int, bytes]], shards: int) -> dict[int, bytes]:
    """For each shard the number of distinct snippets, the size, and, compressed, their fields and bytes."""
    s = Snippets(windows, block, given[0], shards)
    out = {}
    for shard, (x, y) in enumerate(zip(s.bounds, s.bounds[1:])):
        if y > x:
            at = s.lead[s.order[x:y]]
            own = {"key": s.key[at] >> U(32), "hash": (s.hash[at] >> U(32) & ~U(1)) | s.several[s.order[x:y]], "id": s.id[at], "start": s.lo[at] - s.content.first[s.doc[at]], "count": s.count[at]}
            text = s.content.raw[ragged_take(s.begin[at], s.size[at])]
            data = b"".join(own[name].astype(kind).tobytes() for name, kind in _fields(windows)) + text.tobytes()
            out[shard] = np.array([len(at), len(data)], "<u4").tobytes() + pa.compress(data, codec="zstd", asbytes=True)
    return out


@dataclass
class Entries:
    """The snippets that reached a shard: their fields, and their bytes at ``begin`` of ``raw``."""

    fields: dict[str, np.ndarray]
    raw: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    numbers: list[int]


def read_entries(windows: Windows, messages: list[bytes], words: bool) -> Entries:
    fields: dict[str, list] = {name: [] for name, _ in _fields(windows)}
    texts, numbers = [], []
    for m in messages:
        n, size = np.frombuffer(m, "<u4", 2).tolist()
        data = pa.decompress(m[8:], decompressed_size=size, codec="zstd", asbytes=True)
        at = 0
        for name, kind in _fields(windows):
            fields[name].append(np.frombuffer(data, kind, n, at))
            at += n * kind.itemsize
        texts.append(np.frombuffer(data, np.uint8, size - at, at))
        numbers.append(n)
    joined = {name: np.concatenate(parts) for name, parts in fields.items()}
    raw = np.concatenate(texts)
    symbols = joined["count"].astype(np.int64) - 1 + windows.length
    ends = np.flatnonzero(raw == 32)[np.cumsum(symbols) - 1] + 1 if words else np.cumsum(symbols)
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return Entries(joined, raw, begin, ends - begin, numbers)


#: Groups of equal windows: (bytes of distinct snippets one after another, their sizes, their numbers of windows,
#: their keys, whether each has copies) -> a number for each window, the same for equal ones, or -1.
Judge = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def answer_snippets(windows: Windows, messages: list[bytes], judge: Judge, words: bool) -> list[bytes]:
    """Two rows of bits for the windows of each message: the window recurs; the snippet has the first of all."""
    e = read_entries(windows, messages, words)
    key, more, ids = e.fields["key"], e.fields["hash"] & 1 == 1, e.fields["id"]
    counts = e.fields["count"].astype(np.int64)
    tag = key.astype(np.uint64) << U(32) | (e.fields["hash"] >> np.uint32(1))
    order = np.argsort(tag, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = tag[order[1:]] != tag[order[:-1]]
    lead, entry = merge_equal(e.raw, e.begin, e.size, counts, order, new)
    copied = (np.bincount(entry, minlength=len(lead)) > 1) | (np.bincount(entry, more, len(lead)) > 0)
    group = judge(e.raw[ragged_take(e.begin[lead], e.size[lead])], e.size[lead], counts[lead], key[lead], copied)
    at = np.cumsum(counts[lead]) - counts[lead]
    group = group[ragged_take(at[entry], counts)]  # of the windows of all entries
    owner = np.repeat(np.arange(len(counts)), counts)
    recurs, first = np.zeros(len(group), bool), np.zeros(len(group), bool)
    found = np.flatnonzero(group >= 0)
    group, owner = group[found], owner[found]
    n_groups = int(group.max(initial=-1)) + 1
    again = np.bincount(group, more[owner], n_groups) > 0
    if windows.within:
        again |= np.bincount(group, minlength=n_groups) > 1
        nth = found - (np.cumsum(counts) - counts)[owner]
        order = np.lexsort((e.fields["start"][owner] + nth, ids[owner], group))
        earliest = np.ones(len(order), bool)
        earliest[1:] = group[order[1:]] != group[order[:-1]]
        first[found[order[earliest]]] = True
    else:
        least, most = np.full(n_groups, np.iinfo(np.int64).max), np.full(n_groups, np.iinfo(np.int64).min)
        np.minimum.at(least, group, ids[owner])
        np.maximum.at(most, group, ids[owner])
        again |= least < most
        first[found] = ids[owner] == least[group]
    recurs[found] = again[group]
    per_message = np.add.reduceat(counts, np.cumsum(e.numbers) - e.numbers).tolist()
    return _bit_rows([recurs, first], per_message)


# --- round 3 ------------------------------------------------------------------


def repeated_windows(windows: Windows, block: Block, given: list[dict[int, bytes]], shards: int) -> tuple[Symbols, np.ndarray]:
    """The symbols of a block, and the starts of its windows that are not the first of their kind."""
    s = Snippets(windows, block, given[0], shards)
    counts = s.count[s.lead]
    at = np.cumsum(counts) - counts
    recurs, first = np.zeros(int(counts.sum()), bool), np.zeros(int(counts.sum()), bool)
    for shard, (x, y) in enumerate(zip(s.bounds, s.bounds[1:])):
        if y > x:
            own = s.order[x:y]
            spots = ragged_take(at[own], counts[own])
            recurs[spots], first[spots] = _read_bits(given[1][shard], len(spots))
    spots = ragged_take(at[s.entry], s.count)
    keeps = s.leads if windows.within else s.id == s.id[s.lead][s.entry]
    gone = recurs[spots] & ~(first[spots] & np.repeat(keeps, s.count))
    return s.content, ragged_take(s.lo, s.count)[gone]
