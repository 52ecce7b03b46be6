"""Anchors: places in a sequence that equal windows choose alike.

Every window of ``w`` symbols has the ``k``-gram of least hash among its
``w - k + 1`` ones as its anchor.  The choice depends on the window's content
alone, so equal windows have equal anchors at equal places, and looking at
repeated anchors misses no repeated window.  About one symbol in
``(w - k + 2) / 2`` is an anchor.

All functions work on whole blocks of documents with numpy; symbols are
unsigned 64-bit integers, and wrap-around is meant.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Grams hashed at once.
GRAMS = 1 << 13
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random symbol for each byte.
BYTE_SYMBOLS = mix((np.arange(256, dtype=np.uint64) + U(1)) * U(BASE))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i below ``n``, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k``-grams, by doubling."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, out, size, power = 0, None, 1, symbols
    while True:
        if k & size:
            if out is None:
                out = power
            else:
                m = min(len(out), len(power) - done) if len(power) > done else 0
                out = out[:m] * U(pow(BASE, size, 1 << 64)) + power[done : done + m]
            done += size
        if done == k:
            return mix(out[:n])
        power = power[: len(power) - size] * U(pow(BASE, size, 1 << 64)) + power[size:]
        size *= 2


def range_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges ``starts[i] .. ends[i]``; equal contents hash alike wherever they stand."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(BASE, len(symbols)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(symbols) + 1)[starts] + (ends - starts).astype(np.uint64))


def order_of(keys: np.ndarray) -> np.ndarray:
    """What grams are ordered by: the upper bits of their hashes, from 1, in half the memory."""
    return (keys >> U(33)).astype(np.uint32) + np.uint32(1)


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def find_anchors(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the anchors of all windows that lie within one document ``starts[i] .. ends[i]``."""
    n, g = len(symbols), w - k + 1
    if n < w:
        return np.zeros(0, np.int64)
    top = np.uint32(0xFFFFFFFF)
    h = np.full(n, top)
    grams = gram_hashes(symbols, k)
    h[: len(grams)] = order_of(grams)
    inside = np.zeros(n + 1, np.int32)
    long = ends - starts >= w
    inside[starts[long]] += 1
    inside[ends[long] - w + 1] -= 1
    within = np.cumsum(inside[:n]) > 0
    for s, e in zip(starts, ends):
        h[max(s, e - k + 1) : e] = top
    least = _sliding(h, g, np.minimum)
    least[~within[: len(least)]] = 0
    padded = np.zeros(n + g - 1, np.uint32)
    padded[g - 1 : g - 1 + len(least)] = least
    most = _sliding(padded, g, np.maximum)
    return np.flatnonzero((most == h) & (most > 0))


def owned_windows(pos: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the first and last start of the windows it is the anchor of (none: last < first).

    ``first`` and ``last`` are the bounds of its document; of equal least
    grams in a window the leftmost owns it.
    """
    g, key = w - k + 1, order_of(key)
    lo, hi = np.maximum(first, pos - g + 1), np.minimum(pos, last - w)
    near = np.arange(len(pos))  # anchors that may have another so many steps away; positions ascend, so they only get fewer
    for step in range(1, g):
        near = near[near >= step]
        near = near[pos[near - step] > pos[near] - g]
        if not len(near):
            break
        i = near[key[near - step] <= key[near]]
        lo[i] = np.maximum(lo[i], pos[i - step] + 1)
    near = np.arange(len(pos))
    for step in range(1, g):
        near = near[near < len(pos) - step]
        near = near[pos[near + step] < pos[near] + g]
        if not len(near):
            break
        i = near[key[near + step] < key[near]]
        hi[i] = np.minimum(hi[i], pos[i + step] - g)
    return lo, hi


def anchor_keys(symbols: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """The hashes of the grams at ``pos``."""
    out = np.zeros(len(pos), np.uint64)
    if len(pos):
        grams, factors = np.lib.stride_tricks.sliding_window_view(symbols, k), powers(BASE, k)[::-1].copy()
        for a in range(0, len(pos), GRAMS):
            out[a : a + GRAMS] = grams[pos[a : a + GRAMS]] @ factors
    return mix(out)


def covered(starts: np.ndarray, w: int, n: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a window that starts at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + w, n), -1)
    return np.cumsum(edge[:n]) > 0


def words_of(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and symbols of the words of a buffer; ASCII white space parts words."""
    raw = np.frombuffer(buffer, np.uint8)
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    step = np.diff(solid)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return starts, ends, range_hashes(BYTE_SYMBOLS[raw], starts, ends)
