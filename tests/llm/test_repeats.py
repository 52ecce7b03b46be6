"""Repeated passages and strings: the rounds without Spark, under small limits, against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import phrase_dedup, repeats, suffix_dedup
from loomgraph.llm.anchors import covered, find_anchors
from loomgraph.llm.blocks import NO_ID, Block, _pack

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts_with_repeats(seed, n=60):
    """Pairs (id, text); ids repeat and may be missing."""
    rng = random.Random(seed)
    vocabulary = ["ab", "the", "of", "Été", "straße", "x,", "don't", "A.B", "zz", "　wide", "42", "###", "\x00", "\x01q"]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [say(70) for _ in range(3)]
    out = [(0, ""), (1, " "), (2, "one"), (3, "the " * 300), (4, "the " * 300), (5, "\x00" * 400), (6, "\x00" * 130)]
    for i in range(7, n):
        body = say(rng.randint(1, 90)).replace(" ", rng.choice([" ", "  ", "\n"]))
        if i % 3 == 0:
            cut = rng.randint(0, 200)
            body = body[: len(body) // 2] + " " + rng.choice(shared)[cut:] + "\t" + body[len(body) // 2 :]
        if i % 11 == 0:
            body = out[-1][1]
        out.append((i, body))
    out[20], out[33] = (12, out[20][1]), (12, out[33][1])
    out[25], out[40] = (NO_ID, out[25][1]), (NO_ID, out[40][1])
    return sorted(out, key=lambda r: hashlib.md5(repr(r).encode()).hexdigest())


def blocks_of(texts, windows, size):
    out = []
    for k in range(0, len(texts), size):
        group = texts[k : k + size]
        table = pa.table({"doc_id": pa.array([d for d, _ in group], pa.int64()), "text": pa.array([t.encode() for _, t in group], pa.large_binary()), "extra": pa.nulls(len(group), pa.binary())})

        def anchors(block):
            c = windows.read(block)
            return find_anchors(c.symbols, c.first, c.last, windows.gram, windows.length)

        out.append(Block(_pack(table, anchors)))
    return out


def exchange(parts, question, answer, given, shards):
    asked = [question(b, g, shards) for b, g in zip(parts, given)]
    out = [{} for _ in parts]
    for s in range(shards):
        who = [i for i, a in enumerate(asked) if s in a]
        for i, data in zip(who, answer([asked[i][s] for i in who]) if who else []):
            out[i][s] = data
    return out


def rounds(texts, windows, judge, words, block=9, shards=3):
    """(symbols, removed starts) of each block."""
    parts = blocks_of(texts, windows, block)
    hot = exchange(parts, lambda b, g, n: repeats.ask_anchors(windows, b, n), repeats.answer_anchors, [[]] * len(parts), shards)
    seen = exchange(parts, lambda b, g, n: repeats.ask_snippets(windows, b, g, n), lambda e: repeats.answer_snippets(windows, e, judge, words), [[a] for a in hot], shards)
    return [(b, *repeats.repeated_windows(windows, b, [one, two], shards)) for b, one, two in zip(parts, hot, seen)]


def phrases_removed(texts, length, judge=None, **limits):
    windows = phrase_dedup.windows_of(length)
    judge = judge or (lambda t, s, c, k, copied: phrase_dedup.locate(t, s, c, k, copied, length))
    out = []
    for block, content, gone in rounds(texts, windows, judge, True, **limits):
        mask = covered(gone, length, len(content.symbols))
        out += [mask[a:b].tolist() for a, b in zip(content.first, content.last)]
    return out


def bytes_removed(texts, length, judge=None, most=suffix_dedup.ARRAY_BYTES, **limits):
    windows = suffix_dedup.windows_of(length)
    judge = judge or (lambda t, s, c, k, copied: suffix_dedup.shard_groups(t, s, c, k, length, most))
    out = []
    for block, content, gone in rounds(texts, windows, judge, False, **limits):
        mask = covered(gone, length, len(block.buffer))
        out += [mask[a:b].tolist() for a, b in zip(block.starts, block.ends)]
    return out


def in_order(texts):
    """Places in order of id; of equal ids the one read first."""
    return sorted(range(len(texts)), key=lambda i: (texts[i][0], i))


def brute_phrases(texts, length):
    seen, out = set(), [[] for _ in texts]
    for i in in_order(texts):
        words = WORD.findall(texts[i][1].encode())
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            key = tuple(words[s : s + length])
            if key in seen:
                gone[s : s + length] = [True] * length
            seen.add(key)
        out[i] = gone
    return out


def brute_bytes(texts, length):
    least, out = {}, []
    own = [[t.encode()[s : s + length] for s in range(len(t.encode()) - length + 1)] for _, t in texts]
    for (d, _), ws in zip(texts, own):
        for w in ws:
            least[w] = min(d, least.get(w, d))
    for (d, t), ws in zip(texts, own):
        gone = [False] * len(t.encode())
        for s, w in enumerate(ws):
            if least[w] < d:
                gone[s : s + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("frequent", [2_000, 2])
@pytest.mark.parametrize("length", [1, 3, 7, 20, 45])
def test_phrases(length, frequent, monkeypatch):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    texts = texts_with_repeats(length)
    assert phrases_removed(texts, length) == brute_phrases(texts, length)


@pytest.mark.parametrize("phrases, alphabet, collide", [(3, 1_000_000, False), (50_000, 10, False), (2, 10, True)])
def test_phrases_under_small_limits(phrases, alphabet, collide, monkeypatch):
    monkeypatch.setattr(phrase_dedup, "PHRASES", phrases)
    monkeypatch.setattr(phrase_dedup, "ALPHABET", alphabet)
    if collide:  # many windows share their hash
        grams = phrase_dedup.gram_hashes
        monkeypatch.setattr(phrase_dedup, "gram_hashes", lambda s, k: grams(s, k) % np.uint64(5))
    texts = texts_with_repeats(3, 45)
    assert phrases_removed(texts, 6) == brute_phrases(texts, 6)


def test_phrases_need_the_automata():
    texts = texts_with_repeats(5)
    none = lambda t, s, counts, k, copied: np.full(int(counts.sum()), -1)
    assert any(map(any, phrases_removed(texts, 20)))
    assert not any(map(any, phrases_removed(texts, 20, none)))


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_with_equal_polynomial_hashes_differ():
    word = thue_morse(1_024)
    other = word.translate(str.maketrans("ab", "ba"))
    common = [f"w{i}" for i in range(25)]
    texts = [(i, " ".join([*common[:12], w, *common[13:]])) for i, w in enumerate((word, other, word))]
    assert phrases_removed(texts, 20) == [[False] * 25, [False] * 25, [True] * 25]
    texts = [(0, word), (1, other)]
    assert bytes_removed(texts, 1_024) == brute_bytes(texts, 1_024) == [[False] * 1_024, [False] * 1_024]


@pytest.mark.parametrize("frequent, most", [(2_000, 1 << 20), (2, 1 << 20), (2_000, 500), (2, 70)])
@pytest.mark.parametrize("length", [1, 7, 50, 120, 300])
def test_strings(length, frequent, most, monkeypatch):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    texts = texts_with_repeats(length)
    assert bytes_removed(texts, length, most=most) == brute_bytes(texts, length)


def test_strings_need_the_suffix_arrays():
    texts = texts_with_repeats(5)
    none = lambda t, s, counts, k, copied: np.full(int(counts.sum()), -1)
    assert any(map(any, bytes_removed(texts, 50)))
    assert not any(map(any, bytes_removed(texts, 50, none)))


def test_short_strings_are_compared_without_common_prefixes(monkeypatch):
    texts = texts_with_repeats(10)
    with monkeypatch.context() as m:
        m.setattr(suffix_dedup, "common_prefixes", None)
        m.setattr(suffix_dedup, "CHUNK", 200)
        assert bytes_removed(texts, 50, most=300) == brute_bytes(texts, 50)
    monkeypatch.setattr(suffix_dedup, "COMPARED", 0)
    monkeypatch.setattr(suffix_dedup, "same_as_before", None)
    assert bytes_removed(texts, 50, most=300) == brute_bytes(texts, 50)


@pytest.mark.parametrize("depth", [3, 12, 50])
def test_wanted_suffixes_are_in_order(depth):
    rng = np.random.default_rng(1)
    for trial in range(60):
        n = int(rng.integers(1, 200))
        text = rng.integers(0, [1, 2, 250][trial % 3] + 1, n).astype(np.uint8)
        wanted = rng.random(n) < 0.4
        data, order = text.tobytes(), suffix_dedup.suffix_array(text, depth, wanted)
        assert sorted(order) == list(range(n))
        found = [data[i:][:depth] for i in order if wanted[i]]
        assert found == sorted(found)


def test_equal_hashes_of_other_snippets(monkeypatch):
    """Snippets meet by hashes and become one by their bytes."""
    hashes = repeats.range_hashes
    monkeypatch.setattr(repeats, "range_hashes", lambda symbols, a, b: hashes(symbols, a, b) % np.uint64(3) << np.uint64(33))
    texts = texts_with_repeats(8, 45)
    assert bytes_removed(texts, 50) == brute_bytes(texts, 50)
    assert phrases_removed(texts, 20) == brute_phrases(texts, 20)


@pytest.mark.parametrize("depth", [None, 1, 12, 50])
def test_suffix_arrays_and_common_prefixes(depth):
    rng = np.random.default_rng(0)
    for trial in range(120):
        n = int(rng.integers(1, 100))
        text = rng.integers(0, [1, 2, 3, 250][trial % 4] + 1, n).astype(np.uint8) if trial % 7 else np.zeros(n, np.uint8)
        data = text.tobytes()
        order = suffix_dedup.suffix_array(text, depth)
        assert sorted(order) == list(range(n))
        assert [data[i:][:depth] for i in order] == sorted(data[i:][:depth] for i in range(n))
        if depth is None:
            assert order.tolist() == sorted(range(n), key=lambda i: data[i:])
        starts = np.unique(np.concatenate([[0], rng.integers(0, n, 4)]))
        most = depth or 10
        found = suffix_dedup.common_prefixes(text, order, starts, np.diff(np.append(starts, n)), most)
        for a, c in zip(order, order[1:]):
            assert found[c] == next(k for k in range(most + 1) if k == most or max(a, c) + k >= n or data[a + k] != data[c + k])


def test_operators_on_repeated_and_missing_ids(spark):
    texts = texts_with_repeats(9)
    rows = [(None if d == NO_ID else d, t, "x") for d, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string").coalesce(1)
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    expected = [(d if d != NO_ID else None, len(g), sum(g)) for (d, _), g in zip(texts, brute_phrases(texts, 20))]
    found = [(r.doc_id, r.n_words, r.n_removed) for r in phrase_dedup.remove_repeats(docs, 20).collect()]
    assert sorted(found, key=order) == sorted(expected, key=order)
    expected = [(d if d != NO_ID else None, len(g), sum(g)) for (d, _), g in zip(texts, brute_bytes(texts, 50))]
    found = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs, 50).collect()]
    assert sorted(found, key=order) == sorted(expected, key=order)
    assert not spark.catalog.listTables()


def test_a_very_long_text(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(60_000)}" for _ in range(400_000))  # over a block
    docs = spark.createDataFrame([(1, long), (2, long[1_000_000:1_500_000]), (3, "short")], "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs, 50).collect()}
    assert found == {1: (len(long), 0), 2: (500_000, 500_000), 3: (5, 0)}
    found = {r.doc_id: r.n_words - r.n_removed for r in phrase_dedup.remove_repeats(docs, 20).collect()}
    assert found[1] == 400_000 and found[2] <= 2 and found[3] == 1  # the words cut at either end
