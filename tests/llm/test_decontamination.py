"""Spaced seeds: masks by enumeration, planted passages, and brute force over all places."""

import random
from itertools import combinations

import numpy as np
import pytest

from loomgraph.llm import decontamination as dec

SCHEMA = "doc_id long, text string, item_id string"


def words(text):
    return dec.WORD.findall((text or "").lower())


def brute(docs, items, window=13, similarity=0.8, least=5):
    """Pairs of places in the lists that hold a passage which counts, with the most equal words in counting stretches of one shift."""
    found = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            own, around = words(item), words(text)
            if not own or len(own) < least and len(own) != len(around):
                continue
            size = min(window, len(own))
            for shift in range(-len(own) + 1, len(around)):
                lo, hi = max(0, -shift), min(len(own), len(around) - shift)
                same = {k for k in range(lo, hi) if own[k] == around[k + shift]}
                stretches = [set(range(k, k + size)) for k in range(lo, hi - size + 1)]
                good = [s for s in stretches if len(s & same) >= similarity * size]
                if good:
                    found[d, i] = max(found.get((d, i), 0), len(set.union(*good) & same))
    return found


@pytest.mark.parametrize("similarity", [0.8, 0.7, 0.95])
def test_masks_hit_every_passage_that_counts(similarity):
    for n in range(1, 18):
        masks, stretch = dec.masks_for(n, 13, similarity), min(n, 13)
        changed = max(k for k in range(stretch) if stretch - k >= similarity * stretch)
        for gone in combinations(range(stretch), changed):
            places = ((m, at) for m in masks for at in range(stretch - len(m) + 1))
            assert any(all(m[j] == "0" or at + j not in gone for j in range(len(m))) for m, at in places), (n, gone)


def test_hashes_of_masks():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(30)]
    table = dec.Texts([None, *texts])
    for mask, whole in (("1", False), ("1011", False), ("111", True)):
        doc, at, h = dec.masked_hashes(table, mask, whole)
        seen = {}
        for d, p, x in zip(doc, at, h):
            split = texts[d - 1].split()
            own = split[p - table.first[d] :][: len(mask)]
            assert len(own) == len(mask) and (not whole or len(split) == len(mask))
            assert seen.setdefault(tuple(w for w, c in zip(own, mask) if c == "1"), x) == x
        assert len(set(seen.values())) == len(seen)
        assert len(at) == sum(len(t.split()) == len(mask) if whole else max(0, len(t.split()) - len(mask) + 1) for t in texts)


def test_planted_passages(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (15, 30, 50, 5)]
    swapped = items[1].split()
    swapped[4], swapped[17] = "other", "words"
    texts = [f"before {items[0].upper()} after", "x " + " ".join(swapped), " ".join(rng.choice(vocabulary) for _ in range(300)), items[2][: len(items[2]) // 2], None, "", f"{items[3]}", items[2] + " " + items[0], "the cat sat on the mat", "The"]
    table = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], SCHEMA)
    benchmark = spark.createDataFrame([*enumerate(items), (9, None), (None, ""), (10, "The"), (11, "cat sat")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.n_equal, r.n_words, r.word_start) for r in dec.contaminated(table, benchmark).collect()}
    assert set(found) == {(0, 0), (1, 1), (3, 2), (6, 3), (7, 0), (7, 2), (9, 10)} and found[1, 1] == (28, 30, 1) and found[7, 0] == (15, 15, 50)
    kept = dec.decontaminate(table, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 8] and kept.columns == table.columns
    none = spark.createDataFrame([], SCHEMA)
    assert dec.contaminated(none, benchmark).count() == 0
    assert dec.contaminated(table, benchmark.limit(0)).count() == 0 and dec.decontaminate(table, benchmark.limit(0)).count() == len(texts)


@pytest.mark.parametrize("broadcast, bits", [(True, 24), (False, 10)])
def test_passages_equal_brute_force(spark, broadcast, bits, monkeypatch):
    monkeypatch.setattr(dec, "BITMAP_BITS", bits)
    if not broadcast:
        monkeypatch.setattr(dec, "BROADCAST_SEEDS", 0)
        monkeypatch.setattr(dec, "BROADCAST_WORDS", 0)
    rng = random.Random(7)
    vocabulary = ["the", "of", "Été", "x", "straße", "a", *(f"w{i}" for i in range(20))]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [" ".join(say(n)) for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 20, 40)]
    docs = [None, "", " ", "the", "the of"]
    for k in range(70):
        text = say(rng.randint(0, 40))
        own = items[k % len(items)].split()
        own = [w if rng.random() > 0.12 else "other" for w in own]
        cut = rng.choice([0, 0, 3])
        docs.append(" ".join(text + own[cut:] + say(rng.randint(0, 10))) if k % 4 else " ".join(own))
    ids = [k if k % 9 else (None if k % 2 else 5) for k in range(len(docs))]  # null and repeated ids
    keys = [i if i % 6 else (None if i % 4 else 7) for i in range(len(items))]
    table = spark.createDataFrame([(d, t, "i") for d, t in zip(ids, docs)], SCHEMA)
    benchmark = spark.createDataFrame(list(zip(keys, items)), "item_id long, text string")
    expected = brute(docs, items)
    assert len(expected) > 30
    found = sorted(((r.doc_id, r.item_id, r.n_equal) for r in dec.contaminated(table, benchmark).collect()), key=str)
    once = {(ids[d], docs[d], i): (ids[d], keys[i], n) for (d, i), n in expected.items()}
    assert found == sorted(once.values(), key=str)
    gone = {d for d, _ in expected}
    kept = sorted(((r.doc_id, r.text) for r in dec.decontaminate(table, benchmark).collect()), key=str)
    assert kept == sorted(((i, t) for k, (i, t) in enumerate(zip(ids, docs)) if k not in gone), key=str)


def test_very_long_texts_and_ties(spark):
    rng = random.Random(3)
    item = " ".join(f"i{rng.randrange(500)}" for _ in range(30))
    long = " ".join(f"w{rng.randrange(5_000)}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long} {item}"), (2, long)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = dec.contaminated(docs, benchmark).collect()
    assert [(r.doc_id, r.word_start, r.n_words, r.n_equal) for r in found] == [(1, 200_000, 30, 30)]  # of equal places the first
    assert np.array_equal([r.doc_id for r in dec.decontaminate(docs, benchmark).collect()], [2])
