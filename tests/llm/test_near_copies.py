"""Near copies against the exact similarity of their shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from loomgraph.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def near_pairs(n):
    """Pairs of texts with a tail appended, a block replaced or words scattered over them."""
    rng = random.Random(5)
    say = lambda k: [f"w{rng.randrange(50_000)}" for _ in range(k)]
    for i in range(n):
        size = (60, 300, 1_000)[i % 3]
        a = say(size)
        if i // 3 % 3 == 0:
            b = a + say(int(size * rng.uniform(0.1, 0.3)))
        elif i // 3 % 3 == 1:
            k = max(1, int(size * rng.uniform(0.03, 0.16)))
            at = rng.randrange(size - k)
            b = a[:at] + say(k) + a[at + k :]
        else:
            b = [w if rng.random() > 0.03 else "x" for w in a]
        yield " ".join(a), " ".join(b)


@pytest.mark.parametrize("size", [60, 300])
def test_band_keys_miss_as_stated(size):
    rng = np.random.default_rng(size)
    shared, own = round(size * 8 / 10), round(size / 10)
    missed = 0
    for _ in range(1_500):
        s = rng.integers(0, 1 << 64, shared + 2 * own, np.uint64)
        a, b = near_copies.minima(s[: shared + own]), near_copies.minima(np.concatenate([s[:shared], s[shared + own :]]))
        missed += not (near_copies.band_keys(a) == near_copies.band_keys(b)).any()
    assert missed <= 3  # 0.2 expected at a similarity of 0.8


@pytest.mark.parametrize("size", [60, 300])
@pytest.mark.parametrize("n", [10_000, 1 << 21, 1 << 24])
def test_fingerprints_miss_as_stated(size, n):
    words, groups, most = near_copies.sketch_plan(n, 0.8)
    rng = np.random.default_rng(size)
    both = np.full((64, 64), n / 4) + np.eye(64) * n / 4
    plan = simhash.plan_probes(n, both, groups - 1, (groups,))
    assert sum(t + 1 for _, t in plan) == groups
    shared, own = round(size * 8 / 10), round(size / 10)
    missed = 0
    for _ in range(700):
        s = rng.integers(0, 1 << 64, shared + 2 * own, np.uint64)
        a, b = near_copies.sketch(s[: shared + own], words), near_copies.sketch(np.concatenate([s[:shared], s[shared + own :]]), words)
        apart = simhash.bit_matrix(a ^ b)
        meet = any(apart[k, bits].sum() <= t for k in range(words) for bits, t in plan)
        missed += not (meet and apart[: near_copies.CHECKED].sum() <= most)
    assert missed <= 2  # 0.07 expected at most


def test_stage_gets_candidates_from_simhash(spark, monkeypatch):
    pairs = [p for p in near_pairs(60) if 0.8 <= jaccard(*p) < 0.9]
    rows = [(2 * i + k, t, "en", "s", None) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plans, plan_probes = [], simhash.plan_probes

    def planned(n, both, radius, choices):
        plans.append((radius, plan_probes(n, both, radius, choices)))
        return plans[-1][1]

    monkeypatch.setattr(simhash, "plan_probes", planned)
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == len(pairs) > 10
    assert plans and all(sum(t + 1 for _, t in plan) == radius + 1 for radius, plan in plans)
    # where only equal words of a fingerprint meet, these pairs stay
    monkeypatch.setattr(simhash, "plan_probes", lambda *a: [(list(range(64)), 0)])
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == len(rows)


@pytest.mark.parametrize("square", [512, 0])
def test_buckets_link_what_is_near(square, monkeypatch):
    monkeypatch.setattr(near_copies, "SQUARE", square)
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 64, (6, 6), np.uint64)
    prints = np.concatenate([seeds[rng.integers(0, 6, 60)] ^ (np.uint64(1) << rng.integers(0, 64, (60, 6), np.uint64)) for _ in range(2)])
    for most in (0, 7, 10):
        near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= most
        labels = []
        for edges in (np.argwhere(near).tolist(), near_copies.bucket_forest(prints, most)):
            label = np.arange(len(prints))
            for _ in prints:
                for i, k in edges:
                    label[[i, k]] = min(label[i], label[k])
            labels.append(label.tolist())
        assert labels[0] == labels[1]
    assert len(near_copies.bucket_forest(prints, 12)) == len(prints) - 6 and near_copies.bucket_forest(prints[:0], 9) == []


def test_stage_decides_by_exact_similarity(spark):
    pairs = list(near_pairs(450))
    rows = [(2 * i + k, t, "en", "s", None) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    near = [jaccard(a, b) >= 0.8 for a, b in pairs]
    assert 150 < sum(near) < 400
    assert kept == {2 * i for i in range(len(pairs))} | {2 * i + 1 for i, n in enumerate(near) if not n}


@pytest.mark.parametrize("members", [512, 3])
def test_groups_are_the_closure_of_verified_links(spark, members):
    rng = random.Random(9)
    texts = [None, "", " ", "One", "one", "two words", "Two  words"]
    for _ in range(3):
        text = [f"w{rng.randrange(9_000)}" for _ in range(120)]
        for _ in range(14):
            texts.append(" ".join(text))
            at = rng.randrange(100)
            text = text[:at] + [f"v{rng.randrange(9_000)}" for _ in range(rng.choice((2, 5, 9)))] + text[at + 5 :]
    docs = spark.createDataFrame([(i if i != 1 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [near_copies.shingle_set((t or "").encode(), 5) for t in texts]
    same = lambda a, b: (not len(a) and not len(b)) or len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[j] for j in range(len(texts)) if same(sets[i], sets[j])) for i in range(len(texts))]
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, members=members).collect()}
    assert found == {i if i != 1 else None: c for i, c in enumerate(label)}
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_repeated_and_null_ids_lose_no_text(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(3, a), (7, a), (7, b), (None, a + " tail"), (None, "alone"), (None, "alone"), (9, None), (None, "")]
    docs = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=str)
    assert kept == sorted([(3, a), (7, b), (None, "alone"), (None, "alone"), (9, None)], key=str)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0
