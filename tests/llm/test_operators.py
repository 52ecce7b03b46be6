"""Every operator against brute force on a small corpus of hard cases."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import anchors, licenses, packing, phrase_dedup, quality, queries, sharding, simhash, suffix_dedup, token_orc, toxicity
from loomgraph.llm.tokens import Encoder, load_tokenizer, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, rank string, hilbert string"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(7)
    vocabulary = ["ab", "the", "of", "Été", "straße", "x,", "don't", "A.B", "zz", "　wide", "42", "###", "night", "river"]
    shared = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = [None, "", " ", "\n\n", "one", "two words", shared, shared, shared.upper(), "the " * 30, "the " * 2_600, "\x00\x00" * 60, "\x01 odd \x01", "a\tb\r\nc\x0b\x0cd  e"]
    for i in range(40):
        body = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120)))
        if i % 3 == 0:
            body = body[: len(body) // 2] + " " + shared[rng.randint(0, 30) :] + "\n" + body[len(body) // 2 :]
        texts.append(body)
    rows = [(i, t, None if i % 7 == 0 else "en", f"s{i % 3}", None, i, "x", "y") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(name, spaced):
    import pyarrow as pa

    texts = [t or "" for _, t, *_ in corpus()] + ["A.\n B,\nc", "a.. b.c! d?! e.'s x,'s", "<|endoftext|> x", "é. É!! %%a%% don't.", " lead", "q\x01"]
    path = vocabulary_path(name)
    values, totals = Encoder(path, spaced).encode(pa.array(texts, pa.string()))
    expected = [e.ids for e in load_tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    assert totals.tolist() == [len(e) for e in expected] and values.tolist() == [i for e in expected for i in e]


def check_packing(rows, texts, capacity):
    tokenizer = load_tokenizer(vocabulary_path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = tokenizer.encode(texts[doc], add_special_tokens=False).ids + [0]
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and all(p.length == capacity for p in pieces[1:])
        assert len(pieces) == -(-len(ids) // capacity)
        at = 0
        for p in pieces:
            assert p.start == at and zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.1 * total / capacity + 1


def test_packing(spark, docs, empty):
    from pyspark.sql import functions as F

    def run(table):
        pieces = packing.pack(table, vocabulary_path("byte_bpe_50k.json"), 0, 256)
        return pieces.withColumn("ids_crc32", F.crc32("ids")).collect()

    check_packing(run(docs), texts_of(docs), 256)
    assert run(empty) == []


def test_bin_plans_hold_the_histogram():
    rng = np.random.default_rng(1)
    for n in (1, 7, 60, 4_000):
        lengths = rng.integers(1, 65, n)
        histogram = np.bincount(lengths, minlength=65)
        found = np.zeros(65, int)
        plan = packing.complete_bins(histogram, 64)
        for used, times in plan:
            assert sum(used) <= 64
            np.add.at(found, used, times)
        assert (found == histogram).all()
        assert sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit_plan(histogram, 64))


def test_bin_plan_finds_the_optimum():
    from functools import lru_cache

    rng = random.Random(2)

    @lru_cache(maxsize=None)
    def fewest(items, bins):
        if not items:
            return len(bins)
        best = fewest(items[1:], tuple(sorted((*bins, 10 - items[0]))))
        for i, room in enumerate(bins):
            if room >= items[0]:
                best = min(best, fewest(items[1:], tuple(sorted((*bins[:i], room - items[0], *bins[i + 1 :])))))
        return best

    worse = 0
    for _ in range(60):
        items = tuple(sorted((rng.randint(1, 9) for _ in range(8)), reverse=True))
        plan = packing.complete_bins(np.bincount(items, minlength=11), 10)
        worse += sum(t for _, t in plan) > fewest(items, ())
    assert worse <= 3


@pytest.mark.parametrize("n", [1, 2, 7, 1_000_000])
def test_bin_plan_branches_over_fillings(n):
    histogram = np.bincount([1200, 1040, 960, 800, 650, 598, 424, 424, 48], minlength=2049) * n
    plan = packing.complete_bins(histogram, 2048)
    found = np.zeros(2049, int)
    for used, times in plan:
        assert sum(used) <= 2048
        np.add.at(found, used, times)
    assert (found == histogram).all() and sum(t for _, t in plan) == 3 * n


def test_bin_plan_is_never_above_the_optimum():
    from functools import lru_cache

    @lru_cache(maxsize=None)
    def fewest(items, bins, room):
        if not items:
            return len(bins)
        fits = {tuple(sorted((*bins[:i], b - items[0], *bins[i + 1 :]))) for i, b in enumerate(bins) if b >= items[0]}
        return min(fewest(items[1:], b, room) for b in fits | {tuple(sorted((*bins, room - items[0])))})

    rng = random.Random(4)
    for trial in range(150):
        room = rng.choice((10, 20, 37))
        items = tuple(sorted((rng.randint(1 + room // 8, room) for _ in range(rng.randint(1, 9))), reverse=True))
        histogram = np.bincount(items, minlength=room + 1)
        assert packing.lower_bound(histogram, room) <= fewest(items, (), room)
        assert sum(t for _, t in packing.complete_bins(histogram, room)) == fewest(items, (), room)
        # the search alone, without an incumbent that may be optimal already
        assert sum(t for _, t in packing.branch(histogram, room, len(items) + 1, 0, None)) == fewest(items, (), room)


def test_token_files(spark, docs, empty, tmp_path):
    tokenizer = load_tokenizer(vocabulary_path("word_bpe_49k.json"))
    for k, table in enumerate((docs, empty)):
        path = os.path.join(tmp_path, f"orc{k}")
        token_orc.write_token_orc(table, path, vocabulary_path("word_bpe_49k.json"), 2, spaced=False, files=3)
        rows = {r.doc_id: r for r in token_orc.read_token_orc(spark, path).collect()}
        start = 0
        for doc, text in sorted(texts_of(table).items()):
            ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
            assert rows[doc].start == start and rows[doc].n_tokens == len(ids) and list(rows[doc].ids) == ids
            start += len(ids)
        assert len(rows) == len(texts_of(table))
        if k == 0:
            sums = {r.doc_id: r.ids_crc32 for r in token_orc.ids_checksum(token_orc.read_token_orc(spark, path)).collect()}
            assert sums == {d: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for d, r in rows.items()}


def test_license_scan(spark, empty):
    import duckdb

    variants = [
        "Copyright (c) 2020 Someone\n\n" + licenses.KNOWN["MIT"].replace("sublicense", "sub-license"), licenses.KNOWN["ISC"].upper(), "  Released under the MIT Licence!\n", licenses.KNOWN["MIT"] + " more", None, "", "(C) 1999 X\nAll rights reserved.\n" + licenses.KNOWN["BSD-2-Clause"],
    ]
    docs = spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string")
    found = {r.doc_id: (r.digest, r.license) for r in licenses.scan(docs).collect()}
    assert [found[i][1] for i in range(7)] == ["MIT", "ISC", "MIT notice", None, None, None, "BSD-2-Clause"]
    documents = docs.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert {r[0]: (r[1], r[2]) for r in con.execute(licenses.scan_sql()).fetchall()} == found
    assert licenses.scan(empty).count() == 0
    own = spark.createDataFrame([("House", "my own terms")], "license string, text string")
    assert licenses.scan(spark.createDataFrame([(1, "My OWN, terms.")], "doc_id long, text string"), own).first().license == "House"


def test_license_scan_folds_unicode_titles_and_notices(spark):
    import duckdb

    mit, isc = licenses.KNOWN["MIT"], licenses.KNOWN["ISC"]
    curly = mit.replace('"AS IS"', "“AS\u00a0IS”").replace('"Software"', "«Software»").replace("and/or", "and／or")
    cases = [
        ("The MIT License (MIT)\n\nCopyright © 2001–2003 A. Person\n\n" + curly, "MIT"),
        ("\ufeff" + isc.replace("purpose", "pur\u00adpose", 1), "ISC"),
        ("Copyright (c) 2020 X. All rights reserved. " + mit.replace("\n", " "), "MIT"),
        ("(c) X\nISC License\n" + isc, "ISC"),
        ("BSD 3-Clause License\n\nCopyright (c) 1998, Y\n\n" + licenses.KNOWN["BSD-3-Clause"].replace("1. ", "• 1. "), "BSD-3-Clause"),
        ("The Unlicense\n" + licenses.KNOWN["Unlicense"], "Unlicense"),
        ("Copyright (c) 2020 X", None),
        ("MIT License", None),
        ("GPL\n" + mit, None),
        ("“—”\u2003", None),
    ]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, (t, _) in enumerate(cases)], "doc_id long, text string, license string, digest string")
    found = {r.doc_id: (r.digest, r.license) for r in licenses.scan(docs).collect()}
    assert [found[i][1] for i in range(len(cases))] == [name for _, name in cases]
    assert len({licenses._texts()[i][1] for i in range(len(licenses._texts()))}) == len(licenses._texts())
    documents = docs.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert {r[0]: (r[1], r[2]) for r in con.execute(licenses.scan_sql()).fetchall()} == found


def test_license_scan_uses_no_python(spark, docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_hilbert_curve_visits_every_cell_once():
    for dims, bits in ((2, 4), (3, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        order = sharding.hilbert_index(grid, bits)
        assert sorted(order) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(order)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_shards(spark, docs, empty, tmp_path):
    def run(table):
        return sharding.hilbert_shards(table.select("doc_id", "lang", "source", "hilbert", (table.doc_id * 3).alias("size")), ["lang", "source", "size"], 5, ["doc_id"])

    found = run(docs)
    rows = found.collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert run(empty).count() == 0
    path = os.path.join(tmp_path, "shards")
    sharding.write_shards(found, path)
    assert spark.read.parquet(path).count() == len(rows)


def brute_phrases(texts, window):
    seen, out = set(), {}
    for doc in sorted(texts):
        words = WORDS.findall(texts[doc].encode())
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[doc] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("window", [20, 7])
def test_phrase_dedup(spark, docs, empty, window):
    found = {r.doc_id: (r.n_words, r.n_removed, b" ".join(WORDS.findall(r.text.encode()))) for r in phrase_dedup.remove_repeats(docs, window, keep=["lang"]).collect()}
    assert found == brute_phrases(texts_of(docs), window)
    assert phrase_dedup.remove_repeats(empty, window).count() == 0


def test_phrase_dedup_keeps_untouched_texts(spark):
    rows = [(1, "a  b\nc"), (None, "a  b\nc"), (2, None)]
    found = {r.doc_id: r.text for r in phrase_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()}
    assert found == {1: "a  b\nc", None: "a  b\nc", 2: ""}


def brute_bytes(texts, length):
    seen, out = set(), {}
    for doc in sorted(texts):
        data = texts[doc].encode()
        gone = bytearray(len(data))
        own = [data[s : s + length] for s in range(len(data) - length + 1)]
        for s, w in enumerate(own):
            if w in seen:
                gone[s : s + length] = b"\x01" * length
        seen.update(own)
        out[doc] = (len(data), sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(b for b, g in zip(data, gone) if not g))
    return out


def test_suffix_dedup(docs, empty):
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, 50).collect()}
    assert found == brute_bytes(texts_of(docs), 50)
    assert suffix_dedup.remove_repeats(empty, 50).count() == 0


def brute_fingerprint(text, size):
    import xxhash

    words = WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [2_048, 1])
def test_simhash(spark, docs, empty, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    texts = texts_of(docs)
    prints = {d: brute_fingerprint(t, 3) for d, t in texts.items()}
    label = {d: d for d in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            best = min(label[b] for b in texts if (prints[a] ^ prints[b]).bit_count() <= 3)
            changed |= best < label[a]
            label[a] = min(label[a], best)
    found = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp % 2**64 for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == label
    if bucket > 1:
        assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius, parts, bucket", [(3, (2, 3, 4), 2_048), (3, (2,), 2), (11, (6,), 2_048), (11, (6,), 3)])
def test_simhash_links_miss_nothing(spark, radius, parts, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for s in seeds for _ in range(8)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p, p, 0) for p in signed], "node long, fp long, check long")
    from loomgraph.operators.components import component_labels

    found = {r.id: r.component for r in component_labels(simhash.links(table, radius, parts=parts)).collect()}
    for p in signed:
        group, todo = {p}, [p]
        while todo:
            x = todo.pop()
            new = {q for q in signed if q not in group and ((x ^ q) & (2**64 - 1)).bit_count() <= radius}
            group |= new
            todo += new
        assert found.get(p, p) == min(group)


def test_thresholds_cover_the_radius():
    rng = np.random.default_rng(3)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    for radius in (1, 3, 7, 11):
        for n in (100, 10**6, 10**10):
            both = bits.T @ bits * (n / 500)
            plan = simhash.plan_probes(n, both, radius, (2, 4, 6))
            assert sum(t + 1 for _, t in plan) == radius + 1 and len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)


def brute_counts(text):
    words = [w.decode() for w in WORDS.findall(text.encode())]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line.encode()):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts(docs, empty):
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.document_counts(docs).collect()}
    assert found == {d: brute_counts(t) for d, t in texts_of(docs).items()}
    counts = quality.document_counts(empty)
    assert counts.count() == 0 and quality.with_verdict(counts, None).count() == 0


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(5)
    x = rng.random((3_000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.2)).astype(float)
    trees = quality.boost(x, y, np.array([-1, 0, 0]))
    assert ((trees.score(x) > 0.5) == (y == 1)).mean() > 0.97
    base = rng.random((200, 3))
    grid = np.stack([np.concatenate([np.full((200, 1), v), base[:, 1:]], axis=1) for v in np.linspace(0, 1, 30)])
    scores = np.stack([trees.score(g) for g in grid])
    assert (np.diff(scores, axis=0) <= 1e-12).all()


def test_quality_and_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op10_quality_trees(spark, sf).collect() if r.doc_id in labels]
    good = [r.kept for r in rows if labels[r.doc_id].quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if labels[r.doc_id].quality == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.2
    rows = [r for r in queries.op3_toxicity(spark, sf).collect() if r.doc_id in labels and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    clean = [r.predicted for r in rows if labels[r.doc_id].toxic == 0]
    toxic = [r.predicted for r in rows if labels[r.doc_id].toxic == 1]
    assert sum(clean) / len(clean) < 0.03 and sum(toxic) / len(toxic) > 0.6


def test_toxicity_edges(spark, docs, empty):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert {r[0] for r in docs.select(F.round(toxicity.score(F.col("text"), model), 6)).collect()} == {0.0}
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(54)], "doc_id long, toxic int")
    scored = docs.select(toxicity.score(F.col("text"), toxicity.train(docs, labels)).alias("s")).collect()
    assert len(scored) == 54 and all(0 <= r.s <= 1 for r in scored)
    assert toxicity.train(empty, labels).bias == -60.0


def test_anchors_of_equal_windows_agree():
    rng = np.random.default_rng(0)
    for trial in range(80):
        k, w = [(4, 20), (16, 50), (3, 7), (1, 5)][trial % 4]
        n = int(rng.integers(0, 300))
        raw = rng.integers(0, 2 if trial % 3 else 200, n).astype(np.uint8)
        cuts = np.sort(rng.integers(0, n + 1, 3))
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
        symbols = anchors.BYTE_SYMBOLS[raw]
        pos = anchors.find_anchors(symbols, starts, ends, k, w)
        doc = np.searchsorted(starts, pos, side="right") - 1
        lo, hi = anchors.owned_windows(pos, anchors.anchor_keys(symbols, pos, k), starts[doc], ends[doc], k, w)
        owner = {i: int(p) for p, a, b in zip(pos, lo, hi) for i in range(a, b + 1)}
        assert sorted(owner) == [i for s, e in zip(starts, ends) for i in range(s, e - w + 1)] and sum(np.maximum(hi - lo + 1, 0)) == len(owner)
        place = {}
        for i, p in owner.items():
            assert place.setdefault(raw[i : i + w].tobytes(), p - i) == p - i
