"""The corpus pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline
from loomgraph.llm.tokens import load_tokenizer, vocabulary_path


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [a + b + c for a in "bdklm" for b in "aeiou" for c in ("n", "r", "st", "l")]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, item = say(60), say(30)
    rows, labels = [], []
    for i in range(120):
        text = say(150)
        if i % 4 == 0:
            text += " vileword awfulword " + say(20)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    words = rows[1][1].split()
    words[70] = "changed"
    extra = [rows[1][1], " ".join(words), say(40) + " " + passage + " " + say(40), say(40) + " " + passage + " " + say(40), say(80) + " " + item + " " + say(80), None, ""]
    rows += [(200 + i, t, None, "s", None) for i, t in enumerate(extra)]
    sf = str(tmp_path)
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()} if k < 4 else docs.collect()
    clean = {i for i in range(120) if i % 4}
    assert set(kept["toxicity"]) == clean | set(range(200, 207))
    assert set(kept["near_duplicates"]) == clean | {202, 203, 204, 205}  # 205 and 206 are both without words
    texts = {d: r.text for d, r in kept["substring_dedup"].items()}
    assert passage in texts[202] and passage not in texts[203] and len(texts[203].split()) == 80 and texts[1] == rows[1][1]
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - {204}
    tokenizer = load_tokenizer(vocabulary_path("byte_bpe_50k.json"))
    total = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in kept["decontamination"].values())
    assert sum(r.length for r in kept["packing"]) == total
