"""The pipeline's stages against plain Python, each on what its predecessor kept."""

import corpus_pipeline as p


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = {r.doc_id: r for r in docs.collect()}
    bench = [set(zip(*[iter_words(r.text)[k:] for k in range(15)])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert set(kept[name]) <= set(first)
    assert set(kept["line dedup"]) == set(kept["quality rules"])
    sets = {i: grams(t) for i, t in kept["near duplicates"].items()}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            assert not both or both * 100 < 80 * len(sets[a] | sets[b])
    lost = set(kept["line dedup"]) - set(kept["near duplicates"])
    for i in lost:
        assert kept["line dedup"][i]
    for i, t in kept["near duplicates"].items():
        words = iter_words(t or "")
        leak = any(b & set(zip(*[words[k:] for k in range(15)])) for b in bench)
        assert not leak or i not in kept["decontamination"]
    packed = p.pack(spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(kept["decontamination"])


def iter_words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).lower().split()


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_run(spark, sf):
    assert p.run(spark, sf).count() > 0
