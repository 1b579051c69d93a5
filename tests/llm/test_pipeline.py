import zlib

import numpy as np

import corpus_pipeline as P
from siltstone.llm import simhash, tokens

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        docs = stage(spark, docs, SF).persist()
        rows = docs.collect()
        seen[name] = (before, rows)
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS
    before, rows = seen["quality_classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows}
    assert np.mean([(i in kept) == q for i, q in labels.items()]) > 0.95 and all(before[r.doc_id] == r.text for r in rows)
    before, rows = seen["exact_dedup"]
    first = {}
    for i, t in before.items():
        key = " ".join((t or "").replace("\xa0", "\0").split(" "))
        key = __import__("re").sub("[ \t-\r]+", " ", t or "")
        first[key] = min(first.get(key, i), i)
    assert {r.doc_id for r in rows} == set(first.values())
    before, rows = seen["simhash_near_dedup"]
    shingles = {}
    for i, t in before.items():
        w = (t or "").encode().translate(simhash.LOWER).split()
        shingles[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    kept = {r.doc_id for r in rows}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    assert all(max(alike(i, j) for j in before if j != i) >= 0.8 for i in before.keys() - kept)
    assert not [1 for i in kept for j in kept if j < i and alike(i, j) >= 0.8]
    before, rows = seen["suffix_array_dedup"]
    first = {}
    for i in sorted(before):
        b = (before[i] or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for r in rows:
        b = (before[r.doc_id] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < r.doc_id:
                gone[p : p + 50] = b"\1" * 50
        assert r.text == bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore") and r.n_chars == len(r.text)
    before, rows = seen["best_fit_packing"]
    lib = tokens.load(tokens.WordBpe, tokens.default_path("word_bpe_49k.json")).tok
    want = set()
    for i, t in before.items():
        raw = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, a, len(raw[a : a + 2048]), zlib.crc32(raw[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(raw), 2048))}
    assert {tuple(r)[:5] for r in rows} == want


def test_run_and_empty_input(spark):
    assert P.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
