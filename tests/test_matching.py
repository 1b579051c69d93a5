"""Matching of whole vocabularies against a plain search of every sentence."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import matching as V
from siltstone.operators import matrix as M


def brute(papers, terms):
    out = []
    for paper, text in papers:
        sents = re.split(r"(?<=[.!?])\s+", text or "")
        for t in {t for t in terms if t}:
            found = [s for s in sents if t in s.lower()]
            if text and found:
                out.append((paper, t, " | ".join(found)))
    return sorted(out, key=str)


def found(spark, papers, terms):
    p = spark.createDataFrame(papers, "paper string, text string").withColumn("concept", F.lit("x")).withColumn("_s", F.lit(1)).repartition(4)
    return sorted((tuple(r) for r in V.match_vocabulary(p, spark.createDataFrame([(t,) for t in terms], "concept string").withColumn("n", F.lit(1))).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    """Terms of every length, those inside each other, marks, letters of several bytes, capitals that match nothing."""
    r = random.Random(seed)
    piece = lambda n: "".join(r.choice("abcAB é漢. !-") for _ in range(n))
    papers = [(f"p{i % 70}", piece(r.randrange(60))) for i in range(90)]
    terms = [piece(r.choice([1, 1, 2, 2, 3, 3, 4, 5, 7])).lower() for _ in range(160)] + ["Ab", "A", "abc", "abc"]
    assert found(spark, papers, terms) == brute(papers, terms)


def test_odd_rows(spark):
    papers = [("a", None), ("b", ""), ("c", " "), (None, "Thin films. Thin films again! No."), ("d", "Thin films."), ("d", "Thin films."), ("e", "x" * 300_000 + " thin " + "films " * 50_000), ("f", "\n\n")]
    terms = [None, "", "thin", "films again", "zz", " ", "\n", "x" * 1000, "thin films"]
    assert found(spark, papers, terms) == brute(papers, terms)
    assert found(spark, [], ["a"]) == found(spark, papers, []) == []


def test_as_the_automaton(spark):
    """The same rows as one task with all terms gives, over the documents, for a few hundred words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("paper"), "text")
    words = [r.w for r in docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) > 3").groupBy("w").count().orderBy("count", "w").limit(300).collect()]
    got = V.match_vocabulary(docs, spark.createDataFrame([(w,) for w in words], "concept string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.match_tall(docs, words).select("paper", "concept", "sentences").collect()))


def test_anchors_of_many_sentences_at_once():
    """Each sentence's own grams and no others, whatever the parts; a gram does not reach into the next sentence."""
    import pyarrow as pa

    sents = pa.array(["ab", "", "abcd abcd", "\u00e9x", "cdab", "x" * 50, ""])
    everything = np.full(V.BITS // 8, 255, np.uint8)
    for most in (1, 8, 1 << 20):
        got = []
        for part, low, high in V._parts(sents, most):
            keys, at = V._anchored(part, everything, [1, 2, 4])
            assert high - low == len(part)
            got += [(low + a, k) for a, k in zip(at.tolist(), keys.tolist())]
        want = {(i, int(k)) for i, s in enumerate(sents.to_pylist()) for size in (1, 2, 4) for k in V.grams(s.encode(), size)}
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("bound", ["MOST", "MOST_BYTES"])
def test_vocabularies_beyond_the_bound_give_the_same(spark, monkeypatch, bound):
    r = random.Random(3)
    piece = lambda n: "".join(r.choice("abcAB \u00e9\u6f22. !-") for _ in range(n))
    papers = [(f"p{i % 30}", piece(r.randrange(60))) for i in range(40)] + [(None, "a. a. b"), ("n", None)]
    terms = [piece(r.choice([1, 2, 3, 4, 6])).lower() for _ in range(60)] + ["a", None, ""]
    monkeypatch.setattr(V, bound, 1)
    assert found(spark, papers, terms) == brute(papers, terms)


def test_small_vocabularies_shuffle_and_stage_no_text(spark):
    """What all tasks may hold is found where the texts are."""
    papers = spark.createDataFrame([("a", "Thin films. No. Thin!"), ("b", "none")], "paper string, text string")
    got = V.match_vocabulary(papers, spark.createDataFrame([("thin",), ("films.",)], "concept string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted(map(tuple, got.collect())) == [("a", "films.", "Thin films."), ("a", "thin", "Thin films. | Thin!")]


@pytest.mark.parametrize("seed", range(4))
def test_index_of_any_anchors(seed, monkeypatch):
    """Whichever gram a term is filed under, long terms and outputs of few bytes."""
    import pyarrow as pa

    r = random.Random(seed)
    piece = lambda n: "".join(r.choice("abc \u00e9\u6f22. !-") for _ in range(n))
    terms = sorted({piece(r.choice([1, 1, 2, 3, 4, 5, 9])) for _ in range(80)} | {"abc" * 30, "a" * 70})
    index = V._Index(terms, [int(r.choice(V.grams(t.encode(), min(V.SIZE, len(t.encode()))).tolist())) for t in terms])
    texts = [[piece(r.randrange(40)) for _ in range(r.randrange(4))] for _ in range(20)] + [["abc" * 40, "a" * 90, ""]]
    monkeypatch.setattr(V, "OUTPUT", [10, 1 << 22][seed % 2])
    whole = pa.array([["x"], *texts], pa.list_(pa.string())).slice(1)
    got = sorted(x for b in V._rows_in_place(pa.array(range(len(texts))), whole, whole, index) for x in zip(*[c.to_pylist() for c in b.columns]))
    assert got == sorted((i, t, " | ".join(f)) for i, sents in enumerate(texts) for t in terms if (f := [s for s in sents if t in s]))
