"""Word vectors against dense counts and a dense factorisation."""

import math
import random
import re
import types
from collections import Counter

import numpy as np

from siltstone.functions import text as X
from siltstone.operators import extraction as E
from siltstone.operators import vectors as V

GROUPS = [["cell", "film", "layer", "solar"], ["tiger", "lion", "leopard", "zebra"], ["sonata", "fugue", "prelude", "waltz"]]


def texts(n=120):
    r = random.Random(2)
    out = []
    for i in range(n):
        g = GROUPS[i % 3]
        out.append(" and the ".join(r.choice(g) if r.random() > 0.1 else r.choice(["odd", "rare", "word"]) for _ in range(r.randrange(1, 30))))
    return [*out, None, "", "of the", "Cell-Film " * 2000, "once"]


def dense(bodies, window):
    split = [[w for w in re.findall(r"[^\W_][\w-]*", (t or "").lower()) if w not in X.STOP_WORDS and len(w) > 1] for t in bodies]
    n = Counter(w for ws in split for w in ws)
    names = sorted((w for w in n if n[w] >= 2), key=lambda w: (-n[w], w))
    at = {w: i for i, w in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    for ws in split:
        for i, a in enumerate(ws):
            for j in range(max(0, i - window), min(len(ws), i + window + 1)):
                if i != j and a in at and ws[j] in at:
                    c[at[a], at[ws[j]]] += 1
    s = c.sum(axis=1)
    ppmi = np.array([[max(0.0, math.log(c[i, j] * c.sum() / (s[i] * s[j]))) if c[i, j] else 0.0 for j in range(len(names))] for i in range(len(names))])
    return names, n, c, ppmi


def frame(spark):
    return spark.createDataFrame([(str(i), "", t, 1) for i, t in enumerate(texts())], "paper string, doi string, text string, a int").repartition(5)


def test_counts_weights_and_factors(spark):
    names, n, c, ppmi = dense(texts(), 4)
    rows = V.vocabulary(frame(spark)).collect()
    assert [(r.word, r.n, r.number) for r in rows] == [(w, n[w], i) for i, w in enumerate(names)]
    counts = V.neighbour_counts(frame(spark), {w: i for i, w in enumerate(names)})
    assert {(r.a, r.b): r.n for r in counts.collect()} == {(i, j): v for (i, j), v in np.ndenumerate(c) if v}
    matrix = V.weights(counts)
    got = np.zeros_like(ppmi)
    for r in matrix.collect():
        got[r.a, r.b] = r.weight
    assert np.allclose(got, ppmi)
    matrix = matrix.repartition("a")
    assert np.allclose(V.times(matrix, np.eye(len(names))), ppmi)
    v, values = V.factor(matrix, len(names), 64)  # as wide as the matrix: exact
    assert np.allclose(v * values @ v.T, ppmi)
    v, values = V.factor(matrix, len(names), 3, rounds=8, extra=6)
    best = sorted(np.linalg.eigvalsh(ppmi), key=abs)[::-1][:3]
    assert np.allclose(values, best, rtol=1e-3) and np.allclose(v.T @ v, np.eye(3), atol=1e-8)
    assert [r.word for r in V.vocabulary(frame(spark), most=3).collect()] == names[:3]


def test_words_of_one_group_are_near(spark):
    learned = V.learn(frame(spark), size=8)
    flat = [w for g in GROUPS for w in g]
    sim = learned(flat) @ learned(flat).T
    inside = np.kron(np.eye(3), np.ones((4, 4))) > 0
    assert sim[inside].min() > sim[~inside].max()
    assert not learned(["unheard of", ""]).any() and np.allclose(np.linalg.norm(learned(["tiger lion", "cell"]), axis=1), 1)
    rows = E.concept_table(frame(spark), E.Offline(learned), 3, "text").collect()
    assert {r.error for r in rows} == {None} and {r.paper for r in rows} >= {str(i) for i in range(120)}


def test_nothing_to_learn_from(spark):
    learned = V.learn(frame(spark).where("false"))
    assert not learned(["word"]).any()


def test_phrases_of_a_text_are_embedded_at_once():
    """Same phrases and vectors, bit by bit, as of the list of candidates, without a call for each of them."""
    r = random.Random(5)
    known = [f"w{i}" for i in range(30)]
    vectors = np.random.default_rng(3).normal(size=(30, 64))
    embed = V.WordVectors(types.SimpleNamespace(value=({w: i for i, w in enumerate(known)}, vectors)))
    for body in (" ".join(r.choice([*known, "Other", "the", "x", "word-joined"]) for _ in range(200)), "w1", "w1 w1 w1 w1", "other words", "the of", ""):
        words = E._words(body)
        if words:
            start, n = E._places(words)
            names = [" ".join(words[a : a + k]) for a, k in zip(start, n)]
            assert names == E.candidates(body) and (embed.ngrams(words, start, n) == embed(names)).all()
        seen = []

        class Watched:
            ngrams = embed.ngrams

            def __call__(self, texts):
                seen.extend(texts)
                return embed(texts)

        assert E.keyphrases(body, 20, embed=Watched()) == E.keyphrases(body, 20, embed=lambda texts: embed(texts))
        assert len(seen) <= 1
