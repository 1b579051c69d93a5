import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import lexical_search as S
from siltstone.llm import queries as Q

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    """(item, rank, document, score), sorted; an item's rows are told apart by their text."""
    terms = [(d, TERM.findall((t or "").translate(SMALL))) for d, t in docs]
    terms = [(d, t) for d, t in terms if t]
    n_docs, total = len(terms), sum(len(t) for _, t in terms)
    df = Counter(t for _, ts in terms for t in set(ts))
    out = []
    for item, text in items:
        scores = []
        for d, ts in terms:
            m = 25 + 75 * len(ts) * n_docs // total
            tf, score = Counter(ts), 0
            for t in TERM.findall((text or "").translate(SMALL)):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0 and d is not None:
                scores.append((-score, d))
        if item is not None:
            out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7)).withColumn("block", F.lit("x")).withColumn("a.b", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("y")).withColumn("uid", F.lit(1))
    return sorted(map(tuple, S.search(d, i, k).select("item_id", "rank", "doc_id", "score").collect()))


def test_agrees_with_its_sql(same):
    same(Q.op11_lexical_search, S.ORACLE)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, monkeypatch, seed):
    """Many blocks, cells and sorts; frequent words in a third of all rows; marks and letters of all kinds."""
    for name, value in (("POSTINGS", 40), ("DOCS", 9), ("ITEMS", 3), ("CELL", 2), ("SORTED", 50)):
        monkeypatch.setattr(S, name, value)
    r = random.Random(seed)
    words = ["The", "the", "Über", "über", "naïve", "x1", "2", "_", "漢字", "\x00", "a_b", " ", "é", "İ", *[f"w{i}" for i in range(40)]]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ",", "\n", "-", "\x7f", ""]) for _ in range(n))
    docs = [(i, text(r.randrange(30))) for i in range(90)] + [(200 + i, "the the w1") for i in range(60)]
    items = [(i, text(r.randrange(12))) for i in range(11)]
    assert found(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows and ids, ties, a very long text, terms that no document has."""
    docs = [(1, None), (2, ""), (3, "  ,;"), (None, "apple pie"), (5, "apple"), (5, "apple"), (6, "apple"), (7, "Apple " * 300_000 + "x" * 1_000_000), (8, "pie"), (-9, "pie")]
    items = [(1, "apple"), (2, None), (3, ""), (4, "pear"), (None, "pie"), (6, "pie pie apple"), (6, "pie")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, 2) == brute(docs, items, 2)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [], []) == found(spark, [(1, None)], [(1, "a")]) == []


def test_sort_and_sums():
    r = np.random.default_rng(3)
    key, impact = r.integers(0, 1 << 32, 5000, dtype=np.uint32) & np.uint32(0x000F0FFF), r.integers(0, 1 << 40, 5000)
    assert (S.radix_order(key) == np.argsort(key, kind="stable")).all()
    want = defaultdict(int)
    for k, v in zip(key.tolist(), impact.tolist()):
        want[k] += v
    keys, sums = S.accumulate([key[:9], key[9:]], [impact[:9], impact[9:]])
    assert dict(zip(keys.tolist(), sums.tolist())) == want and (np.diff(keys.astype(np.int64)) > 0).all()
