import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ann_search as A
from siltstone.llm import queries as Q

IS_QUERY = "vec_id % 20 = 0"


def brute(rows, k=20):
    """(query, rank, id, score), sorted: products summed in the order of the components."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    asked = {}
    for i, v in good:
        if i % 20 == 0:
            asked.setdefault(i, v)
    out = []
    for q, x in asked.items():
        scores = []
        for i, v in good:
            if i != q:
                s = 0.0
                for a, b in zip(x, v):
                    s += a * b
                scores.append((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("q", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("part.x", F.lit(1)).repartition(5)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def recall(got, want):
    want = {(q, i) for q, _, i, _ in want}
    return len(want & {(q, i) for q, _, i, _ in got}) / len(want)


def clustered(n, seed=3, width=16, clusters=40):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, width))
    return [(i, (centres[r.integers(clusters)] + 0.4 * r.normal(size=width)).astype(np.float32).astype(float).tolist()) for i in range(n)]


def test_query_over_its_whole_table(spark):
    """One part: every candidate is reranked."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(Q.op12_ann_search(spark, sf)) == brute(rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_over_many_parts(spark, kind):
    """Learned parts, several blocks of each: nine tenths found, scores exact, fewer rows visited than there are."""
    rows = clustered(3000)
    want = brute(rows)
    got = found(A.search(frame(spark, rows, kind), IS_QUERY, part=100, block=60))
    assert recall(got, want) >= 0.9
    assert len(got) == len(want) and [r for _, r, _, _ in got] == [r for _, r, _, _ in want]
    vectors = dict(rows)
    for q, _, i, s in got:
        assert s == float(A.exact_scores(np.array([vectors[q]]), np.array([vectors[i]]))[0])


def test_all_parts_give_the_exact_result(spark):
    """With every part visited nothing is lost: hot vectors, ties, repeated rows and ids over many parts and blocks."""
    rows = clustered(400, 5, 6)
    rows += [(1000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]) for i in range(700)]
    rows += [(1000, [9.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (1000, [8.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (20, [1.0, 2.0, 3.0]), rows[40], rows[40]]
    for k in (3, 20):
        assert found(A.search(frame(spark, rows), IS_QUERY, k, recall=1.1, part=50, block=30)) == brute([(i, [*v, *[0.0] * (6 - len(v))]) for i, v in rows], k)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [1.0, 2.0, 5.0]), (140, [-1.0, -2.0, -3.0]), (9, [1.0]), (7, [1.0])]
    want = brute([(i, v and [*v, *[0.0] * (3 - len(v))]) for i, v in rows if v])
    assert found(A.search(frame(spark, rows), IS_QUERY)) == want
    assert {q for q, *_ in want} == {0, 140}


def test_empty_and_lonely(spark):
    assert found(A.search(frame(spark, []), IS_QUERY)) == []
    assert found(A.search(frame(spark, [(0, [1.0])]), IS_QUERY)) == []
    assert found(A.search(frame(spark, [(1, [1.0]), (2, [1.0])]), IS_QUERY)) == []


def test_parts_are_balanced_and_follow_the_graph():
    x = np.array([v for _, v in clustered(2048)])
    near = A.nearest(x, x, 16, own=True)
    part = A.balanced_parts(x, near, 4)
    assert set(np.bincount(part)) == {128}
    assert (part[near] == part[:, None]).mean() > 0.6  # by chance: a sixteenth
