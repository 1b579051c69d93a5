"""Top-k search over several blocks on both sides of the grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import topk_search


def brute(rows, k):
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    out = set()
    for q, x in good:
        if q % 100 == 0:
            scores = [(sum(a * b for a, b in zip(x, y)), c) for c, y in good if c != q]
            best = sorted((s for s in scores if -(2**63) <= s[0] < 2**63), key=lambda s: (-s[0], s[1]))[:k]
            out |= {(q, r + 1, c, s) for r, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize("scale", [1, 3000.0, 4e6])
def test_blocks_of_both_sides(spark, monkeypatch, scale):
    """Clustered vectors with ties; scores that are exact in single and in double precision and beyond."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (scale * (centres[i % 6] + 0.2 * rng.normal(size=12))).round(1).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[i][1]) for i in range(0, 300, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for k, block, most in ((10, 1024, 4096), (3, 4, 100)):
        monkeypatch.setattr(topk_search, "CANDIDATES", most)
        assert {tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 100 == 0, k, block=block).collect()} == brute(rows, k)


def test_numbers_beyond_a_long(spark):
    rows = [(100, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [1.0, 3.0]), (3, [-2.0, 1e9]), (4, [0.0, 0.0]), (5, [1e300, 1.0]), (200, [5e8, -5e8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 100 == 0).collect()} == brute([r for r in rows if r[0] != 5], 10)


def test_reading_stops_and_leaves_few(monkeypatch):
    """On vectors with a few clear winners the lists are not read to the last depth."""
    rng = np.random.default_rng(3)
    values = rng.integers(-20, 20, (4096, 16))
    values[rng.choice(4096, 30, replace=False)] += 400
    block, depths = topk_search.Block(np.arange(4096), values), []
    read = topk_search.Block.read
    monkeypatch.setattr(topk_search.Block, "read", lambda self, kind, d: (depths.append(1) or x for x in read(self, kind, d)))
    queries = np.full((3, 16), 7)
    got = block.best(queries, np.array([-1, -1, -1]), 10, np.full(3, -np.inf))
    scores = values @ queries[0]
    want = np.lexsort((np.arange(4096), -scores))[:10]
    assert all(ids.tolist() == want.tolist() and s.tolist() == scores[want].tolist() for ids, s in got)
    assert len(depths) < len(topk_search.DEPTHS)


def test_plan_collects_no_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    plan = topk_search.top_k(df, F.col("vec_id") % 100 == 0)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" in plan and "LocalRelation" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
