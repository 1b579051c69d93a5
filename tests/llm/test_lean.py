"""Workers of the cut stage hold little, and give back what a task freed when it ends."""

import tracemalloc

import numpy as np
import pandas as pd

from siltstone.llm import substring_dedup as S
from siltstone.llm import tokens


def test_marks_of_a_run_take_few_bytes_each():
    n = 4 << 20
    ids, data, offsets = np.arange(2), np.zeros(n, np.uint8), np.array([0, n // 2, n])
    tracemalloc.start()
    try:
        gone = S.covered(ids, data, offsets, (), {}, S.LENGTH)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(gone) == n and not gone.any()
    assert peak < 10 * n  # 13 bytes a byte with sums of eight bytes


def test_judge_gives_back_at_its_end(monkeypatch):
    steps = []
    monkeypatch.setattr(tokens, "trim", lambda: steps.append("trim"))
    monkeypatch.setattr(S, "merge_runs", lambda runs: steps.append("merge") or iter(()))
    width = 2 * S.LENGTH - S.GRAM + 2
    body = S._squeeze(np.zeros(1, np.uint8), np.zeros(1, "<i8"), np.zeros(1, "<i8"), np.zeros(width, np.uint8))
    S._judge(S.LENGTH)(pd.DataFrame({"run": [0], "part": [0], "body": [body]}))
    assert steps == ["trim", "merge", "trim"]


def test_lean_gives_back_after_the_last_batch(monkeypatch):
    steps = []
    monkeypatch.setattr(tokens, "trim", lambda: steps.append("trim"))

    def run(batches):
        for batch in batches:
            steps.append(batch)
            yield batch

    assert list(tokens.lean(run)([1, 2])) == [1, 2] and steps == [1, 2, "trim"]
