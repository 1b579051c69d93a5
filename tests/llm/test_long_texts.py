"""Batches are cut by bytes and very long texts by white space; ids stay those of the whole text."""

import random

import numpy as np
import pyarrow as pa

from siltstone.llm import tokens


def test_slices_cover_a_batch():
    rnd = random.Random(4)
    texts = [None if rnd.random() < 0.1 else "é" * rnd.choice([0, 1, 30, 500]) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["i", "t"])
    for rows, size in ((256, 4 << 20), (7, 300), (300, 1)):
        parts = list(tokens.slices(batch.slice(20), 1, rows, size))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(20, 300))
        length = lambda p: sum(len((t or "").encode()) for t in p.column(1).to_pylist())
        assert all(p.num_rows <= rows and (length(p) <= size or p.num_rows == 1) for p in parts)
    assert list(tokens.slices(batch.slice(0, 0), 1)) == []


def test_words_of_long_texts(monkeypatch):
    rnd = random.Random(5)
    words = ["The", "it's", "don't.", "42,", "x" * 70, "é", "İ", "<b>", "a-b", "!?"]
    bpe = tokens.WordBpe(tokens.default_path("word_bpe_49k.json"))
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", "\n", "  ", "\t\r\n"]) for _ in range(2000)), "y" * 5000, " " * 3000, "short", "", "日本 " * 2000, "<|endoftext|> " * 800]
    want = [np.array(bpe.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for most in (1 << 20, 500, 3):
        monkeypatch.setattr(tokens.WordBpe, "LONG", most)
        assert bpe.encode_all(texts) == want
