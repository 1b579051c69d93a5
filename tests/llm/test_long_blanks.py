"""Texts with up to two million characters of white space in a row, end to end: as the library has them."""

import hashlib

import pytest

from siltstone.llm import bpe_codec, token_counts, tokens

JSON, RANKS = (tokens.default_path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
N = 2_000_000


@pytest.fixture(scope="module")
def rows():
    texts = {
        "blanks": " " * N, "feeds": "\n" * N, "tabs": "\t" * N, "returns": "\r" * N, "mixed": " \n\t\r" * (N // 4),
        "between": "word" + " " * N + "another one", "lines": "first" + "\n" * N + "\n  last", "pairs": "a" + " \n" * (N // 2) + "b.", "early": " " * 999 + "x", "limit": " " * 1000 + "x" + "\t" * 1001 + "y",
        "odd": "é" + " " * 5000 + "漢" + " " * 5000, "plain": "just words " * 100,
    }
    library = tokens._library(JSON)
    return [(i, t, library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts.values())]


def test_counts(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, JSON, RANKS).collect()}
    assert got == {i: (len(t.encode()), len(ids)) for i, t, ids in rows}


def test_codec(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.digests(df, JSON, RANKS).collect()}
    assert got == {i: (len(ids), sha(",".join(map(str, ids))), sha(t)) for i, t, ids in rows}
