"""Texts without white space: ids as the whole text's, and every byte encoded about once."""

import base64
import random

import pytest

from siltstone.llm import bpe_codec, token_counts, tokens

JSON, RANKS = (tokens.default_path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


def texts():
    rnd = random.Random(1)
    han = lambda marks: "".join(chr(rnd.randint(0x4E00, 0x9FA5)) if rnd.random() > marks else rnd.choice("，。、") for _ in range(60_000))
    join = lambda parts, n: "".join(rnd.choice(parts) for _ in range(n))
    return {
        "han": han(0.08), "han without marks": han(0), "base64": base64.b64encode(rnd.randbytes(150_000)).decode(),
        "minified": join(["a", "fn", "var", "x1", "=>", "(", "){", ";", ",", "'s", "!=", "|", "<|", "endoftext", "|>", "<|endoftext|>"], 50_000),
        "kana": join([*map(chr, range(0x3041, 0x3095)), *map(chr, range(0x30A0, 0x3100)), "。", "、"], 60_000),
        "cyrillic": " ".join(join([*map(chr, range(0x400, 0x460))], 6) for _ in range(20_000)),
        "mixed": join(["é", "é", "ß", "ø", "×", "÷", "ا", "ً", "ก", "ิ", "한", "ﷺ", "½", "3", "٣", " ", "　", " ", "\n", "—", "“", "…", "'t", "Z", "_"], 60_000),
        "one letter": "x" * 200_000, "marks": "!?" * 80_000,
    }


@pytest.fixture(scope="module")
def bpe():
    return tokens.ByteBpe(JSON, RANKS)


class Counting:
    def __init__(self, bpe):
        self.bpe, self.sizes, self.bytes = bpe, bpe.sizes, 0

    def encode_all(self, some):
        self.bytes += sum(len(t.encode()) for t in some)
        return self.bpe.encode_all(some)


@pytest.mark.parametrize("kind", texts())
def test_whole_ids_and_linear_work(bpe, kind):
    text = texts()[kind]
    want = bpe.tok.encode(text, add_special_tokens=False).ids
    for chunk, overlap in ((1 << 14, 128), (500, 2)):
        counting = Counting(bpe)
        assert token_counts.spliced_ids(text.encode(), counting, chunk, overlap) == want
        assert counting.bytes <= (1.5 if chunk > 1000 else 3) * len(text.encode()) + chunk
    spans = bpe_codec.ChunkCodec(bpe).encode([text.encode()])[0]
    assert [int(x) for s in spans for x in s[0].split(",") if x] == want


def test_unaligned_neighbours_are_joined(bpe, monkeypatch):
    """Were a boundary not stable, both encodings would not share it, and the two chunks become one."""
    import re

    monkeypatch.setattr(token_counts, "STABLE", re.compile(rb"[a-z](?=[a-z])"))
    text = " ".join(random.Random(2).choice(["international", "tokenization", "misunderstanding"]) for _ in range(400))
    assert token_counts.spliced_ids(text.encode(), bpe, 200, 4) == bpe.tok.encode(text, add_special_tokens=False).ids


def test_special_tokens_must_not_hold_a_boundary(tmp_path):
    from tokenizers import AddedToken

    lib = tokens.ByteBpe(JSON).tok
    lib.add_special_tokens([AddedToken("<a b>")])
    lib.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        tokens.ByteBpe(str(tmp_path / "t.json"))
