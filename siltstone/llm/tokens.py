"""Exact, cached access to the public tokenizer files.

``ByteBpe`` gives the ids of a byte-level BPE file (.json of the tokenizers library). Text over an
alphabet on which both libraries' character classes are fixed (ASCII, Latin letters) may go to
the faster rank-file engine with the same merges; all other text, and any text that could hold a
special token or has very long white space, goes to the tokenizers library itself.

``WordBpe`` gives the ids of the lower-casing word BPE, one cached word at a time.

A *stable boundary* is a place that no alternative of the byte-level pre-tokenisation pattern matches
across and no look-ahead passes: after a visible character and before a space or line feed, after
a letter or digit and before a mark, between a letter and a digit. Only characters whose class is
the same in all Unicode versions count. No special token may hold one (checked on loading), so
ids left and right of it are independent.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER_ALPHABET = re.compile("[^\t\n\r -~À-įı-ɏ]|<\\|")
#: Runs of white space on which the rank-file engine's look-ahead would run out of memory to go back.
LONG_BLANK = re.compile("[\t\n\r ]{1000}")
#: UTF-8 of letters whose class has never changed: Latin, Greek, Cyrillic, Hebrew, Arabic, Thai, kana,
#: Han (U+5000 to U+8FFF) and Hangul (U+B000 to U+CFFF).
LETTER = (
    rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf]|\xce[\xb1-\xbf]|\xcf[\x80-\x89]|\xd0[\x90-\xbf]|\xd1[\x80-\x8f]|\xd7[\x90-\xaa]|\xd8[\xa1-\xba]|\xd9[\x81-\x8a]"
    rb"|\xe0\xb8[\x81-\xae]|\xe3(?:\x81[\x81-\xbf]|\x82[\xa1-\xbf]|\x83[\x80-\xba])|[\xe5-\xe8\xeb\xec][\x80-\xbf][\x80-\xbf])"
)
#: ASCII marks but the bar, which special tokens have, and dashes, quotes and full-width marks.
MARK = rb"(?:[!-/:-@\[-`{}~]|\xe2\x80[\x93\x94\x9c\x9d\xa6]|\xe3\x80[\x81\x82\x8c-\x8f]|\xef\xbc[\x81\x88\x89\x8c\x9a\x9b\x9f])"
#: Matches what stands before a stable boundary; the boundary is the match's end.
BEFORE = rb"(?:[!-~](?=[ \n])|[0-9](?=[A-Za-z]|" + MARK + rb")|" + LETTER + rb"(?=[ \n0-9]|" + MARK + rb"))"
STABLE = re.compile(BEFORE)
LAST_STABLE = re.compile(rb"(?s:.*)" + BEFORE)
#: Pre-tokenisation of the rank files: a fixed value of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(kind, path: str, *more):
    """One instance for a file and worker process."""
    key = (kind, path, *more)
    if key not in _loaded:
        _loaded[key] = kind(path, *more)
    return _loaded[key]


def forget() -> None:
    """Gives a worker's vocabularies and caches back. Workers outlive stages, so stages that need
    their memory for other things call this first."""
    _loaded.clear()
    trim()


def trim() -> None:
    """Freed memory goes back to the system where the C library can do that, as a worker would otherwise
    keep its largest task's share for ever."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(f):
    """``f(batches)``, a generator; when it ends, what it freed goes back. Idle workers take turns at tasks and live on
    between stages, so each would otherwise keep the share of the largest task it ever had."""

    def run(batches):
        yield from f(batches)
        trim()

    return run


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 4 << 20):
    """A batch in slices of at most ``rows`` rows and, unless it is one row, ``size`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        held = ends[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(ends, held + size, "right"))), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself if it is visible Latin-1, else as the next free
    character from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in seen}
    for b in range(256):
        if b not in seen:
            table[chr(256 + len(table) - len(seen))] = b
    return table


class ByteBpe:
    def __init__(self, path: str, ranks_path: str | None = None):
        self.tok = _library(path)
        to_byte = _byte_of_char()
        added = {i: t.content.encode() for i, t in self.tok.get_added_tokens_decoder().items()}
        if any(STABLE.search(t) or t != t.strip() for t in added.values()):
            raise ValueError("a special token holds a boundary that ids must not depend on")
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            self.bytes_of[i] = added[i] if i in added else bytes(to_byte[c] for c in text)
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        out, slow = [None] * len(texts), []
        for i, text in enumerate(texts):
            if self.fast is None or OTHER_ALPHABET.search(text) or LONG_BLANK.search(text):
                slow.append(i)
            else:
                out[i] = self.fast(text)
        for at in range(0, len(slow), 64):
            part = slow[at : at + 64]
            for i, e in zip(part, self.tok.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class WordBpe:
    """Ids as little-endian unsigned 32-bit bytes. Words of the plain alphabet are encoded once and
    cached, up to ``most`` of them at a time; other texts go to the library whole."""

    SPACE, LONG = re.compile("[ \t\n\r]"), 1 << 20
    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\\sa-z0-9ß-öø-ɏ]+")

    def __init__(self, path: str, most: int = 600_000):
        self.tok, self.most, self.cache = _library(path), most, {}
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _learn(self, words: list[str], step: int = 512) -> None:
        """Encodes words together; each ends with its only token that carries the word end."""
        parts = [words[at : at + step] for at in range(0, len(words), step)]
        for part, e in zip(parts, self.tok.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part):
                raise ValueError("the vocabulary file does not mark each word's end")
            raw = ids.tobytes()
            self.cache.update(zip(part, (raw[a:b] for a, b in zip([0, *ends], ends))))

    def _long(self, text: str) -> bytes:
        """A text in pieces that begin with white space, which no word crosses."""
        out, at = [], 0
        while at < len(text):
            end = self.SPACE.search(text, at + self.LONG)
            end = end.start() if end else len(text)
            out += self.encode_all([text[at:end]], whole=True)
            at = end
        return b"".join(out)

    def encode_all(self, texts: list[str], whole: bool = False) -> list[bytes]:
        if not whole and any(len(t) > self.LONG for t in texts):
            return [self._long(t) if len(t) > self.LONG and not OTHER_ALPHABET.search(t) else self.encode_all([t], whole=True)[0] for t in texts]
        split = [None if OTHER_ALPHABET.search(t) else self.WORDS.findall(t.lower()) for t in texts]
        new = set().union(*(w for w in split if w)).difference(self.cache)
        if len(self.cache) + len(new) > self.most:
            self.cache.clear()
            new = set().union(*(w for w in split if w))
        self._learn(list(new))
        get = self.cache.__getitem__
        return [self._whole(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, split)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
