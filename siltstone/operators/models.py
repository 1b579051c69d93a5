"""Language models that may be installed, for the places where the offline rules stand in for them. None
is required; a worker loads a model once, when it first needs it."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import numpy as np

_loaded: dict = {}


def _once(key: tuple, make: Callable):
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


#: Kinds of words that are no part of a phrase.
LEFT_OUT = ("DET", "PRON")


def noun_chunker(model: str = "en_core_web_sm", library: str = "spacy") -> Callable[[str, int, int], list[str]]:
    """(text, least words, longer than) -> noun phrases by a parser, for ``extraction.phrase_table``. Length
    is that of the chunk as it stands; its determiners and pronouns are then left out."""
    importlib.import_module(library)  # told at once, not in a task

    def phrases(text: str, least_words: int, longer_than: int) -> list[str]:
        parse = _once((library, model), lambda: importlib.import_module(library).load(model))

        def kept() -> Iterator[str]:
            for chunk in parse(text).noun_chunks:
                if len(chunk.text) > longer_than and len(chunk.text.split()) >= least_words:
                    yield " ".join(w.text for w in chunk if w.pos_ not in LEFT_OUT).strip().lower()

        return list(dict.fromkeys(kept()))

    return phrases


def sentence_embedder(model: str = "all-MiniLM-L6-v2", library: str = "sentence_transformers") -> Callable[[list[str]], np.ndarray]:
    """texts -> unit vectors by a sentence embedding model, for ``extraction.Offline(embed=...)``."""
    importlib.import_module(library)

    def embed(texts: list[str]) -> np.ndarray:
        encoder = _once((library, model), lambda: importlib.import_module(library).SentenceTransformer(model))
        v = np.asarray(encoder.encode(texts), np.float64).reshape(len(texts), -1)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    return embed
