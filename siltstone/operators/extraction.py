"""Extractors: from text to phrases, keyphrases, concepts, values and structured records.

An extractor is an object with the methods below. The offline one is deterministic and needs no
model; a remote one may be given instead and is called once for each text, in the tasks. Failures
stay in their row, as an error column.
"""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone import schemas
from siltstone.functions import text as X

WORD = re.compile(r"[^\W_][\w-]*")
#: Numbers that :func:`mmr_groups` may hold on the driver.
MOST_NUMBERS = 1 << 23


class Extractor(Protocol):
    def concepts(self, text: str, top_n: int) -> list[dict]: ...
    def values(self, text: str, concepts: list[str]) -> list[dict]: ...
    def record(self, context: str, concepts: list[str]) -> dict: ...


def candidates(text: str, longest: int = 3) -> list[str]:
    """All 1- to 3-grams of the words that are no stop words."""
    words = _words(text)
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)))


def _words(text: str) -> list[str]:
    return [w for w in WORD.findall((text or "").lower()) if w not in X.STOP_WORDS and len(w) > 1]


def _places(words: list[str], longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(start, number of words) of :func:`candidates`, in their order."""
    number: dict[str, int] = {}
    code = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    key, starts = code, []
    for n in range(1, longest + 1):
        if n > 1:
            key = key[:-1] * len(number) + code[n - 1 :]
        _, first, key = np.unique(key, return_index=True, return_inverse=True)
        starts.append(np.sort(first))
    return np.concatenate(starts), np.repeat(np.arange(1, longest + 1), [len(s) for s in starts])


def hashed_vectors(texts: list[str], size: int = 256) -> np.ndarray:
    """Unit vectors of character trigrams: a stand-in for sentence embeddings."""
    slot: dict[str, int] = {}
    at: list[int] = []
    for i, text in enumerate(texts):
        padded, base = f" {text.lower()} ", size * i
        for k in range(len(padded) - 2):
            g = padded[k : k + 3]
            if (b := slot.get(g)) is None:
                b = slot[g] = zlib.crc32(g.encode()) % size
            at.append(base + b)
    v = np.bincount(np.array(at, np.int64), minlength=size * len(texts)).reshape(-1, size).astype(np.float64)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def mmr(doc: np.ndarray, vectors: np.ndarray, top_n: int, diversity: float = 0.5) -> list[int]:
    """Maximal marginal relevance: picks in turn what is near the document and far from what is picked."""
    if not len(vectors):
        return []
    near = vectors @ doc
    chosen = [int(np.argmax(near))]
    closest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(top_n, len(vectors)):
        gain = (1 - diversity) * near - diversity * closest
        gain[chosen] = -np.inf
        chosen.append(int(np.argmax(gain)))
        closest = np.maximum(closest, vectors @ vectors[chosen[-1]])
    return chosen


def mmr_groups(df: DataFrame, group: str, key: str, vector: str, top_n: int, diversity: float = 0.5) -> DataFrame:
    """group, key: what :func:`mmr` picks from each group's unit vectors by their mean direction, every
    vector competing; of equal gains the smallest key (unique in its group) wins.

    One pass sums the unit vectors in fixed point, so order does not matter, and each of ``top_n`` more
    passes gives every task's best row of each group. The driver holds ``top_n`` vectors a group: at most
    ``MOST_NUMBERS`` numbers in all, more is an error."""
    spark, unit = df.sparkSession, float(1 << 30)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def groups(batch):
        labels = batch.column(0).to_pylist()
        codes: dict = {}
        code = np.array([codes.setdefault(x, len(codes)) for x in labels], np.int64)
        for label, c in codes.items():
            part = batch.take(pa.array(np.flatnonzero(code == c)))
            v = pc.list_flatten(part.column(2)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
            yield label, part, v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)

    def sums(batches):
        total: dict = {}
        for batch in batches:
            for label, _, v in groups(batch):
                high = np.rint(v * unit)
                low = np.rint((v * unit - high) * unit)
                new = len(v), high.astype(np.int64).sum(axis=0), low.astype(np.int64).sum(axis=0)
                total[label] = tuple(a + b for a, b in zip(total[label], new)) if label in total else new
        out = [{"g": g, "at": i, "n": n, "high": int(h), "low": int(l)} for g, (n, high, low) in total.items() for i, (h, l) in enumerate(zip(high, low))]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("g", like), ("at", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]))

    like = to_arrow_type(rows.schema["g"].dataType)
    parts = rows.mapInArrow(sums, f"g {types['g']}, at int, n long, high long, low long")
    parts = parts.groupBy("g", "at").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    centre: dict = {}
    sums_of_all = parts.orderBy("at").limit(MOST_NUMBERS // max(1, top_n) + 1).collect()
    if len(sums_of_all) * top_n > MOST_NUMBERS:
        raise ValueError(f"the groups' picks are more than {MOST_NUMBERS} numbers: take fewer groups at a time")
    for r in sums_of_all:
        centre.setdefault(r.g, []).append((int(r.high) + int(r.low) / unit) / unit / r.n)
    centre = {g: np.array(x) / max(np.linalg.norm(x), 1e-12) for g, x in centre.items()}
    chosen: dict = {g: ([], []) for g in centre}
    schema = pa.schema([("g", like), ("k", to_arrow_type(rows.schema["k"].dataType)), ("gain", pa.float64()), ("unit", pa.list_(pa.float64()))])
    for _ in range(top_n):
        state = spark.sparkContext.broadcast((centre, chosen))

        def best(batches, state=state):
            centre, chosen = state.value
            found: dict = {}
            for batch in batches:
                for label, part, v in groups(batch):
                    keys, (gone, picks) = part.column(1).to_pylist(), chosen[label]
                    gain = (v * centre[label]).sum(axis=1)
                    if picks:
                        closest = np.max([(v * p).sum(axis=1) for p in picks], axis=0)
                        gain = (1 - diversity) * gain - diversity * closest
                    free = [i for i, k in enumerate(keys) if k not in gone]
                    if free:
                        top = min(free, key=lambda i: (-gain[i], keys[i]))
                        new = -float(gain[top]), keys[top], v[top]
                        found[label] = min(found.get(label, new), new, key=lambda x: x[:2])
            yield pa.RecordBatch.from_pylist([{"g": g, "k": k, "gain": -x, "unit": v.tolist()} for g, (x, k, v) in found.items()], schema)

        tops = rows.mapInArrow(best, f"g {types['g']}, k {types['k']}, gain double, unit array<double>")
        tops = tops.groupBy("g").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "k", "unit")).alias("top")).collect()
        for r in tops:
            chosen[r.g][0].append(r.top.k)
            chosen[r.g][1].append(np.array(r.top.unit))
        state.destroy()
    picked = [(g, k) for g, (keys, _) in chosen.items() for k in keys]
    return spark.createDataFrame(picked, f"`{group}` {types['g']}, `{key}` {types['k']}")


def keyphrases(text: str, top_n: int = 20, diversity: float = 0.5, embed=hashed_vectors) -> list[tuple[str, float]]:
    """(phrase, score) by MMR, best score first; scores rounded to four digits. ``embed`` gives the unit
    vectors of a list of texts; its ``ngrams``, if it has that, those of places in a list of words."""
    words = _words(text)
    if not words:
        return []
    start, n = _places(words)
    phrase = lambda i: " ".join(words[start[i] : start[i] + n[i]])
    vectors = embed.ngrams(words, start, n) if hasattr(embed, "ngrams") else embed([phrase(i) for i in range(len(start))])
    doc = embed([text])[0]
    chosen = mmr(doc, vectors, top_n, diversity)
    return sorted(((phrase(i), round(float(vectors[i] @ doc), 4)) for i in chosen), key=lambda x: (-x[1], x[0]))


@dataclass(frozen=True)
class Offline:
    """Deterministic rules: concepts are keyphrases; a value is left empty and quoted by the first
    sentence that names the concept; a record takes what the context states."""

    embed: Callable[[list[str]], np.ndarray] = hashed_vectors

    def concepts(self, text: str, top_n: int) -> list[dict]:
        return [{"canonical": p, "paper_term": p, "relevance": s} for p, s in keyphrases(text, top_n, embed=self.embed)]

    def values(self, text: str, concepts: list[str]) -> list[dict]:
        sents = re.split(r"(?<=[.!?])\s+", text)
        found = ((c, next((s for s in sents if c in s.lower()), "")) for c in concepts)
        return [{"canonical": c, "value": "", "quote": q} for c, q in found if q]

    def record(self, context: str, concepts: list[str]) -> dict:
        doi = re.search(r"DOI \(from metadata\): (\S+)", context)
        author = re.search(r"Authors \(from metadata\): ([^;\n]+)", context)
        body = "\n".join(re.split(rf"\n\n(?:{X.OPENING}|{X.ABSTRACT})\n", context)[1:])  # the parts under a heading
        quotes = {v["canonical"]: v["quote"] for v in self.values(body, [c.lower() for c in concepts])}
        names = schemas.field_names(concepts)
        return {"doi": doi and doi[1], "author": author and author[1]} | {names[c]: quotes.get(c.lower()) for c in concepts}


def _rows(df: DataFrame, of, schema: str, names: list[str], delay_s: float = 0.0) -> DataFrame:
    """``of(key, text)`` gives rows; an exception becomes one row with its message in ``error``."""

    def run(frames):
        first = True
        for pdf in frames:
            rows = []
            for key, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                if delay_s and not first:
                    time.sleep(delay_s)
                first = False
                try:
                    rows += [(*r, None) for r in of(key, text)]
                except Exception as e:  # noqa: BLE001  a failed text must not lose the others
                    rows.append((key, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


def phrase_table(papers: DataFrame, text: str = "abstract", least_words: int = 1, longer_than: int = 4, chunker: Callable[[str, int, int], list[str]] | None = None) -> DataFrame:
    """paper, phrases: by built-in functions, or by a parser's ``chunker`` (see ``models``)."""
    if chunker is None:
        phrases = X.noun_phrases(F.col(text), least_words, longer_than)
    else:

        @F.pandas_udf("array<string>")
        def chunked(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: chunker(t or "", least_words, longer_than))

        phrases = chunked(F.col(text))
    return papers.where(~X.missing(F.col(text))).select("paper", phrases.alias("phrases"))


def concept_table(papers: DataFrame, extractor: Extractor, top_n: int = 25, text: str = "abstract", delay_s: float = 0.0) -> DataFrame:
    """paper, doi, canonical, paper_term, relevance, pos, error: one row for each paper and concept."""

    def of(key, body):
        paper, doi = key["paper"], key["doi"]
        found = sorted(extractor.concepts(body, top_n), key=lambda c: -(c.get("relevance") or 0))[:top_n]
        return [({"paper": paper, "doi": doi}, str(c.get("canonical", "")).strip().lower(), str(c.get("paper_term", "")).strip(), round(float(c.get("relevance") or 0), 4), i) for i, c in enumerate(found)]

    rows = papers.where(~X.missing(F.col(text))).select(F.struct("paper", F.coalesce("doi", F.lit("")).alias("doi")).alias("key"), text)
    out = _rows(rows, of, "key struct<paper: string, doi: string>, canonical string, paper_term string, relevance double, pos long, error string", ["key", "canonical", "paper_term", "relevance", "pos", "error"], delay_s)
    return out.select("key.paper", "key.doi", "canonical", "paper_term", "relevance", "pos", "error")


def value_table(papers: DataFrame, extractor: Extractor, concepts: list[str], text: str = "text", delay_s: float = 0.0) -> DataFrame:
    """paper, concept, value, quote, pos, error."""

    def of(key, body):
        wanted = set(concepts)
        found = [(str(v.get("canonical", "")).strip().lower(), v) for v in extractor.values(body, concepts)]
        return [(key, c, v.get("value") or "", v.get("quote") or "", i) for i, (c, v) in enumerate(found) if c in wanted]

    rows = papers.where(~X.missing(F.col(text))).select("paper", text)
    return _rows(rows, of, "paper string, concept string, value string, quote string, pos long, error string", ["paper", "concept", "value", "quote", "pos", "error"], delay_s)


def record_table(papers: DataFrame, extractor: Extractor, concepts: list[str], device_type: bool = True, delay_s: float = 0.0) -> DataFrame:
    """Title, Author, Institution, Country, DOI, Device Type and one column a concept; what is not stated
    is "Not Specified". The record's schema is built from the concepts at run time."""
    struct, names = schemas.extraction_struct(concepts, device_type), schemas.field_names(concepts)
    context = X.context_block(F.col("title"), F.col("doi"), F.col("authors"), F.col("full_text"), F.col("abstract"))

    def of(title, body):
        return [(title, json.dumps({k: v for k, v in extractor.record(body, concepts).items() if v}))]

    raw = _rows(papers.select("title", context.alias("context")), of, "title string, json string, error string", ["title", "json", "error"], delay_s)
    got = raw.select("title", F.from_json("json", struct).alias("r"))
    stated = lambda f: F.coalesce(F.nullif(F.col(f"r.{f}"), F.lit("")), F.lit(X.NOT_SPECIFIED))
    fixed = [(X.doi_url(F.col("r.doi")) if f == "doi" else F.when(stated(f).isin(*schemas.DEVICE_TYPES), stated(f)).otherwise(X.NOT_SPECIFIED) if f == "device_type" else stated(f)).alias(h) for f, h in schemas.FIXED_FIELDS.items() if device_type or f != "device_type"]
    headers = schemas.unique_labels(concepts, ["Title", *schemas.FIXED_FIELDS.values()])
    return got.select(F.col("title").alias("Title"), *fixed, *[stated(names[c]).alias(h) for c, h in zip(dict.fromkeys(concepts), headers)])


def tool_payload(calls, name: str, schema: str):
    """Arguments of the tool call of a name, else of the first call; null where the JSON is broken."""
    parsed = F.from_json(calls, schemas.CALLS_JSON)
    named = F.filter(parsed, lambda c: c["name"] == name)
    pick = F.coalesce(F.get(named, F.lit(0)), F.get(parsed, F.lit(0)))
    return F.from_json(pick["arguments"], schema)


def system_prompt(concepts: list[str], domain: str = "the papers' field") -> str:
    """Instructions for a remote extractor."""
    wanted = "\n".join(f"- {c}" for c in concepts)
    return f'You read papers of {domain}. Report only what the text states; write "{X.NOT_SPECIFIED}" for what it does not state. Fields: {", ".join(schemas.FIXED_FIELDS)}, and for each of these concepts the exact term, value or measurement:\n{wanted}'
