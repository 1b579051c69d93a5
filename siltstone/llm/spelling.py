"""Spelling variants by full neighbourhood generation.

1. Words are counted in the documents' own tasks and summed by word.
2. Of every word all strings at one edit are generated: each letter deleted, replaced by and preceded
   by each letter of the alphabet that the vocabulary shows. They are first told by hashes only: a
   word's hash is a sum of letter times power, so a neighbour's hash takes two additions from sums of
   the letters before and after, for all places and letters at once. A Bloom filter of the
   vocabulary, of bounded size, lets pass the few that may be words.
3. What is left meets the vocabulary in a hash join; a candidate counts if the string that its edit makes
   is the word met, so no distance is computed. Candidates travel as hash and edit, not as strings:
   those of a word of a million letters would not fit. Neighbours are counted and the best of them
   found by one aggregate that combines on the map side.
4. Roots follow the forms by pointer doubling: a form has ten times its word's occurrences, so chains
   have fewer steps than the largest count has digits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .tokens import slices

#: Maximal runs of letters as the contract names them, those that are long enough for a word.
LEAST = 7
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST},}}")
#: Odd multiplier of the hash, its inverse, and multipliers of the filter's four hash functions.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
MIXES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
#: Bits of the filter for each word, and at least and most in all (64 MB); bits of one piece of it.
PER_WORD, FEWEST, MOST, PIECE = 32, 1 << 16, 1 << 29, 1 << 15
#: Places of letters whose neighbours are generated at a time.
PLACES = 1 << 13


def edited(doc_id, runs: Counter) -> Counter:
    """Words of one document's runs (lower-cased), with their occurrences: one run in 31 has a letter deleted,
    as told by the checksum of id and run."""
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % 31 == 0:
            cut = h % len(run)
            run = run[:cut] + run[cut + 1 :]
        if len(run) >= LEAST:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, least: int = 2, hold: int = 300_000) -> DataFrame:
    """word, n, h: words of at least ``LEAST`` letters with at least ``least`` occurrences, and their hashes."""

    def run(batches):
        counts: Counter = Counter()

        def row():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (raw := text.as_py()) is not None:  # of bytes only A-Z are lower-cased
                    counts.update(edited(doc_id, Counter(RUN.findall(raw.lower().decode()))))
                if len(counts) >= hold:
                    yield row()
                    counts = Counter()
        if counts:
            yield row()

    def hashed(batches):
        for batch in batches:
            for part in slices(batch, 0, 16_384):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(Words(part.column(0).to_pylist()).hash.astype(np.int64))], ["word", "n", "h"])

    words = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n long")
    words = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return staged(words.mapInArrow(hashed, "word string, n long, h long"))


def slots(hashes: np.ndarray, mix: int, bits: int) -> np.ndarray:
    """Places of hashes in a filter of ``bits`` bits, a power of two."""
    h = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(mix)
    return (h ^ (h >> np.uint64(29))) * np.uint64(BASE) >> np.uint64(65 - bits.bit_length())


class Words:
    """Words as one array of letters, with the sums that hashes of neighbours are made of."""

    def __init__(self, words: list[str]):
        self.words = words
        self.letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(self.sizes)
        self.word = np.repeat(np.arange(len(words)), self.sizes)
        self.at = np.arange(len(self.letters)) - (ends - self.sizes)[self.word]
        powers = np.full(int(self.sizes.max(initial=0)) + 2, BASE, np.uint64)
        powers[:1] = 1
        self.power = np.multiply.accumulate(powers)
        term = self.letters * self.power[self.at]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
        self.hash = sums[ends] - sums[ends - self.sizes]
        #: Sums of the letters before, and after, each place.
        self.before = sums[:-1] - sums[ends - self.sizes][self.word]
        self.after = self.hash[self.word] - self.before - term


def neighbours(w: Words, alphabet: np.ndarray, may_be):
    """(words' numbers, place, skipped, letter, hash) in parts: all distinct strings at one edit of each word whose
    hash passes ``may_be``. A string is the word's first ``place`` letters, the letter (none: 0) and what
    comes after ``skipped`` letters. Of edits with equal results, as within a run of one letter, one is given."""
    back, base, none = np.uint64(BACK), np.uint64(BASE), np.uint64(0)
    previous = np.zeros_like(w.letters)
    previous[1:] = w.letters[:-1]
    previous[w.at == 0] = none

    def of(number, place, skipped, letter, hashes, fine):
        k = np.flatnonzero(fine & may_be(hashes))
        return number[k], place[k], np.full(len(k), skipped, np.int32), letter[k], hashes[k]

    def each_letter(number, place, skipped, other, rest, power):
        n = len(alphabet)
        hashes = (rest[:, None] + alphabet[None, :] * power[:, None]).ravel()
        letter = np.tile(alphabet, len(number))
        return of(np.repeat(number, n), np.repeat(place, n), skipped, letter, hashes, letter != np.repeat(other, n))

    for at in range(0, len(w.letters), PLACES):
        p = np.arange(at, min(at + PLACES, len(w.letters)))
        number, place, before, after = w.word[p], w.at[p], w.before[p], w.after[p]
        yield of(number, place, 1, np.zeros(len(p), np.uint64), before + after * back, w.letters[p] != previous[p])
        yield each_letter(number, place, 1, w.letters[p], before + after, w.power[place])
        yield each_letter(number, place, 0, previous[p], before + (w.hash[number] - before) * base, w.power[place])
    for at in range(0, len(w.words), PLACES):  # behind the last letter
        number = np.arange(at, min(at + PLACES, len(w.words)))
        yield each_letter(number, w.sizes[number], 0, w.letters[np.cumsum(w.sizes)[number] - 1], w.hash[number], w.power[w.sizes[number]])


def _filter(words: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of ``words(h)``, set in the tasks' aggregates; at most ``MOST`` bits reach the driver."""

    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().astype(np.uint64)
            at = np.concatenate([slots(h, m, bits) for m in MIXES]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // PIECE), pa.array(at % PIECE)], ["piece", "bit"])

    pieces = words.select("h").mapInArrow(run, "piece long, bit long").groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces.collect():
        out[r.piece * PIECE // 8 : (r.piece + 1) * PIECE // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def pairs(words: DataFrame, bits: int | None = None) -> DataFrame:
    """word, near, near_n for every pair of near words of ``words(word, n, h)``, in both directions."""
    spark = words.sparkSession
    bits = bits or min(MOST, max(FEWEST, 1 << (PER_WORD * max(1, words.count()) - 1).bit_length()))
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").distinct()
    alphabet = np.array(sorted(ord(r.letter) for r in letters.collect()), np.uint64)  # at most 90: see RUN
    shared = spark.sparkContext.broadcast(_filter(words, bits).tobytes())

    def run(batches):
        table = np.frombuffer(shared.value, np.uint8)

        def may_be(hashes: np.ndarray) -> np.ndarray:
            out, left = np.zeros(len(hashes), bool), np.arange(len(hashes))
            for mix in MIXES:
                at = slots(hashes[left], mix, bits)
                left = left[table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0]
            out[left] = True
            return out

        for batch in batches:
            for part in slices(batch, 0, 4096, 1 << 20):
                w = Words(part.column(0).to_pylist())
                for number, place, skipped, letter, hashes in neighbours(w, alphabet, may_be):
                    letter = [chr(x) if x else "" for x in letter.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w.hash[number].astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(skipped), pa.array(letter, pa.string()), pa.array(hashes.astype(np.int64))],
                        ["of", "place", "skipped", "letter", "h"],
                    )

    made = words.select("word").mapInArrow(run, "of long, place int, skipped int, letter string, h long")
    met = made.join(words.select("h", F.col("word").alias("near"), F.col("n").alias("near_n")), "h").drop("h")
    both = met.join(words.select(F.col("h").alias("of"), "word"), "of")
    whole = F.concat(F.substr("word", F.lit(1), F.col("place")), "letter", F.substr("word", F.col("place") + F.col("skipped") + 1))
    return both.where(whole == F.col("near")).select("word", "near", "near_n")


def roots(links: DataFrame) -> DataFrame:
    """word, root of ``links(word, form)`` without circles: the end of each word's chain of forms."""
    now = staged(links.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = staged(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of ``docs(doc_id, text)``.

    Null and empty texts have no words. A row without an id has the empty string for it in checksums; rows that
    repeat an id, or id and text, count each. Of near words with equal n the smallest in code-point order is the
    form. A run of letters of any length is one word. An empty table gives an empty result; other columns are not
    read.
    """
    words = vocabulary(docs)
    best = pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= factor * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )
    found = staged(found)
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
