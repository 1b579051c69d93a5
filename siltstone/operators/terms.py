"""Terms of a collection by what its texts repeat: counts of nested n-grams.

A run of words between stop words and marks holds all n-grams of its words. One that occurs only inside
a longer one is part of that term and no term itself, so an n-gram counts as often as it occurs less the
mean count of the longer n-grams that hold it, times its number of words. Two aggregates do it, both
combined on the map side: one counts, the other adds each n-gram's own count and those it lends to the
n-grams inside it.

Most n-grams occur once and are no terms. So a first pass counts their hashes, and only what may be frequent
enough by these counts is spelled out, shuffled and counted as text in a second one. What tasks share is a bitmap
of bounded size; where it is too small for the n-grams more pass it, which changes no count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.matching import _parts
from siltstone.operators.staging import staged

#: Bytes of text that a task counts at once, bits of the bitmap at least and at most, and of its pieces.
HELD, FEWEST, BITS, PIECE = 1 << 23, 1 << 20, 1 << 29, 1 << 15
BREAK = "|"
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Numbers of tokens as they stand in a text: a word's own, 0 for what breaks a run, -1 for what is no word. ``words`` are
    the numbered ones."""

    def __init__(self):
        super().__init__({BREAK: 0})
        self.words, self.own = [BREAK], {}

    def __missing__(self, token: str) -> int:
        word = token.lstrip("_-")
        if word in X.STOP_WORDS or not word:
            self[token] = 0 if word else -1
        else:
            self[token] = self.own.setdefault(word, len(self.words))
            if self[token] == len(self.words):
                self.words.append(word)
        return self[token]

    def hashes(self) -> np.ndarray:
        return _word_hashes(self.words)


def _word_hashes(words) -> np.ndarray:
    """Equal in all tasks."""
    return pd.util.hash_array(np.array([*words], object), categorize=False)


def _grams(ids: np.ndarray, longest: int):
    """For each n: n, the places where an n-gram without a break starts, its code there, and each code's first place and
    number of places. Codes are equal for equal n-grams only."""
    code, fine = ids, ids > 0
    for n in range(1, min(longest, len(ids)) + 1):
        if n > 1:
            code, fine = code[:-1] << 32 | ids[n - 1 :], fine[:-1] & (ids[n - 1 :] > 0)
        at = np.flatnonzero(fine)
        _, first, codes, count = np.unique(code[at], return_index=True, return_inverse=True, return_counts=True)
        code = np.zeros(len(code), np.int64)
        code[at] = codes
        yield n, at, codes, at[first], count


def _hashes(ids: np.ndarray, words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(at), n, np.uint64)
    for i in range(n):
        out = (out ^ words[ids[at + i]]) * MIX
        out ^= out >> np.uint64(31)
    return out


def _spelled(ids: np.ndarray, words: pa.Array, at: np.ndarray, n: int) -> pa.Array:
    return pc.binary_join_element_wise(*[words.take(pa.array(ids[at + i])) for i in range(n)], " ")


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _passing(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = _slots(hashes, len(bitmap) * 8)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of the slots of staged ``hashes(hash)``."""
    n = hashes.count()
    bits = min(BITS, max(FEWEST, 1 << (16 * n).bit_length()))
    slot = F.shiftrightunsigned("hash", 65 - bits.bit_length())
    rows = hashes.select(F.floor(slot / PIECE).alias("piece"), (slot % PIECE).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r.piece * PIECE // 8 : (r.piece + 1) * PIECE // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _held(batches, column: int):
    """(words' numbers of some rows of a batch, where rows begin, numbers, the first row's number, the batch); each row ends
    with a break, rows have about ``HELD`` bytes at most."""
    for batch in batches:
        for texts, low, _ in _parts(batch.column(column), HELD):
            lists = pc.utf8_split_whitespace(texts)
            tokens, number = lists.flatten().dictionary_encode(), _Numbers()
            own = np.fromiter(map(number.__getitem__, tokens.dictionary.to_pylist()), np.int64, len(tokens.dictionary))
            ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
            codes = np.insert(own[tokens.indices.to_numpy()], ends, 0)
            fine = codes >= 0
            starts = np.concatenate(([0], ends[:-1])) + np.arange(len(ends))
            yield codes[fine], np.concatenate(([0], np.cumsum(fine)))[starts], number, low, batch


def term_counts(papers: DataFrame, text: str = "text", longest: int = 4, least: int = 2) -> DataFrame:
    """concept, occurrences: n-grams of up to ``longest`` words that occur at least ``least`` times."""
    runs = papers.where(~X.missing(F.col(text))).select(X.spaced_words(F.col(text)).alias("words"))

    def hashed(batches):
        for ids, _, number, *_ in _held(batches, 0):
            words = number.hashes()
            for n, _, _, first, count in _grams(ids, longest):
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(ids, words, first, n).view(np.int64)), pa.array(count)], ["hash", "n"])

    often = staged(runs.mapInArrow(hashed, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hash"))
    shared = papers.sparkSession.sparkContext.broadcast(_bitmap(often))

    def counted(batches):
        for ids, _, number, *_ in _held(batches, 0):
            words, spelled = number.hashes(), pa.array(number.words)
            for n, _, _, first, count in _grams(ids, longest):
                kept = _passing(_hashes(ids, words, first, n), shared.value)
                yield pa.RecordBatch.from_arrays([_spelled(ids, spelled, first[kept], n), pa.array(count[kept])], ["concept", "n"])

    rows = runs.mapInArrow(counted, "concept string, n long")
    return rows.groupBy("concept").agg(F.sum("n").alias("occurrences")).where(F.col("occurrences") >= least)


def term_statistics(counts: DataFrame) -> DataFrame:
    """concept, words, occurrences, longer, inside, score of ``counts(concept, occurrences)``: the longer n-grams that hold
    a concept, the sum of their occurrences, and words * (occurrences - inside / longer)."""
    words = F.split("concept", " ")
    lent = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))))
    own = counts.select("concept", "occurrences", F.lit(0).cast("long").alias("longer"), F.lit(0).cast("long").alias("inside"))
    to = counts.where(F.size(words) > 1).select(F.explode(lent).alias("concept"), F.lit(0).cast("long").alias("occurrences"), F.lit(1).cast("long").alias("longer"), F.col("occurrences").alias("inside"))
    sums = own.unionByName(to).groupBy("concept").agg(*[F.sum(c).alias(c) for c in ("occurrences", "longer", "inside")]).where("occurrences > 0")
    size = F.size(F.split("concept", " "))
    score = size * (F.col("occurrences") - F.when(F.col("longer") > 0, F.col("inside") / F.col("longer")).otherwise(F.lit(0.0)))
    return sums.select("concept", size.alias("words"), "occurrences", "longer", "inside", score.alias("score"))


def terms(papers: DataFrame, text: str = "text", longest: int = 4, least: int = 2, longer_than: int = 4) -> DataFrame:
    """The statistics of all terms: concepts of more than ``longer_than`` characters with a score above 0."""
    found = term_statistics(staged(term_counts(papers, text, longest, least)))
    return found.where((F.length("concept") > longer_than) & (F.col("score") > 0))


def term_pairs(papers: DataFrame, terms: DataFrame, text: str = "text", longest: int = 4) -> DataFrame:
    """paper, concept: the concepts of ``terms(concept)`` that a paper holds. N-grams that the terms' bitmap passes meet the
    terms by shuffle, each with the list of the papers that hold it among those that a task reads at once."""
    wanted = staged(terms.select("concept").where("concept IS NOT NULL").distinct())

    def hashed(batches):
        for batch in batches:
            number: dict[str, int] = {BREAK: 0}
            ids = np.array([number.setdefault(w, len(number)) for c in batch.column(0).to_pylist() for w in [*c.split(" "), BREAK]], np.int64)
            words = _word_hashes(number)
            ends = np.flatnonzero(ids == 0)
            starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
            for n in range(1, longest + 1):
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(ids, words, starts[ends - starts == n], n).view(np.int64))], ["hash"])

    shared = papers.sparkSession.sparkContext.broadcast(_bitmap(staged(wanted.mapInArrow(hashed, "hash long"))))

    def found(batches):
        for ids, starts, number, low, batch in _held(batches, 1):
            words, spelled = number.hashes(), pa.array(number.words)
            row = np.repeat(np.arange(len(starts)), np.diff([*starts, len(ids)]))
            for n, at, codes, first, _ in _grams(ids, longest):
                kept = _passing(_hashes(ids, words, first, n), shared.value)
                place = np.cumsum(kept) - 1
                at, codes = at[kept[codes]], codes[kept[codes]]
                pairs = np.unique(place[codes] << 32 | row[at])
                ends = np.cumsum(np.bincount(pairs >> 32, minlength=int(kept.sum())))
                holders = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), batch.column(0).take(pa.array((pairs & 0xFFFFFFFF) + low)))
                yield pa.RecordBatch.from_arrays([_spelled(ids, spelled, first[kept], n), holders], ["concept", "papers"])

    rows = papers.where(~X.missing(F.col(text))).select("paper", X.spaced_words(F.col(text)).alias("words"))
    held = rows.mapInArrow(found, f"concept string, papers array<{rows.schema['paper'].dataType.simpleString()}>")
    return held.join(wanted, "concept").select(F.explode("papers").alias("paper"), "concept")


def term_table(papers: DataFrame, terms: DataFrame, text: str = "text", longest: int = 4) -> DataFrame:
    """paper, phrases: :func:`term_pairs` as :func:`extraction.phrase_table` gives phrases; papers without any are left out."""
    return term_pairs(papers, terms, text, longest).groupBy("paper").agg(F.array_sort(F.collect_list("concept")).alias("phrases"))
