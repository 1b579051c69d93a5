"""Sentences that contain terms, for vocabularies too large for one task: an index of anchor grams.

Every term is filed under one gram of four bytes (shorter terms under themselves), the one of its grams that the
texts have least. A sentence looks up its own grams; the few that are anchors of some term meet the
terms by shuffle, and each candidate is then looked for in its sentence. What all tasks share has a fixed size:
how often grams occur, by hash, and a bitmap of the anchors. Terms of ``MOST_BYTES`` together or less, ``MOST`` at most, go to all
tasks instead, which find them where the texts are: no text or candidate is shuffled or staged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.staging import packed, staged

#: Slots of the counts of grams, and bits of the anchors' bitmap, in pieces.
SLOTS, BITS, PIECE = 1 << 20, 1 << 23, 1 << 15
SIZE = 4
#: Terms and their bytes that all tasks may hold, the longest term that is compared byte by byte, and bytes of texts in one output.
MOST, MOST_BYTES, COMPARED, OUTPUT = 1 << 18, 1 << 24, 64, 1 << 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(raw: bytes, size: int) -> np.ndarray:
    """Keys of all grams of ``size`` bytes: the size and the bytes, so equal keys are equal grams."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = max(0, len(b) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out << np.uint64(8) | b[i : i + n]
    return out


def slot(keys: np.ndarray, of: int) -> np.ndarray:
    return (keys * MIX >> np.uint64(65 - of.bit_length())).astype(np.int64)


def gram_counts(split: DataFrame) -> np.ndarray:
    """How often the sentences have grams of each slot."""

    def run(batches):
        counts, held, size = np.zeros(SLOTS, np.int64), [], 0
        for batch in batches:
            for body in batch.column(0):
                held.append(slot(grams(body.as_py() or b"", SIZE), SLOTS))
                size += len(held[-1])
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, size = [], 0
        counts += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=SLOTS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["slot", "n"])

    bodies = split.select(F.lower(F.array_join("_s", "\n")).cast("binary"))
    rows = bodies.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def anchors(terms: DataFrame, counts: np.ndarray) -> DataFrame:
    """gram, concept of ``terms(concept)``: each term's rarest gram."""
    shared = terms.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            keys = []
            for term in batch.column(0).to_pylist():
                g = grams(term.encode(), min(SIZE, len(term.encode())))
                keys.append(int(g[np.lexsort((g, shared.value[slot(g, SLOTS)]))[0]]) if len(g) > 1 else int(g[0]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0)], ["gram", "concept"])

    return terms.mapInArrow(run, "gram long, concept string")


def _bitmap(filed: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bitmap of all anchors' slots, and the sizes of grams among them."""

    def run(batches):
        for batch in batches:
            at = slot(batch.column(0).to_numpy().astype(np.uint64), BITS)
            yield pa.RecordBatch.from_arrays([pa.array(at // PIECE), pa.array(at % PIECE)], ["piece", "bit"])

    out = np.zeros(BITS // 8, np.uint8)
    for r in filed.select("gram").mapInArrow(run, "piece long, bit long").groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[r.piece * PIECE // 8 : (r.piece + 1) * PIECE // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    # a key's size stands before its bytes
    size = F.when(F.col("gram") < 2 << 8, 1).when(F.col("gram") < 3 << 16, 2).when(F.col("gram") < 4 << 24, 3).otherwise(4)
    return out, sorted(r.size for r in filed.select(size.alias("size")).distinct().collect())


def _parts(sents: pa.Array, most: int = 1 << 20):
    """(some sentences, number of the first, number behind the last), each of ``most`` bytes or one sentence."""
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(sents).to_numpy(zero_copy_only=False).astype(np.int64))))
    low = 0
    while low < len(sents):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, side="right")) - 1)
        yield sents.slice(low, high - low), low, high
        low = high


def _anchored(sents: pa.Array, bits: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of grams whose slot is in the bitmap, once for each sentence that has them, and those sentences' numbers."""
    ends = np.cumsum(pc.binary_length(sents).to_numpy(zero_copy_only=False).astype(np.int64))
    raw = b"".join(sents.cast(pa.binary()).to_pylist())
    keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for size in sizes:
        k = grams(raw, size)
        places = slot(k, BITS)
        hit = np.flatnonzero(bits[places >> 3] >> (places & 7).astype(np.uint8) & 1)
        of = np.searchsorted(ends, hit, side="right")
        inside = hit + size <= ends[of]  # a gram does not reach into the next sentence
        keys.append(k[hit[inside]])
        at.append(of[inside])
    keys, at = np.concatenate(keys), np.concatenate(at)
    order = np.lexsort((keys, at))
    keys, at = keys[order], at[order]
    new = np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])))
    return keys[new], at[new]


class _Index:
    """Terms by their anchors ``grams``, for all sentences of a task."""

    def __init__(self, terms: list[str], filed: list[int]):
        order = np.argsort(np.array(filed, np.uint64), kind="stable")
        self.terms = pa.array([terms[i] for i in order], pa.string())
        self.raw = [terms[i].encode() for i in order]
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.length = np.array([len(t) for t in self.raw], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.grams, self.first, self.count = np.unique(np.array(filed, np.uint64)[order], return_index=True, return_counts=True)
        gram = np.repeat(self.grams, self.count).tolist()
        size = np.array([(g.bit_length() - 1) // 8 for g in gram], np.int64)  # a key's size stands before its bytes
        self.offset = np.array([t.index((g & (1 << 8 * k) - 1).to_bytes(k)) for t, g, k in zip(self.raw, gram, size.tolist())], np.int64)
        self.sizes = np.unique(size).tolist()
        self.bits = np.zeros(BITS // 8, np.uint8)
        at = slot(self.grams, BITS)
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def held(self, raw: bytes, ends: np.ndarray) -> np.ndarray:
        """sentence * number of terms + term, sorted, each once, of sentences that end at ``ends`` in ``raw``."""
        text, n, out = np.frombuffer(raw, np.uint8), len(self.raw), [np.zeros(0, np.int64)]
        for size in self.sizes:
            keys = grams(raw, size)
            places = slot(keys, BITS)
            hit = np.flatnonzero(self.bits[places >> 3] >> (places & 7).astype(np.uint8) & 1)
            gram = np.searchsorted(self.grams, keys[hit])
            fine = self.grams[np.minimum(gram, len(self.grams) - 1)] == keys[hit]
            hit, gram = hit[fine], gram[fine]
            count = self.count[gram]
            term = np.repeat(self.first[gram] - np.cumsum(count) + count, count) + np.arange(count.sum())
            start = np.repeat(hit, count) - self.offset[term]
            of = np.repeat(np.searchsorted(ends, hit, side="right"), count)
            fine = (start >= np.where(of > 0, ends[of - 1], 0)) & (start + self.length[term] <= ends[of])
            term, start, of = term[fine], start[fine], of[fine]
            long = self.length[term] > COMPARED
            pairs = np.unique(of[long] * n + term[long])
            low = np.concatenate(([0], ends))
            out.append(pairs[[self.raw[p % n] in raw[low[p // n] : low[p // n + 1]] for p in pairs.tolist()]] if len(pairs) else pairs)
            term, start, of, at = term[~long], start[~long], of[~long], 0
            while len(term):
                done = self.length[term] == at
                out.append(of[done] * n + term[done])
                term, start, of = term[~done], start[~done], of[~done]
                same = text[start + at] == self.bytes[self.begin[term] + at]
                term, start, of, at = term[same], start[same], of[same], at + 1
        return np.unique(np.concatenate(out))


def _rows_in_place(keys: pa.Array, sents: pa.ListArray, low: pa.ListArray, index: _Index):
    """key, concept, sentences of some papers."""
    sizes = np.diff(sents.offsets.to_numpy())
    values, lowered, n = sents.flatten(), low.flatten(), len(index.raw)
    ends = np.cumsum(pc.binary_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64))
    pairs = index.held(b"".join(lowered.cast(pa.binary()).to_pylist()), ends)
    at, term = pairs // n, pairs % n
    row = np.repeat(np.arange(len(sizes)), sizes)[at] * n + term
    order = np.argsort(row, kind="stable")
    at, row = at[order], row[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), row[1:] != row[:-1])))
    length = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)[at]
    upto = np.append(np.concatenate(([0], np.cumsum(length)))[new], length.sum())
    bounds, i = np.append(new, len(row)), 0
    while i < len(new):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + OUTPUT, side="right")) - 1)
        lists = pa.ListArray.from_arrays(pa.array((bounds[i : j + 1] - bounds[i]).astype(np.int32)), values.take(pa.array(at[bounds[i] : bounds[j]])))
        which = row[new[i:j]]
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(which // n)), index.terms.take(pa.array(which % n)), pc.binary_join(lists, X.CELL)], ["_key", "concept", "sentences"])
        i = j


def _match_in_place(split: DataFrame, index: _Index) -> DataFrame:
    """Rows of :func:`match_vocabulary` where the texts are."""
    shared = split.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            sents, low = batch.column(1), batch.column(2)
            begin = low.offsets.to_numpy()
            size = np.concatenate(([0], np.cumsum(pc.binary_length(low.flatten()).to_numpy(zero_copy_only=False).astype(np.int64))))
            ends, i = size[begin - begin[0]], 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + (1 << 20), side="right")) - 1)
                yield from _rows_in_place(batch.column(0).slice(i, j - i), sents.slice(i, j - i), low.slice(i, j - i), shared.value)
                i = j

    kind = split.schema["_key"].dataType.simpleString()
    return split.select("_key", "_s", F.transform("_s", F.lower).alias("_l")).mapInArrow(run, f"_key {kind}, concept string, sentences string")


def match_vocabulary(papers: DataFrame, terms: DataFrame, text: str = "text", key: str = "paper") -> DataFrame:
    """key, concept, sentences: as :func:`matrix.match_tall`, for ``terms(concept)`` of any number.

    Null and empty terms and texts match nothing, repeated terms count once; papers that share a key are papers of
    their own. Sentences are in the text's order.
    """
    spark = papers.sparkSession
    split = papers.where(~X.missing(F.col(text))).select(F.col(key).alias("_key"), X.sentences(F.col(text)).alias("_s"))
    wanted = staged(terms.select("concept").where(~X.missing(F.col("concept"))).distinct())
    n, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("concept")), F.lit(0))).first()
    if 0 < n <= MOST and size <= MOST_BYTES:
        filed = anchors(wanted, gram_counts(split)).toArrow()
        index = _Index(filed.column("concept").to_pylist(), filed.column("gram").to_pylist())
        return _match_in_place(split, index).withColumnRenamed("_key", key)
    split, _ = packed(split.withColumn("_id", F.monotonically_increasing_id()))
    filed = staged(anchors(wanted, gram_counts(split)))
    bits, sizes = _bitmap(filed)
    shared = spark.sparkContext.broadcast(bits)

    def look(batches):
        for batch in batches:
            lists = batch.column(1)
            owner = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            place = np.arange(len(owner)) - np.repeat(lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0], np.diff(lists.offsets.to_numpy()))
            for sents, low, high in _parts(lists.flatten()):
                keys, at = _anchored(sents, shared.value, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(owner[low:high][at]), pa.array(place[low:high][at].astype(np.int32)), pa.array(keys.astype(np.int64))], ["_id", "at", "gram"])

    rows = split.select("_id", F.transform("_s", F.lower)).mapInArrow(look, "_id long, at int, gram long")
    # one shuffle by paper does for both groupings; a paper's hits are put together in its own row
    pairs = rows.join(filed, "gram").select("_id", "concept", "at").repartition("_id").groupBy("_id", "concept").agg(F.array_sort(F.collect_set("at")).alias("at"))
    candidates = pairs.groupBy("_id").agg(F.collect_list(F.struct("concept", "at")).alias("c"))
    held = lambda c: F.filter(F.transform(c["at"], lambda i: F.get("_s", i)), lambda s: F.contains(F.lower(s), c["concept"]))
    seen = F.filter(F.transform("c", lambda c: F.struct(c["concept"].alias("concept"), held(c).alias("s"))), lambda m: F.size(m["s"]) > 0)
    return split.join(candidates, "_id").select("_key", F.explode(seen).alias("m")).select(F.col("_key").alias(key), "m.concept", F.array_join("m.s", X.CELL).alias("sentences"))
