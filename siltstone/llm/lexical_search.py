"""Ranked lexical search by sort-based accumulation.

1. Every document's terms are counted in its own task. What leaves it are blocks of postings, sorted
   by term, of the terms that some item may hold: a bitmap of the items' terms, of a fixed size
   whatever their number, goes to all tasks, and the terms themselves are compared later on. Totals
   and the documents of a term are summed from the blocks.
2. Items and postings meet in the cells of a grid. The key space (item, document) is thereby cut
   into ranges: a pair's impacts all lie in one cell, so its sum is final there.
3. A cell concatenates, for some items at a time, the arrays of matched (item, document, impact),
   packs item and document into one 32-bit key, radix-sorts the keys by their two 16-bit digits and
   sums the runs of equal keys with ``numpy.add.reduceat``. Of each item the best stay in a heap.
4. The cells' best are ranked by a window, cut to k before its shuffle, too.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

#: Bits of the items' terms, a power of two: 1 MB, in pieces of ``PIECE`` bits.
BITS, PIECE = 1 << 23, 1 << 15
#: Postings and documents of a block at most (a document is never cut), items of a block, and
#: document blocks of a cell at most on average.
POSTINGS, DOCS, ITEMS, CELL = 1 << 18, 1 << 16, 512, 8
#: Matched impacts that are sorted at a time, unless one item has more.
SORTED = 1 << 21
#: Bytes that are part of no term become blanks, A-Z become small; all other bytes stay.
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Stands for a null id; never returned.
NO_ID = -(1 << 63)
BLOCK = "terms array<string>, holders array<long>, ids binary, sizes binary, ends binary, docs binary, counts binary, n_docs long, n_terms long"
SCHEMA = pa.schema([("terms", pa.list_(pa.string())), ("holders", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("ids", "sizes", "ends", "docs", "counts")], ("n_docs", pa.int64()), ("n_terms", pa.int64())])


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, repeats included; a null has none."""
    return text.translate(FOLD).split() if text else []


def _items(items: DataFrame) -> DataFrame:
    """uid, item_id, term, times: the items' distinct terms. Each row is an item of its own."""

    def run(batches):
        for batch in batches:
            uid, item, term, times = [], [], [], []
            for u, i, text in zip(*(batch.column(n).to_pylist() for n in range(3))):
                for t, n in Counter(terms_of(text)).items():
                    uid.append(u), item.append(i), term.append(t.decode()), times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(item, pa.int64()), pa.array(term, pa.string()), pa.array(times, pa.int64())], ["uid", "item_id", "term", "times"])

    rows = items.where("item_id IS NOT NULL").select(F.monotonically_increasing_id().alias("uid"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return staged(rows.mapInArrow(run, "uid long, item_id long, term string, times long"))


def _bitmap(asked: DataFrame) -> np.ndarray:
    """One byte for each eight slots: the slots of all terms asked for."""
    slot = F.pmod(F.xxhash64("term"), F.lit(BITS))
    pieces = asked.select(F.floor(slot / PIECE).alias("piece"), (slot % PIECE).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in pieces.collect():
        out[r.piece * PIECE // 8 : (r.piece + 1) * PIECE // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


class Postings:
    """A block being filled: documents with the counts of their terms."""

    def __init__(self):
        self.code: dict[bytes, int] = {}
        self.ids, self.sizes, self.n_docs, self.n_terms = [], [], 0, 0
        self.term, self.doc, self.count = [], [], []

    def add(self, doc_id, words: list[bytes], wanted) -> None:
        if not words:
            return
        self.n_docs += 1
        self.n_terms += len(words)
        found = [(self.code.setdefault(w, len(self.code)), n) for w, n in Counter(words).items() if wanted(w)]
        if found:
            self.term += [c for c, _ in found]
            self.count += [n for _, n in found]
            self.doc += [len(self.ids)] * len(found)
            self.ids.append(doc_id)
            self.sizes.append(len(words))

    def row(self) -> pa.RecordBatch:
        term, doc, count = np.array(self.term, np.int64), np.array(self.doc, "<u2"), np.array(self.count, "<i8")
        order = np.argsort(term, kind="stable")
        holders = np.bincount(term, minlength=len(self.code))
        raw = (np.array(self.ids, "<i8"), np.array(self.sizes, "<i8"), np.cumsum(holders).astype("<i8"), doc[order], count[order])
        return pa.RecordBatch.from_pylist([{"terms": [t.decode() for t in self.code], "holders": holders.tolist(), **{n: x.tobytes() for n, x in zip(("ids", "sizes", "ends", "docs", "counts"), raw)}, "n_docs": self.n_docs, "n_terms": self.n_terms}], SCHEMA)


def postings(docs: DataFrame, bits: np.ndarray, most: int = POSTINGS, most_docs: int = DOCS, hold: int = 500_000) -> DataFrame:
    """Blocks of postings of ``docs(doc_id, text)``, numbered ``block``; a null id becomes ``NO_ID``."""
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches):
        known: dict[bytes, bool] = {}
        table = shared.value

        def wanted(word: bytes) -> bool:
            if (found := known.get(word)) is None:
                if len(known) >= hold:
                    known.clear()
                slot = xxhash.xxh64_intdigest(word, 42) & (BITS - 1)
                found = known[word] = bool(table[slot >> 3] >> (slot & 7) & 1)
            return found

        block = Postings()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc_id, terms_of(text.as_py()), wanted)
                if len(block.term) >= most or len(block.ids) == most_docs:
                    yield block.row()
                    block = Postings()
        if block.n_docs:
            yield block.row()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return staged(rows.mapInArrow(run, BLOCK).withColumn("block", F.monotonically_increasing_id()))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of 32-bit keys: by their lower, then by their upper 16 bits; for numbers of 16 bits
    numpy's stable sort is a radix sort."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    return order[np.argsort((keys >> 16).astype(np.uint16)[order], kind="stable")]


def accumulate(keys: list[np.ndarray], impacts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their impacts."""
    key, impact = np.concatenate(keys), np.concatenate(impacts)
    order = radix_order(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[starts], np.add.reduceat(impact[order], starts)


class Best:
    """The k best (score, document) of one item: a heap whose root is the worst of them."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.heap) == self.k:
            fine = scores >= self.heap[0][0]
            ids, scores = ids[fine], scores[fine]
        if len(scores) > 4 * self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= least], scores[scores >= least]
        for s, i in zip(scores.tolist(), ids.tolist()):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (s, -i))
            elif (s, -i) > self.heap[0]:
                heapq.heapreplace(self.heap, (s, -i))


def _search(k: int, n: int, total: int, at_once: int):
    def block_of(row):
        """term -> its postings, and for each posting its document's place and its impact at weight one."""
        ids, sizes, ends, counts = (np.frombuffer(row[c], "<i8") for c in ("ids", "sizes", "ends", "counts"))
        docs = np.frombuffer(row["docs"], "<u2")
        m = 25 + 75 * sizes * n // total
        at = dict(zip(row["terms"], zip([0, *ends.tolist()], ends.tolist())))
        return ids, docs, 1_000_000_000 * counts // (1000 * counts + 8 * m[docs]), at

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        items = left.to_pylist()
        best = [Best(k) for _ in items]
        for r in range(right.num_rows):
            ids, docs, impact, at = block_of(right.slice(r, 1).to_pylist()[0])
            keys, impacts, held, first = [], [], 0, 0

            def settle(first, keys, impacts, ids=ids):
                key, score = accumulate(keys, impacts)
                item, doc = first + (key >> 16).astype(np.int64), ids[key & 0xFFFF]
                fine = (score > 0) & (doc != NO_ID)
                item, doc, score = item[fine], doc[fine], score[fine]
                cuts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.zeros(0, np.int64)
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(item)]):
                    best[item[a]].add(doc[a:b], score[a:b])

            for i, item in enumerate(items):
                for term in item["terms"]:
                    if (span := at.get(term["term"])) and term["weight"]:
                        a, b = span
                        keys.append(docs[a:b].astype(np.uint32) | np.uint32(i - first << 16))
                        impacts.append(impact[a:b] * term["weight"])
                        held += b - a
                if held >= at_once or i - first == 0xFFFF:
                    settle(first, keys, impacts)
                    keys, impacts, held = [], [], 0
                if not keys:
                    first = i + 1
            if keys:
                settle(first, keys, impacts)
        rows = [(item["uid"], item["item_id"], -i, s) for item, b in zip(items, best) for s, i in b.heap]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, ["uid", "item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, best first,
    ties by doc_id.

    Null and empty texts have no terms: such documents count nowhere, such items have no rows. Rows
    that repeat an id are documents, or items, of their own, so a rank is unique for an item's row.
    Documents without an id count in all statistics but are never returned; items without one are
    not asked. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = _items(items)
    blocks = postings(docs, _bitmap(asked), POSTINGS, DOCS)
    sums = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("terms"), F.count(F.lit(1)).alias("blocks"), F.max(F.shiftright("block", 33)).alias("last")).first()
    n, total = sums.n or 0, max(1, sums.terms or 0)
    holders = blocks.select(F.inline(F.arrays_zip("terms", "holders"))).groupBy(F.col("terms").alias("term")).agg(F.sum("holders").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(holders, "term").groupBy("uid", "item_id").agg(F.collect_list(F.struct("term", (weight * F.col("times")).alias("weight"))).alias("terms"))
    weighted = staged(weighted)
    down = max(1, -(-weighted.count() // ITEMS))
    across = max(1, min(sums.blocks, max(-(-sums.blocks // CELL), 2 * shuffle_partitions(spark))))
    along = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # the blocks of the i-th task are i, i + tasks, i + 2 * tasks, ...: dealt in turn, cells get equally many
    number = F.shiftright("block", 33) + F.col("block").bitwiseAND((1 << 33) - 1) * ((sums["last"] or 0) + 1)
    left = weighted.select(F.pmod(F.xxhash64("uid"), F.lit(down)).cast("int").alias("i"), along(across).alias("j"), "uid", "item_id", "terms")
    right = blocks.select(along(down).alias("i"), (number % across).cast("int").alias("j"), "terms", "ids", "sizes", "ends", "docs", "counts")
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_search(k, n, total, SORTED), "uid long, item_id long, doc_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS.format(text="text")} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS nd, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS.format(text="text")}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, term, len(any_value(t))::BIGINT AS n, count(*)::BIGINT AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), s),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
