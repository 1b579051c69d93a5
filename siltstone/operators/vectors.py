"""Word vectors learned from a collection, for what sentence embeddings do elsewhere.

Words that stand near the same words get near vectors: counts of neighbours within a window, weighted by
how much more often than by chance two words meet (positive pointwise mutual information), and the
matrix of these weights factored by a randomised method. The counts are over all texts. The vocabulary is a
parameter of the model and bounded, as a language model's is; so are the vectors, which alone reach the
driver and are broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.staging import staged

WORD = re.compile(r"[^\W_][\w-]*")
#: Words of a model at most, numbers of a vector, and neighbours on either side.
MOST, SIZE, WINDOW = 32_768, 64, 4


def words(text):
    """Words of a text, lower-cased, without stop words, in order (a column)."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}_-]*)"))
    return F.filter(found, lambda w: ~w.isin(*sorted(X.STOP_WORDS)) & (F.length(w) > 1))


def vocabulary(texts: DataFrame, text: str = "text", least: int = 2, most: int = MOST) -> DataFrame:
    """word, n, number: words of at least ``least`` occurrences, the ``most`` most frequent of them, numbered by rank."""
    counts = texts.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    best = counts.orderBy(F.desc("n"), "word").limit(most).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "word"))).alias("all"))
    return best.select(F.posexplode("all").alias("number", "w")).select("w.word", (-F.col("w.less")).alias("n"), "number")


def neighbour_counts(texts: DataFrame, numbers: dict[str, int], text: str = "text", window: int = WINDOW) -> DataFrame:
    """a, b, n: how often words a and b (by number, both ways) stand within ``window`` words of each other. Words outside
    the vocabulary keep their place. Each task adds up the pairs of a batch before the shuffle."""
    shared = texts.sparkSession.sparkContext.broadcast(numbers)

    def pairs(flat: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(flat), return_counts=True) if flat else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    def run(batches):
        number, flat, held = shared.value, [], 0
        for batch in batches:
            for body in batch.column(0):
                code = np.array([number.get(w, -1) for w in WORD.findall((body.as_py() or "").lower()) if w not in X.STOP_WORDS and len(w) > 1], np.int64)
                for k in range(1, min(window, len(code) - 1) + 1):
                    a, b = code[:-k], code[k:]
                    fine = (a >= 0) & (b >= 0)
                    flat += [a[fine] << 32 | b[fine], b[fine] << 32 | a[fine]]
                    held += 2 * len(a)
                if held > 1 << 22:
                    yield pairs(flat)
                    flat, held = [], 0
        yield pairs(flat)

    return texts.select(text).mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def weights(counts: DataFrame) -> DataFrame:
    """a, b, weight: positive pointwise mutual information of ``counts(a, b, n)``, a symmetric table."""
    sums = counts.groupBy("a").agg(F.sum("n").alias("s"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    both = counts.join(sums, "a").join(sums.select(F.col("a").alias("b"), F.col("s").alias("t")), "b")
    weight = F.log(F.col("n") * F.lit(float(total)) / (F.col("s").cast("double") * F.col("t")))
    return both.select("a", "b", weight.alias("weight")).where("weight > 0")


def times(matrix: DataFrame, right: np.ndarray) -> np.ndarray:
    """The product of ``matrix(a, b, weight)``, each row's entries in one task, and a bounded dense matrix."""
    shared = matrix.sparkSession.sparkContext.broadcast(right)

    def run(batches):
        x, held = shared.value, {}
        for batch in batches:
            a, b, w = (batch.column(i).to_numpy() for i in range(3))
            order = np.argsort(a, kind="stable")
            a, part = a[order], x[b[order]] * w[order][:, None]
            starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            for row, v in zip(a[starts].tolist(), np.add.reduceat(part, starts)):
                held[row] = held[row] + v if row in held else v
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["a", "v"])

    out = np.zeros_like(right)
    found = matrix.mapInArrow(run, "a int, v binary").toArrow()
    for row, v in zip(found.column("a").to_pylist(), found.column("v").to_pylist()):
        out[row] += np.frombuffer(v)
    shared.unpersist()
    return out


def factor(matrix: DataFrame, n: int, size: int, rounds: int = 3, extra: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(vectors n x size, eigenvalues): the eigenvectors of largest eigenvalues (by absolute value) of a symmetric matrix
    by a randomised block method: a random block, multiplied and made orthogonal ``rounds`` times, holds them nearly;
    the small matrix that it makes of the large one is solved on the driver."""
    wide = min(n, size + extra)
    q, _ = np.linalg.qr(np.random.default_rng(11).normal(size=(n, wide)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(times(matrix, q))
    small = q.T @ times(matrix, q)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-np.abs(values))[: min(size, wide)]
    return q @ turned[:, best], values[best]


@dataclass
class WordVectors:
    """Texts -> unit vectors: the sum of their words' vectors, rarer words weighing more, for ``extraction.Offline(embed=…)``. A text
    without a known word has the zero vector."""

    shared: Broadcast = field(repr=False)

    def __call__(self, texts: list[str]) -> np.ndarray:
        number, vectors = self.shared.value
        out = np.zeros((len(texts), vectors.shape[1]))
        for i, t in enumerate(texts):
            known = [number[w] for w in WORD.findall(t.lower()) if w in number]
            if known:
                out[i] = vectors[known].sum(axis=0)
        return _unit(out)

    def ngrams(self, words: list[str], start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same of the texts that ``n`` lower-cased words make from place ``start`` on: each word is looked up once,
        and a sum adds one word to that of a shorter text."""
        number, vectors = self.shared.value
        out = np.zeros((len(start), vectors.shape[1]))
        at = np.array([number.get(w, -1) for w in words], np.int64)
        each = vectors[at]
        each[at < 0] = 0
        sums = each
        for k in range(1, int(n.max(initial=0)) + 1):
            if k > 1:
                sums = sums[:-1] + each[k - 1 :]
            out[n == k] = sums[start[n == k]]
        return _unit(out)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def learn(texts: DataFrame, text: str = "text", size: int = SIZE, least: int = 2, most: int = MOST, window: int = WINDOW) -> WordVectors:
    """Vectors of the words of all ``texts``."""
    spark: SparkSession = texts.sparkSession
    rows = vocabulary(texts, text, least, most).collect()
    number = {r.word: r.number for r in rows}
    counts = staged(neighbour_counts(texts, number, text, window))
    matrix = staged(weights(counts).repartition("a"))
    vectors, values = factor(matrix, max(1, len(number)), size)
    n = np.array([r.n for r in rows] or [1], np.float64)
    rare = 1 / (1 + n / n.sum() / 1e-3)
    vectors = vectors * np.sqrt(np.abs(values)) * rare[:, None]
    return WordVectors(spark.sparkContext.broadcast((number, vectors)))
