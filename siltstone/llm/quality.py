"""Document quality by Bradley-Terry pairwise ranking.

Each document has a feature vector of its text. The chance that document a is preferred to b is the
logistic function of the difference of their scores, and scores are linear in the features, so
learning from preference pairs is logistic regression on feature differences without a constant.
Pairs are drawn between good and bad labelled documents. The cut is the quantile of the training
scores that the share of bad labels gives; the published score is the logistic function of the
distance to it.

All labelled rows are fitted, and every pair of a good and a bad one counts: the loss of a pair depends on
its two scores only, so rows of one kind whose scores are a sixty-fourth apart at most are added up, and sums meet
sums on the driver. Their number depends on the range of the scores, not on the rows. Sums are of whole numbers,
so the order of rows changes nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import held_out, staged

PAIRS, RIDGE = 40_000, 1e-3
#: Bins of scores to one unit, and the units in which standardised features are whole numbers: of a sum, of a product.
BINS, UNIT, COARSE = 64, 1 << 24, 1 << 8
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
UPPER, DIGITS, SPACES = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c"
MARKS = [b"!", b"?", b".", b",", b"|", b"#", b"$", b"%", b"&", b"*", b":", b";", b"/", b"<", b"@", b"-", b"_", b"="]
N_FEATURES = 17 + len(MARKS)


def features(text: bytes) -> list[float]:
    """Fixed-length description of the whole text: shares of kinds of characters, shape and variety
    of words and lines. No label, language, source or id enters."""
    n = len(text)
    size = max(n, 1)
    count = lambda kinds: n - len(text.translate(None, kinds))
    words = text.split()
    w = max(len(words), 1)
    tally = Counter(words)
    top = [c for _, c in tally.most_common(5)]
    lines = text.split(b"\n")
    line_tally = Counter(lines)
    letters, upper = count(LETTERS), count(UPPER)
    ends = sum(1 for x in lines if x[-1:] in (b".", b"!", b"?"))
    titled = sum(1 for x in words if 65 <= x[0] <= 90)
    marked = sum(1 for x in words if 33 <= x[-1] <= 47)
    out = [
        np.log1p(n), np.log1p(len(words)), letters / size, upper / max(letters, 1), count(DIGITS) / size, count(SPACES) / size,
        sum(map(len, words)) / w, len(tally) / w, (top[0] if top else 0) / w, sum(top) / w, len(line_tally) / len(lines),
        max(line_tally.values()) / len(lines), np.log1p(n / len(lines)), ends / len(lines), titled / w, marked / w, float(n == 0),
    ]
    return out + [np.sqrt(text.count(m) / size) for m in MARKS]


def _features_of(docs: DataFrame) -> DataFrame:
    def run(batches):
        tokens.forget()
        for batch in batches:
            x = [features(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != 1], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    return docs.select("doc_id", F.col("text").cast("binary"), "quality").mapInArrow(run, "doc_id long, quality int, x array<double>")


class Ranker:
    """Bradley-Terry weights over standardised features, and the cut. Made directly, it is fitted to ``pairs`` drawn
    pairs of rows in memory; :func:`fit` takes all pairs of a table."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 20):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._standard(x)
        rng = np.random.default_rng(seed)
        a, b = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
        d, w = z[a] - z[b], np.zeros(x.shape[1])
        for _ in range(25):  # Newton steps on the mean logistic loss of the differences
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            grad = d.T @ (p - 1) / pairs + RIDGE * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        scores = np.sort(z @ w)
        # the quantile of the bad share, in the middle of the gap between the scores at both its sides
        bad = min(max(int((~good).sum()), 1), len(scores) - 1)
        self.cut = float(scores[bad - 1] + scores[bad]) / 2

    @classmethod
    def of(cls, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float) -> Ranker:
        made = cls.__new__(cls)
        made.mean, made.scale, made.weights, made.cut = mean, scale, weights, cut
        return made

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._standard(x) @ self.weights - self.cut, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Ranker | None:
    """A ranker from all labelled rows that are not held out. None if the labels do not hold both kinds."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).alias("quality")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # only the features meet the labels, no text is shuffled
    rows = staged(_features_of(ids).drop("quality").join(known, "doc_id").select((F.col("quality") == 1).alias("good"), "x"))
    n, n_good, *sums = _moments(rows, [0.0] * N_FEATURES, 1)
    if not 0 < n_good < n:
        return None
    mean = np.array(sums) / n
    scale = np.sqrt(np.array(_moments(rows, mean.tolist(), 2)[2:]) / n) + 1e-9
    w = _weights(rows, mean, scale)
    return Ranker.of(mean, scale, w, _cut(rows, mean, scale, w, n - n_good))


def _moments(rows: DataFrame, centre: list[float], power: int) -> list:
    """Rows, good rows, and each feature's sum of powers of the distance from its centre, as decimals."""
    far = lambda i: F.pow(F.get("x", F.lit(i)) - F.lit(centre[i]), F.lit(power)).cast("decimal(38,12)")
    out = rows.agg(F.count(F.lit(1)), F.count_if("good"), *[F.sum(far(i)) for i in range(N_FEATURES)]).first()
    return [*out[:2], *(float(x or 0) for x in out[2:])]


def _over(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, of: Callable, schema: str) -> DataFrame:
    """What ``of(good, z, scores)`` gives for batches of ``rows(good, x)``. The standardised features are whole numbers of
    units, and a row's score is the same wherever it stands."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(-1, N_FEATURES)
                z = np.rint(np.clip((x - mean) / scale, -8, 8) * UNIT)
                scores = np.zeros(len(z))
                for i in range(N_FEATURES):
                    scores += z[:, i] * (w[i] / UNIT)
                yield of(batch.column(0).to_numpy(zero_copy_only=False), z, scores)

    return rows.mapInArrow(run, schema)


def _bins(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """good -> (bins in order, rows in each, sums of their standardised features)."""

    def sums(good, z, scores):
        keys, at = np.unique(np.floor(scores * BINS).astype(np.int64) * 2 + good, return_inverse=True)
        parts = [np.bincount(at, minlength=len(keys)), *(np.bincount(at, z[:, i]).astype(np.int64) for i in range(N_FEATURES))]
        return pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, parts)], ["key", *names])

    names = ["n", *(f"z{i}" for i in range(N_FEATURES))]
    found = _over(rows, mean, scale, w, sums, "key long, " + ", ".join(f"{c} long" for c in names)).groupBy("key").agg(*[F.sum(c).alias(c) for c in names]).toArrow().sort_by("key")
    key, n, *z = (c.to_numpy() for c in found.columns)
    z = np.stack(z, axis=1) / UNIT
    return {g: (key[key % 2 == g] >> 1, n[key % 2 == g], z[key % 2 == g]) for g in (True, False)}


def _weights(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Newton steps on the mean logistic loss over all pairs of a good and a bad row."""
    w = np.zeros(N_FEATURES)
    for _ in range(25):
        bins = _bins(rows, mean, scale, w)
        (_, n_good, z_good), (_, n_bad, z_bad) = bins[True], bins[False]
        at_good, at_bad = z_good @ w / n_good, z_bad @ w / n_bad
        pairs = float(n_good.sum()) * float(n_bad.sum())
        grad, cross = RIDGE * w, np.zeros((len(w), len(w)))
        curve = {True: np.zeros(len(n_good)), False: np.zeros(len(n_bad))}  # a row's mean curvature against all of the other kind
        slope = np.zeros(len(n_bad))
        for a in range(0, len(n_good), 256):  # some bins of good rows with all bins of bad ones
            part = slice(a, a + 256)
            p = 1 / (1 + np.exp(-np.clip(at_good[part, None] - at_bad, -30, 30)))
            grad = grad + z_good[part].T @ ((p - 1) @ n_bad) / pairs
            slope += n_good[part] @ (p - 1)
            p *= 1 - p
            cross += z_good[part].T @ (p @ z_bad) / pairs
            curve[True][part] = p @ n_bad / n_bad.sum()
            curve[False] += n_good[part] @ p / n_good.sum()
        grad = grad - z_bad.T @ slope / pairs
        square = _squares(rows, mean, scale, w, {g: (bins[g][0], curve[g] * (n_good.sum() + n_bad.sum()) / bins[g][1].sum()) for g in bins}) / (n_good.sum() + n_bad.sum())
        step = np.linalg.solve(square - cross - cross.T + RIDGE * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _squares(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, curve: dict[bool, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum of curvature times feature times feature over all rows, in coarse units: it shapes a step only."""
    shared = rows.sparkSession.sparkContext.broadcast({g: (bins, np.rint(c * 1024)) for g, (bins, c) in curve.items()})

    def products(good, z, scores):
        z, at, c = np.rint(z * (COARSE / UNIT)), np.floor(scores * BINS).astype(np.int64), np.zeros(len(z))
        for g, (bins, curve) in shared.value.items():
            c[good == g] = curve[np.searchsorted(bins, at[good == g])]
        found = ((z * c[:, None]).T @ z).astype(np.int64).ravel()  # whole numbers, mostly below 2^53: exact in any order
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], ["at", "v"])

    found = _over(rows, mean, scale, w, products, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow().sort_by("at")
    return found.column("v").to_numpy().reshape(len(w), -1) / (1024.0 * COARSE**2)


def _cut(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, bad: int) -> float:
    """The middle between the scores of ranks ``bad`` and ``bad + 1``: the bin that holds the rank is divided until all
    scores in it are equal."""
    scores = _over(rows, mean, scale, w, lambda good, z, scores: pa.RecordBatch.from_arrays([pa.array(scores)], ["s"]), "s double")
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    below = 0
    while low < high:
        at = F.least(F.floor((F.col("s") - low) / F.lit(high - low) * 4096), F.lit(4095))
        found = scores.where(F.col("s").between(low, high)).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()
        for b in sorted(found, key=lambda r: r["at"]):
            if below + b.n >= bad:
                low, high = b.low, b.high
                break
            below += b.n
    upto, above = scores.agg(F.count_if(F.col("s") <= low), F.min(F.when(F.col("s") > low, F.col("s")))).first()
    return low if upto > bad or above is None else (low + above) / 2


def score(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text)``.

    Null texts count as empty and are scored too. Repeated rows get equal scores. Without a ranker
    (no labels of both kinds) every score is 0.5. An empty table gives an empty result; other
    columns are not read.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array([features(t.as_py() or b"") for t in part.column(1)])
                s = ranker(x) if ranker else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """The rows of ``docs`` that are predicted good, all columns: a narrow filter, no join."""

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens.forget()
        for text in texts:
            x = np.array([features((t or "").encode()) for t in text]).reshape(len(text), N_FEATURES)
            yield pd.Series(ranker(x) if ranker else np.full(len(x), 0.5))

    return docs.where(of(F.col("text")) >= 0.5)
