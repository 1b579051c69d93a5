"""Best-fit packing of token pieces into sequences by patterns and non-negative least squares.

Piece lengths form a histogram of at most ``capacity`` bins, whatever the corpus holds. Patterns of
a few lengths that fill a sequence well are enumerated from the lengths present; non-negative
least squares fits their repeat counts to the histogram; counts are rounded down to what the
histogram can give, and what is left is packed best-fit decreasing, by length and count, never by
piece. The plan then says, for the i-th piece of a length, its sequence and offset.

Pieces are numbered within their length over salted buckets, whose number follows that of the pieces,
so that a length which holds a third of all pieces is spread over tasks of bounded size. Where a
bucket's numbers start is summed and joined in the cluster; the driver gets the histogram only.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import new_name, quoted, shuffle_partitions, staged
from .tokens import WordBpe, load, slices, trim

CAPACITY = 2048
#: Pieces of a bucket on average, and buckets of a length at most (by then 10 ** 12 pieces of a length).
PER_BUCKET, MOST_BUCKETS = 1 << 20, 1 << 20


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut only if longer than a sequence."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        trim()
        bpe = load(WordBpe, path)
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                encoded = bpe.encode_all([t or "" for t in part.column(1).to_pylist()])
                for doc_id, ids in zip(part.column(0).to_pylist(), encoded):
                    ids += tail
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[a : a + 4 * capacity]
                        rows.append((doc_id, k, a // 4, len(cut) // 4, zlib.crc32(cut)))
                names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(present: np.ndarray, capacity: int, slack: int = 8, choices: int = 6) -> list[tuple[int, ...]]:
    """Multisets of two to five present lengths (descending) that leave at most ``slack`` free."""
    have = np.sort(present)
    fit = lambda room: int(have[i - 1]) if (i := int(np.searchsorted(have, room, "right"))) else 0
    out: set[tuple[int, ...]] = set()
    for a in have.tolist():
        seconds, room = {fit(capacity - a)}, capacity - a
        for share in np.linspace(0.2, 0.8, choices - 1):
            seconds.add(fit(int(room * share)))
        for b in seconds - {0}:
            p, room = [a, b], capacity - a - b
            while len(p) < 5 and (c := fit(room)):
                p.append(c)
                room -= c
            if room <= slack:
                out.add(tuple(sorted(p, reverse=True)))
    return sorted(out, reverse=True)


def fit_counts(pats: list[tuple[int, ...]], hist: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of the patterns' lengths to ``hist``
    (accelerated projected gradient; the matrix is kept as index pairs)."""
    if not pats:
        return np.zeros(0)
    rows = np.array([v for p in pats for v in p])
    cols = np.repeat(np.arange(len(pats)), list(map(len, pats)))
    forward = lambda x: np.bincount(rows, x[cols], len(hist))
    back = lambda r: np.bincount(cols, r[rows], len(pats))
    v = np.ones(len(pats))
    for _ in range(20):  # largest eigenvalue for the step length
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - hist) / (1.05 * top))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of the sequences that use up ``hist`` (pieces of each length) exactly."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    pats = patterns(np.flatnonzero(left), capacity)
    x = fit_counts(pats, left.astype(float))
    for k in np.argsort(-x, kind="stable"):
        need = Counter(pats[k])
        if n := min(int(np.floor(x[k] + 1e-9)), *(int(left[v]) // m for v, m in need.items())):
            out.append((pats[k], n))
            for v, m in need.items():
                left[v] -= n * m
    return out + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over (length, count); open sequences are grouped by their free room."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for v in np.flatnonzero(left)[::-1].tolist():
        count = int(left[v])
        while count:
            room = min((r for r in bins if r >= v), default=None)
            if room is None:
                each = capacity // v
                for k, n in ((each, count // each), (count % each, 1)):
                    if k and n:
                        bins[capacity - k * v].append(((v,) * k, n))
                break
            held, n = bins[room].pop()
            if not bins[room]:
                del bins[room]
            each = min(room // v, count)
            full = min(n, count // each)
            bins[room - each * v].append((held + (v,) * each, full))
            if n > full:
                bins[room].append((held, n - full))
            count -= full * each
    return [x for group in bins.values() for x in group]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The plan as sorted arrays: key (length, first number), first sequence, offset."""
    taken: Counter = Counter()
    rows, base = [], 0
    for lengths, n in planned:
        offset = 0
        for v in lengths:
            rows.append(((v << 48) + taken[v], base, offset))
            taken[v] += n
            offset += v
        base += n
    a = np.array(sorted(rows) or np.zeros((0, 3)), np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def pack(cut: DataFrame, capacity: int = CAPACITY, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``cut`` (any columns, with length, a long from 1 to ``capacity``) plus sequence_id and offset; columns
    of those names are replaced. Rows are told apart by nothing but their place, so repeated ones each
    get their own. An empty table gives an empty result."""
    cut = cut.drop("sequence_id", "offset")
    salt, bucket, nth, start = (new_name(cut, n) for n in ("salt", "bucket", "nth", "start_of"))
    kept = cut.columns
    names, schema = [*kept, "sequence_id", "offset"], StructType([*cut.schema.fields]).add("sequence_id", "long").add("offset", "long")
    salted = staged(cut.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(MOST_BUCKETS)).cast("int")))
    buckets = min(max(16, shuffle_partitions(cut.sparkSession), salted.count() // per_bucket), MOST_BUCKETS)
    salted = salted.withColumn(bucket, F.col(salt) % buckets)
    counts = staged(salted.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("n")))
    hist = np.zeros(capacity + 1, np.int64)
    for v, n in counts.groupBy("length").agg(F.sum("n")).toLocalIterator():
        hist[v] = n
    keys, first, offset = slots(plan(hist, capacity))
    earlier = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(start))

    def run(batches):
        for batch in batches:
            v, b, i = (batch.column(c).to_numpy() for c in (kept.index("length"), -2, -1))
            key = (v << 48) + b + i - 1
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(first[at] + key - keys[at]), pa.array(offset[at])], names)

    numbered = salted.withColumn(nth, F.row_number().over(Window.partitionBy("length", bucket).orderBy(salt)).cast("long"))
    # both sides lie and are sorted by length and bucket, so a merge moves only the starts, of any size
    placed = numbered.join(starts.hint("merge"), ["length", bucket]).select(*quoted(kept), start, nth)
    return placed.toDF(*[f"c{i}" for i in range(len(kept) + 2)]).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for ``docs(doc_id, text)``.

    Null and empty texts are one piece of the end id alone. Repeated rows are pieces of their own,
    each with its own place. An empty table gives an empty result; other columns are not read.
    """
    return pack(pieces(docs, path, capacity), capacity)
