"""Approximate nearest neighbours by learned partitions.

1. On a bounded sample of the distinct vectors the graph of nearest neighbours is cut into equal parts that few of
   its edges cross: each part is halved along its main direction and the halves exchange the nodes
   that gain most, until there are as many parts as the input asks for.
2. A small network learns to tell a vector's part, from the parts of its neighbours in the graph. Every
   row of the table is put into its most probable part; a query goes to its most probable parts, as
   many as it took for held-out vectors of the sample to find the wanted share of their neighbours.
3. Queries and candidates meet by part, first in each query's most probable part, then in its others, where only
   candidates count that reach the last of the best found first. Large parts are cut into blocks of bounded
   size that all queries of the part visit. Scores are exact: a product in double precision, with its terms
   added in order, of the original vectors. A query's best over its parts are ranked by a window.

Equal vectors are searched once: a distinct vector carries its smallest ids, one more than is asked for, as
no other can be among a query's nearest; and queries with equal vectors are asked together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows of the sample at most, of them for the network's fit (the rest is held out), and neighbours of a node.
SAMPLE, FITTED, NEAR = 8192, 7168, 16
#: Distinct vectors of a part on average, parts at most, and candidates of a block on average.
PART, MOST_PARTS, BLOCK = 2048, 256, 2048
#: Share of the held-out vectors' neighbours that their parts must hold; from 1 on, all parts are visited.
RECALL = 0.95


def nearest(queries: np.ndarray, among: np.ndarray, k: int, own: bool = False) -> np.ndarray:
    """Places of the k rows of largest inner product for each query; with ``own`` the query's own place is left out."""
    out = np.zeros((len(queries), k), np.int64)
    for at in range(0, len(queries), 512):
        s = queries[at : at + 512] @ among.T
        if own:
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _halve(x: np.ndarray, nodes: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 12) -> np.ndarray:
    """True for one half of ``nodes``; ``a``, ``b`` are the ends (places in ``nodes``) of the edges between them."""
    own = x[nodes] - x[nodes].mean(axis=0)
    direction = np.linspace(1, 2, own.shape[1])
    for _ in range(10):
        direction = own.T @ (own @ direction)
        direction /= max(np.linalg.norm(direction), 1e-30)
    side = np.zeros(len(nodes), bool)
    side[np.argsort(own @ direction, kind="stable")[len(nodes) // 2 :]] = True
    for _ in range(rounds):
        pull = np.bincount(a, np.where(side[b] == side[a], -1.0, 1.0), len(nodes))  # what its move would save
        left, right = (s[np.argsort(-pull[s], kind="stable")] for s in (np.flatnonzero(side), np.flatnonzero(~side)))
        n = min(len(left), len(right))
        gain = pull[left[:n]] + pull[right[:n]]
        n = int((gain > 0).sum() * 0.5)  # all at once would swing back
        if not n:
            break
        side[left[:n]], side[right[:n]] = False, True
    return side


def balanced_parts(x: np.ndarray, near: np.ndarray, depth: int) -> np.ndarray:
    """Part (0 to 2^depth - 1) of each row: equal parts of the graph of ``near``, halved ``depth`` times."""
    part = np.zeros(len(x), np.int64)
    a, b = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    place = np.zeros(len(x), np.int64)
    for _ in range(depth):
        inside = part[a] == part[b]
        a, b = a[inside], b[inside]
        new = 2 * part
        for p in range(part.max(initial=0) + 1):
            nodes = np.flatnonzero(part == p)
            place[nodes] = np.arange(len(nodes))
            edges = part[a] == p
            new[nodes[_halve(x, nodes, place[a[edges]], place[b[edges]])]] += 1
        part = new
    return part


class Router:
    """Probabilities of parts: one hidden layer, fitted by gradient steps with momentum and step sizes (Adam)."""

    def __init__(self, width: int, parts: int, hidden: int = 128):
        r = np.random.default_rng(12)
        self.w = [r.normal(0, (2 / width) ** 0.5, (width, hidden)), np.zeros(hidden), r.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
        self.scale = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, wanted: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 2e-3) -> Router:
        self.scale = (x.shape[1] / max(float((x * x).sum(axis=1).mean()), 1e-30)) ** 0.5
        r = np.random.default_rng(13)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                inputs = x[rows] * self.scale
                hidden = np.maximum(inputs @ self.w[0] + self.w[1], 0)
                out = hidden @ self.w[2] + self.w[3]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                error = (out / out.sum(axis=1, keepdims=True) - wanted[rows]) / len(rows)
                back = (error @ self.w[2].T) * (hidden > 0)
                t += 1
                for i, g in enumerate((inputs.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))):
                    g = g + 1e-5 * self.w[i]
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    self.w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self


class Index:
    """The fitted router and the number of parts that a query visits."""

    def __init__(self, sample: np.ndarray, depth: int, k: int, recall: float = RECALL):
        self.width, self.parts, self.router, self.probes = sample.shape[1], 1 << depth, None, 1
        if not depth:
            return
        cut = max(1, len(sample) * FITTED // SAMPLE)
        x, rest = sample[:cut], sample[cut:]
        near = nearest(x, x, min(NEAR, len(x) - 1), own=True)
        part = balanced_parts(x, near, depth)
        wanted = np.zeros((len(x), self.parts))
        np.add.at(wanted, (np.arange(len(x))[:, None], part[near]), 0.5 / near.shape[1])
        wanted[np.arange(len(x)), part] += 0.5
        self.router = Router(self.width, self.parts).fit(x, wanted)
        if recall >= 1:
            self.probes = self.parts
            return
        held = self.home(x)
        found = held[nearest(rest, x, min(k, len(x)))]
        order = np.argsort(-self.router.logits(rest), axis=1)
        rank = np.zeros_like(order)
        np.put_along_axis(rank, order, np.arange(self.parts)[None, :], axis=1)
        at = np.sort(np.take_along_axis(rank, found, axis=1).ravel())
        self.probes = int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.router.logits(x).argmax(axis=1) if self.router else np.zeros(len(x), np.int64)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """The most probable parts of each row, ``probes`` of them."""
        if not self.router:
            return np.zeros((len(x), 1), np.int64)
        return np.argsort(-self.router.logits(x), axis=1, kind="stable")[:, : self.probes]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, terms added in the order of the components."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


def _rows(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix in double precision, continued by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy().astype(np.float64)
    return out


def _placed(rows: DataFrame, index: Index, width: int) -> DataFrame:
    """``rows(vector, …)`` plus part, the most probable one."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            part = shared.value.home(_rows(batch.column("vector"), width))
            yield batch.append_column("part", pa.array(part.astype(np.int32)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, part int")


def _visiting(rows: DataFrame, index: Index, width: int) -> DataFrame:
    """``rows(vector, …)`` once for each part that they visit after the most probable one."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                parts = shared.value.visits(_rows(some.column("vector"), width))[:, 1:]
                again = some.take(pa.array(np.repeat(np.arange(some.num_rows), parts.shape[1])))
                yield again.append_column("part", pa.array(parts.ravel().astype(np.int32)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, part int")


def _search(k: int, width: int):
    """The ``k`` best of a cell's candidates for each of its queries, less those under its floor: q, vec_id, score."""

    def run(asked: pa.Table, candidates: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        asked, candidates = asked.combine_chunks(), candidates.combine_chunks()
        if asked.num_rows and candidates.num_rows:
            column = lambda t, c: t.column(c).chunk(0)
            c, ids = _rows(column(candidates, "vector"), width), column(candidates, "ids")
            many, flat = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
            start = np.cumsum(many) - many
            for at in range(0, asked.num_rows, 256):
                part = asked.slice(at, 256).combine_chunks()
                x, q, own = _rows(column(part, "vector"), width), column(part, "q").to_numpy(), column(part, "own")
                floor = column(part, "floor").to_numpy()
                single, own = own.is_valid().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy()
                s = x @ c.T
                # rounding in the product may differ from that of the exact score
                slack = 1e-12 * np.linalg.norm(x, axis=1) * np.linalg.norm(c, axis=1).max()
                keep = min(k, s.shape[1])
                least = np.maximum(np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep], floor)
                row, col = np.nonzero(s >= (least - slack)[:, None])
                score = exact_scores(x[row], c[col])
                n = many[col]
                row, score = np.repeat(row, n), np.repeat(score, n)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                vec_id = flat[np.repeat(start[col], n) + inside]
                fine = ~(single[row] & (own[row] == vec_id)) & (score >= floor[row])
                row, score, vec_id = row[fine], score[fine], vec_id[fine]
                order = np.lexsort((vec_id, -score, row))
                row, score, vec_id = row[order], score[order], vec_id[order]
                first = np.searchsorted(row, row)
                fine = np.arange(len(row)) - first < k
                for o, values in zip(out, (q[row[fine]], vec_id[fine], score[fine])):
                    o.append(values)
        return pa.table([pa.array(np.concatenate(o)) for o in out], ["q", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = RECALL, part: int = PART, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row of ``vectors(vec_id, embedding)`` the k candidates found of
    largest inner product, best first, ties to smaller ids. ``is_query`` is a condition on vec_id, as ``where`` takes it.

    Vectors that are null, zero or hold a null or non-finite component, and rows without an id, take no part;
    vectors of unequal length are compared as if continued by zeros. Rows that repeat id and vector are one;
    rows of one id with several vectors are candidates of their own, but never of a query of that id, which is asked
    once, by the vector that sorts first. A query without candidates has no rows, an empty table gives an empty
    result. Other columns are not read.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # floats are exact in doubles
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    fine = F.forall("vector", lambda x: F.abs(x) < float("inf")) & F.exists("vector", lambda x: x != 0)
    vectors = staged(vectors.where(F.col("vec_id").isNotNull() & fine).distinct())
    smallest = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    rows = vectors.withColumn("r", smallest).where(F.col("r") <= k + 1).groupBy("vector").agg(F.collect_list("vec_id").alias("ids"))
    rows = staged(rows)
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    width = width or 1
    depth = max(0, min(MOST_PARTS, n // part).bit_length() - 1)

    most = min(SAMPLE, max(1024, (4 << 20) // width))
    mark = F.xxhash64("vector")
    likely = rows.where(F.pmod(mark, F.lit(1 << 32)) < int((1 << 32) * min(1.0, 2 * most / max(1, n))))
    sample = likely.orderBy(mark).limit(most).select("vector").toArrow().combine_chunks() if depth else None
    index = Index(_rows(sample.column(0).chunk(0), width) if depth else np.zeros((0, width)), depth, k, recall)

    placed = staged(_placed(rows, index, width))
    sizes = [0] * index.parts
    for r in placed.groupBy("part").count().collect():
        sizes[r.part] = r["count"]
    blocks = F.get(F.array(*[F.lit(max(1, -(-s // block))) for s in sizes]), F.col("part"))

    # queries with one vector in groups of bounded size; an id with several vectors is asked alone, without its own rows
    one = vectors.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.count(F.lit(1)).alias("m"))
    one = staged(one)
    many = one.count()
    alone = F.when(F.col("m") > 1, F.col("vec_id"))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(max(64, -(-many // 10_000))))
    groups = one.groupBy("vector", alone.alias("alone"), salt.alias("salt")).agg(F.collect_list("vec_id").alias("ids"))
    groups = staged(groups.select(F.monotonically_increasing_id().alias("q"), "vector", "ids"))
    across = max(1, -(-many * index.probes // (index.parts * block)))
    along = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    right = placed.select("part", along(F.lit(across)).alias("i"), F.pmod(F.xxhash64(F.get("ids", F.lit(0))), blocks).cast("int").alias("j"), "ids", "vector")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")

    def meet(asked: DataFrame) -> DataFrame:
        left = asked.select("part", F.pmod(F.xxhash64("q"), F.lit(across)).cast("int").alias("i"), along(blocks).alias("j"), "q", "own", "floor", "vector")
        return left.groupBy("part", "i", "j").cogroup(right.groupBy("part", "i", "j")).applyInArrow(_search(k + 1, width), "q long, vec_id long, score double")

    def best_of(found: DataFrame) -> DataFrame:
        return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)

    own = F.when(F.size("ids") == 1, F.get("ids", F.lit(0)))
    asked, none = groups.select("q", own.alias("own"), "vector"), F.lit(float("-inf"))
    best = staged(best_of(meet(_placed(asked.withColumn("floor", none), index, width))))
    if index.probes > 1:
        floors = best.where(F.col("r") == k + 1).select("q", F.col("score").alias("floor"))
        asked = asked.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", none))
        best = best_of(best.drop("r").unionByName(meet(_visiting(asked, index, width))))
    best = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    answers = groups.join(best, "q").select(F.explode("ids").alias("query_id"), "best")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")
