"""Exact top-k inner-product search by no-random-access aggregation.

A block of candidates is one sorted list per dimension, read from the top for queries with a positive
component there and from the bottom for those with a negative one. All lists are read in step, a
slice at a time, and nothing is looked up beside them: a candidate's share in a list is known once
the list has been read down to it; until then it is at most the share at the depth reached and at
least the list's last. So each candidate has a lower and an upper bound of its score, and a query
drops every candidate whose upper bound is below its k-th best lower bound, or below its k-th best
score of earlier blocks. Reading stops for a query when few enough candidates remain, which no
outsider can then displace; their scores are resolved exactly. It stops for the block when it has
stopped for all queries.

Candidates and queries are dealt into blocks of bounded size, staged in the shared folder, and meet in
the cells of a grid: a cell holds a bounded number of query blocks and of candidate blocks, takes them
up block by block, and returns its k best for each query. So the candidates travel once for every
``ASKED`` blocks of queries. Neither side goes to the driver, and no task holds more than a cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

#: Depths of a list at which bounds are taken, as shares of its length.
DEPTHS = (0.25, 0.4, 0.55, 0.7, 0.8, 0.9)
#: Candidates of a block, and candidate blocks and query blocks of a grid cell at most on average.
CANDIDATES, CELL, ASKED = 4096, 8, 16
BOUNDS = float(1 << 63)


class Block:
    """Candidates (n x d whole numbers, sorted by id) and one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.most = np.abs(values.astype(np.float64)).max(axis=0, initial=0)
        self.order = np.argsort(-self.values.astype(np.float64), axis=0, kind="stable")
        self.lists: dict = {}

    def read(self, kind, depths):
        """Reads the lists from both ends, slice by slice. Yields upper and lower bounds of all shares for a
        component of one: (from the top: most, least; from the bottom: most, least)."""
        if kind not in self.lists:
            self.lists[kind] = np.take_along_axis(self.values, self.order, axis=0).astype(kind)
        lists, n = self.lists[kind], len(self.ids)
        column = np.arange(lists.shape[1])
        down, up = (np.empty((2, n, lists.shape[1]), kind) for _ in range(2))
        down[1], up[1] = lists[-1], lists[0]
        seen, at = np.zeros((2, n, lists.shape[1]), bool), 0
        for share in depths:
            to = max(at + 1, int(n * share))
            for state, end, rows in ((down, 0, slice(at, to)), (up, 1, slice(n - to, n - at))):
                place = self.order[rows], column
                state[0][place] = state[1][place] = lists[rows]
                seen[end][place] = True
            down[0] = np.where(seen[0], down[0], lists[to - 1])
            up[0] = np.where(seen[1], up[0], lists[n - to])
            at = to
            yield down, up

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (rows of whole numbers) ids and scores of the block's k best (ties to smaller
        ids), less those under its ``floor`` (minus infinity for none). Scores beyond a long are left out."""
        bound = float((np.abs(queries.astype(np.float64)) @ self.most).max(initial=0))
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < BOUNDS else object
        n, found = len(self.ids), [None] * len(queries)
        few = 4 * k
        live = np.ones((len(queries), n), bool)
        live &= self.ids[None, :] != own[:, None]
        if kind in (np.float32, np.float64) and n > few + 1:
            plus, minus = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
            active = np.arange(len(queries))
            for down, up in self.read(kind, DEPTHS):
                upper = plus[active] @ down[0].T + minus[active] @ up[0].T
                lower = np.where(live[active], plus[active] @ down[1].T + minus[active] @ up[1].T, -np.inf)
                least = np.maximum(np.partition(lower, n - k, axis=1)[:, n - k], floor[active])
                live[active] &= upper >= least[:, None]
                active = active[live[active].sum(axis=1) > few]
                if not len(active):
                    break
        values, queries = self.values.astype(kind), queries.astype(kind)
        for q, query in enumerate(queries):
            some = np.flatnonzero(live[q])
            score = values[some] @ query
            fine = score >= floor[q] if kind is not object else np.array([-BOUNDS <= s < BOUNDS for s in score], bool)
            some, score = some[fine], score[fine].astype(np.int64)
            order = np.lexsort((self.ids[some], ~score))[:k]  # ~x: descending, without overflow
            found[q] = self.ids[some[order]], score[order]
        return found


def _integers(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, lengths and, one after another, floor(scale * x) of the vectors that take part."""
    ids, vectors = batch.column(0), batch.column(1)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = vectors.offsets.to_numpy().astype(np.int64)
    x = np.floor(scale * values)
    fits = np.abs(x) < BOUNDS  # false for what is null or not a number, too
    bad = np.concatenate(([0], np.cumsum(~fits)))
    some = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
    inside = np.zeros(len(x) + 1, np.int64)
    np.add.at(inside, at[:-1][some], 1)
    np.add.at(inside, at[1:][some], -1)
    return ids.fill_null(0).to_numpy()[some], np.diff(at)[some], x[np.cumsum(inside[:-1]) > 0].astype(np.int64)


def blocks(vectors: DataFrame, most: int, scale: int) -> DataFrame:
    """block, ids, sizes, comps: whole-number vectors of ``vectors(vec_id, embedding)`` in blocks of up to ``most``."""

    def row(ids, sizes, comps):
        kind = "<i4" if np.abs(comps, dtype=np.float64).max(initial=0) < 1 << 31 else "<i8"
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("<i8"), sizes.astype("<i4"), comps.astype(kind))], ["ids", "sizes", "comps"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate(x) for x in zip(held, _integers(batch, scale))]
            while len(held[0]) >= most:
                cut = (most, most, int(held[1][:most].sum()))
                yield row(*(x[:n] for x, n in zip(held, cut)))
                held = [x[n:] for x, n in zip(held, cut)]
        if len(held[0]):
            yield row(*held)

    rows = vectors.mapInArrow(run, "ids binary, sizes binary, comps binary")
    return staged(rows.withColumn("block", F.monotonically_increasing_id()))


def _unpack(table: pa.Table):
    """(ids, rows) of each staged block."""
    for ids, sizes, comps in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "comps"))):
        sizes = np.frombuffer(sizes, "<i4").astype(np.int64)
        comps = np.frombuffer(comps, "<i4" if len(comps) == 4 * sizes.sum() else "<i8").astype(np.int64)
        yield np.frombuffer(ids, "<i8"), np.split(comps, np.cumsum(sizes)[:-1])


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of unequal lengths as one matrix, continued by zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for r, x in enumerate(rows):
        out[r, : len(x)] = x
    return out


def _search(k: int):
    def search(ids, asked, candidates, best_id, best):
        """Puts the best of some candidates into the best so far."""
        cid, rows = np.concatenate([c[0] for c in candidates]), [x for c in candidates for x in c[1]]
        wide = max(map(len, [*asked, *rows]))
        floor = np.nextafter([float(s[-1]) if len(s) >= k else -np.inf for s in best], -np.inf)  # a float may have been rounded up
        for q, (new_id, new) in enumerate(Block(cid, _matrix(rows, wide)).best(_matrix(asked, wide), ids, k, floor)):
            all_id, all_ = np.concatenate((best_id[q], new_id)), np.concatenate((best[q], new))
            order = np.lexsort((all_id, ~all_))[:k]  # ~x: descending, without overflow
            best_id[q], best[q] = all_id[order], all_[order]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for ids, asked in _unpack(left):
            best_id, best = ([np.zeros(0, np.int64)] * len(ids) for _ in range(2))
            held, many = [], 0
            for block in _unpack(right):
                held.append(block)
                many += len(block[0])
                if many >= CANDIDATES:
                    search(ids, asked, held, best_id, best)
                    held, many = [], 0
            if held:
                search(ids, asked, held, best_id, best)
            for x, more in zip(out, ([np.repeat(ids, list(map(len, best)))], best_id, best)):
                x.extend(more)
        return pa.table([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query row of ``vectors(vec_id, embedding)``.

    Score: inner product of floor(scale * x). Ties go to smaller ids. Vectors that are null or hold
    a null or non-finite component or one whose whole number does not fit a long, and rows with a null
    id, take no part; a pair whose score does not fit a long is left out. Vectors of unequal length are
    compared as if continued by zeros. Rows that repeat an id are candidates of their own; a query given
    by several rows is asked once, by any one of them. A query without candidates has no rows. An empty
    table gives an empty result. Other columns are not read.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked, rows = blocks(vectors.where(is_query).dropDuplicates(["vec_id"]), block, scale), blocks(vectors, CANDIDATES, scale)
    down, many = max(1, -(-asked.count() // ASKED)), max(1, rows.count())
    across = min(many, max(-(-many // CELL), shuffle_partitions(vectors.sparkSession)))
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    along = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select(place(down).alias("i"), along(across).alias("j"), "ids", "sizes", "comps")
    rows = rows.select(along(down).alias("i"), place(across).alias("j"), "ids", "sizes", "comps")
    found = asked.groupBy("i", "j").cogroup(rows.groupBy("i", "j")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same by brute force. floor(1024 * x) fits the doubles exactly.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10
"""
