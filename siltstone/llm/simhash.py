"""SimHash near-duplicates, found by Burkhard-Keller trees over shards of the fingerprints.

Fingerprints are 64-bit. Equal ones are collapsed first, so copies never meet again. To find all
pairs within the radius, the 64 bits are cut into blocks, more than the radius: two fingerprints
that differ in at most ``radius`` bits agree on every bit of at least (blocks - radius) blocks.
Each choice of that many blocks deals the fingerprints into shards; every qualifying pair shares
one. Each shard is a BK-tree: a node's children are keyed by their Hamming distance to it, and a
search follows only the edges within the radius of the query's distance.

The shard trees travel by shuffle, next to the queries of the same shard, and not by broadcast:
their total size grows with the input, so no size bound for a broadcast can be proved. A large
shard is cut into trees of bounded size; each of its members then visits all of them, in
different tasks. Tasks return spanning stars, not all pairs: linear in the members.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import distinct, shuffle_partitions, staged
from .components import components

RADIUS, SHINGLE, TREE = 4, 4, 4096
#: Sketches this near to the asked similarity do not decide: about three and a half deviations.
DOUBT = 0.085
#: How often a large shard is dealt again by further smallest values.
LEVELS = 2
#: Shingles of the whole sets that a shard's tree may hold.
SHINGLES = 1 << 21
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLICE = 1 << 15


class Sketch:
    """Smallest values of a set of shingle hashes under many orders: the share of orders in which
    two sets agree estimates their Jaccard similarity, within 0.025 (one deviation) at 0.8."""

    ORDERS = 256
    _rng = np.random.default_rng(64)
    FLIP = _rng.integers(0, 1 << 63, ORDERS, np.uint64)[:, None]
    FACTOR = (_rng.integers(0, 1 << 63, ORDERS, np.uint64) | np.uint64(1))[:, None]

    def __init__(self):
        self.least = np.full(self.ORDERS, ~np.uint64(0))

    def add(self, hashes: np.ndarray) -> None:
        for at in range(0, len(hashes), 1024):
            values = (hashes[at : at + 1024] ^ self.FLIP) * self.FACTOR
            np.minimum(self.least, values.min(axis=1), out=self.least)

    def signature(self) -> bytes:
        """One byte of each smallest value."""
        return ((self.least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()

    def keys(self, n: int) -> list[int]:
        return self.least[:n].view(np.int64).tolist()


def _digests(text: bytes | None, shingle: int):
    """The hashes of the whole text's word shingles in slices, repeats included."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), SLICE):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + SLICE], ends[at : at + SLICE])])
        yield np.frombuffer(raw, ">u8")


def _majority(slices) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for hashes in slices:
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the whole text over word shingles, repeats included; 0 without a word."""
    return _majority(_digests(text, shingle))


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text; none without a word."""
    found = list(_digests(text, shingle))
    return distinct(np.concatenate(found).astype(np.uint64)) if found else np.zeros(0, np.uint64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes, each counted once; 0 of none."""
    return _majority(hashes[at : at + SLICE] for at in range(0, len(hashes), SLICE))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def sketched(docs: DataFrame, shingle: int, keys: int) -> DataFrame:
    """doc_id, fp, sig, keys: fingerprint of the set of shingles, sketch and the first of the sketch's
    smallest values."""

    def run(batches):
        tokens.forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, fp, sig, least = batch.slice(at, 512), [], [], []
                for t in part.column(1):
                    hashes, sketch = shingle_hashes(t.as_py(), shingle), Sketch()
                    fp.append(set_fingerprint(hashes))
                    sketch.add(hashes)
                    sig.append(sketch.signature())
                    least.append(sketch.keys(keys))
                fp = pa.array(np.array(fp, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), fp, pa.array(sig, pa.binary()), pa.array(least, pa.list_(pa.int64()))], ["doc_id", "fp", "sig", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(tokens.lean(run), "doc_id long, fp long, sig binary, keys array<long>")


def shard_masks(distinct: int, radius: int, per_shard: int = 512) -> list[int]:
    """Bit masks that deal ``distinct`` fingerprints into shards: the fewest blocks whose shards
    hold about ``per_shard`` by chance. All choices are exact; they differ only in cost."""
    for blocks in range(radius + 1, radius + 5):
        bits = 64 * (blocks - radius) // blocks
        if distinct >> bits <= per_shard:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def _count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Trees:
    """A forest of BK-trees, one for each group, built level by level over numpy arrays."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        """``fp``: distinct within a group; ``group``: sorted codes from 0."""
        self.fp, n = fp, len(fp)
        self.root = np.flatnonzero(np.diff(group, prepend=-1))
        edge_parent, edge_dist, edge_child = [], [], []
        items = np.setdiff1d(np.arange(n), self.root, assume_unique=True)
        parent = self.root[group[items]]
        while len(items):
            key = parent * 65 + _count(fp[items] ^ fp[parent])
            order = np.argsort(key, kind="stable")
            key, items = key[order], items[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            edge_parent.append(key[first] // 65)
            edge_dist.append(key[first] % 65)
            edge_child.append(items[first])
            parent = np.repeat(items[first], np.diff(np.append(first, len(items))))
            rest = np.ones(len(items), bool)
            rest[first] = False
            items, parent = items[rest], parent[rest]
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        keys, child = cat(edge_parent) * 256 + cat(edge_dist), cat(edge_child)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], child[order]

    def near(self, fp: np.ndarray, group: np.ndarray, radius: int, step: int = 4096):
        """Yields (query, node) arrays of all pairs within the radius in the query's group."""
        for at in range(0, len(fp), step):
            query = np.arange(at, min(at + step, len(fp)))
            node = self.root[group[query]]
            while len(query):
                dist = _count(fp[query] ^ self.fp[node])
                hit = dist <= radius
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.keys, node * 256 + np.maximum(dist - radius, 0))
                many = np.searchsorted(self.keys, node * 256 + dist + radius, "right") - low
                query = np.repeat(query, many)
                node = self.child[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]


def join_all(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over arrays: afterwards ``parent`` maps every item to its set's smallest item."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _shards(table: pa.Table, radius: int, step: int):
    """Yields (query row, tree row) arrays of the pairs within the radius in a batch of shards (key,
    piece; fp, rep, member of tree, ...)."""
    key, piece, fp, tree = (table.column(i).to_numpy() for i in (0, 1, 2, 4))
    code = np.cumsum((np.diff(key, prepend=key[:1]) != 0) | (np.diff(piece, prepend=piece[:1]) != 0))
    fp, tree = fp.view(np.uint64), tree.astype(bool)
    at = np.flatnonzero(tree)
    groups, group = np.unique(code[at], return_inverse=True)
    forest = Trees(fp[at], group)
    ask = np.flatnonzero(np.isin(code, groups))
    for query, node in forest.near(fp[ask], np.searchsorted(groups, code[ask]), radius, step):
        a, b = ask[query], at[node]
        for k in range(0, len(a), 1 << 15):
            yield a[k : k + (1 << 15)], b[k : k + (1 << 15)]


def _stars(table: pa.Table, radius: int):
    """Spanning stars of the links in a batch of shards."""
    rep, parent = table.column(3).to_numpy(), np.arange(table.num_rows)
    for a, b in _shards(table, radius, 4096):
        join_all(parent, a, b)
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    yield _edge_rows(rep[linked], rep[parent[linked]], True)


class _Sketches:
    """Sketches of a batch of shards (column 5: sketch, 6: which of the smallest values the shard
    shares, 7: those values)."""

    def __init__(self, table: pa.Table, similarity: float):
        n, self.similarity = table.num_rows, similarity
        self.sig = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint8).reshape(n, -1)
        self.nth = table.column(6).to_numpy()
        self.keys = _flat(table.column(7)).reshape(n, -1)

    def share(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sig[a] == self.sig[b]).mean(axis=1)

    def open(self, a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Whether the sketches leave a pair open and this is the first of the shards it shares."""
        some = np.flatnonzero(np.abs(share - self.similarity) < DOUBT)
        found = np.zeros(len(a), bool)
        found[some] = (self.keys[a[some]] == self.keys[b[some]]).argmax(axis=1) == self.nth[a[some]]
        return found


def _sure_stars(table: pa.Table, radius: int, similarity: float):
    """Spanning stars of the links that sketches settle and, as not sure, (rep, key) of the shards'
    members that stand in an open pair which those links leave apart."""
    key, rep = table.column(0).to_numpy(), table.column(3).to_numpy()
    sketches, parent, asked = _Sketches(table, similarity), np.arange(table.num_rows), np.zeros(table.num_rows, bool)
    doubts, many = [], 0
    for a, b in _shards(table, radius, 256):
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
        share = sketches.share(a, b)
        open_ = sketches.open(a, b, share)
        doubts.append((a[open_], b[open_]))
        many += int(open_.sum())
        alike = share >= similarity + DOUBT
        join_all(parent, a[alike], b[alike])
        if many >= 1 << 18:
            c, d = _apart(doubts, parent)
            if len(c) >= 1 << 17:  # too many to hold: their members are asked, whatever joins them later
                asked[c] = asked[d] = True
                c, d = c[:0], d[:0]
            doubts, many = [(c, d)], len(c)
    if many:
        c, d = _apart(doubts, parent)
        asked[c] = asked[d] = True
    yield _edge_rows(rep[asked], key[asked], False)
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    yield _edge_rows(rep[linked], rep[parent[linked]], True)


def _apart(pairs: list[tuple[np.ndarray, np.ndarray]], parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) for x in zip(*pairs))
    apart = parent[a] != parent[b]
    return a[apart], b[apart]


def _settled_stars(table: pa.Table, radius: int, similarity: float):
    """Spanning stars between parts (column 8) by open pairs whose whole shingle sets (column 9) are
    similar enough. A pair goes uncompared only once its ends are in one set."""
    part, sketches = table.column(8).to_numpy(), _Sketches(table, similarity)
    size = pc.list_value_length(table.column(9)).to_numpy().astype(np.int64)
    start = np.cumsum(size) - size
    code = np.unique(_flat(table.column(9)), return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(int(code.max(initial=0)) + 1, bool)
    _, first, same = np.unique(part, return_index=True, return_inverse=True)
    parent = first[same]
    before = parent.copy()

    def join(x: int, others: np.ndarray) -> None:
        mine = code[start[x] : start[x] + size[x]]
        mark[mine] = True
        n = size[others]
        ends = np.cumsum(n)
        both = np.add.reduceat(mark[code[np.repeat(start[others] - ends + n, n) + np.arange(ends[-1])]], ends - n, dtype=np.int64)
        mark[mine] = False
        good = others[both >= similarity * (size[x] + n - both)]
        join_all(parent, np.full(len(good), x), good)

    for a, b in _shards(table, radius, 256):
        apart = (parent[a] != parent[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]))
        a, b = a[apart], b[apart]
        share = sketches.share(a, b)
        open_ = sketches.open(a, b, share)
        a, b, share = a[open_], b[open_], share[open_]
        order = np.lexsort((-share, a))
        a, b = a[order], b[order]
        for low, high in zip(edges := np.flatnonzero(np.diff(a, prepend=-1)), [*edges[1:], len(a)]):
            x, others = int(a[low]), b[low:high]
            others = others[parent[others] != parent[x]]
            if len(others):  # of each set the closest first, then what that leaves apart
                best = np.unique(parent[others], return_index=True)[1]
                join(x, others[best])
                others = np.delete(others, best)
                others = others[parent[others] != parent[x]]
            if len(others):
                join(x, others)
    linked = np.flatnonzero(parent != before)
    yield _edge_rows(part[linked], part[parent[linked]], True)


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy()


def _edge_rows(a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), sure))], ["a", "b", "sure"])


def _link(stars, rows: int = 1 << 16, size: int = 1 << 25):
    """For shards sorted with tree members first: links batches of about ``rows`` rows or ``size`` bytes
    by ``stars(table)``. Of a shard that goes on in the next batch only its tree members, bounded in
    number, are carried over."""

    def run(batches):
        kept, many, held = [], 0, 0
        for whole in batches:
            for batch in (whole.slice(at, 1024) for at in range(0, whole.num_rows, 1024)):
                kept.append(batch)
                many += batch.num_rows
                held += batch.nbytes
                if many < rows and held < size:
                    continue
                table = pa.Table.from_batches(kept)
                yield from stars(table)
                key, piece, tree = (table.column(i).to_numpy() for i in (0, 1, 4))
                kept = table.filter(pa.array((key == key[-1]) & (piece == piece[-1]) & (tree == 1))).combine_chunks().to_batches()
                many = held = 0  # what is carried is bounded and counts no more
        if many:
            yield from stars(pa.Table.from_batches(kept))

    return run


def _linked(keyed: DataFrame, tree: int, stars, more: list[str] = [], weight=None, large: DataFrame | None = None) -> DataFrame:
    """a, b, sure: what ``stars`` finds within the shards of ``keyed(fp, rep, key, *more)``. Shards of
    more than ``tree`` members, or of a ``weight`` over ``SHINGLES``, are cut into pieces; ``large(key,
    pieces)`` names them if they are known."""
    if large is None:
        share = F.count(F.lit(1)) / tree
        share = share if weight is None else F.greatest(share, F.sum(weight) / SHINGLES)
        large = keyed.groupBy("key").agg(F.ceil(share).cast("int").alias("pieces")).where("pieces > 1")
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("pieces")).cast("int")
    dealt = (
        keyed.join(large, "key", "left")
        .withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        .withColumn("own", own)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("own"))))  # a pair meets in the tree of the lower piece
        .select("key", "piece", "fp", "rep", (F.col("piece") == F.col("own")).cast("int").alias("tree"), *more)
    )
    n = shuffle_partitions(keyed.sparkSession)
    edges = dealt.repartition(n, "key", "piece").sortWithinPartitions("key", "piece", F.desc("tree"))
    return edges.mapInArrow(tokens.lean(_link(stars)), "a long, b long, sure boolean")


def linked_components(fps: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """fp, component_id for every distinct fingerprint of ``fps(doc_id, fp)``."""
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    masks = shard_masks(distinct.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    found = components(_linked(distinct.where("rep IS NOT NULL").select("fp", "rep", F.explode(keys).alias("key")), tree, partial(_stars, radius=radius)).select("a", "b"))
    return distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp, hashes: the fingerprint and the sorted distinct hashes of each whole text's shingles."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_hashes(t.as_py(), shingle) for t in part.column(1)]
                fp = np.array([set_fingerprint(x) for x in sets], np.uint64)
                sets = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), sets], ["doc_id", "fp", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(tokens.lean(run), "doc_id long, fp long, hashes array<long>")


def _dealt(rows: DataFrame, keys: int, large: list[DataFrame]) -> DataFrame:
    """Rows of ``rows(fp, rep, keys, ...)`` once for each shard: key, and nth, which of the first ``keys``
    smallest values it shares. A shard named in ``large[i]`` is dealt again by the next ``keys`` values."""
    out = rows.select("*", F.posexplode(F.slice("keys", 1, keys)).alias("nth", "least")).withColumn("key", F.xxhash64("nth", "least"))
    for level, big in enumerate(large, 1):
        finer = F.transform(F.slice("keys", keys * level + 1, keys), lambda x, i: F.xxhash64(F.col("key"), i, x))
        out = out.join(big, "key", "left").withColumn("key", F.explode(F.when(F.col("big"), finer).otherwise(F.array("key")))).drop("big")
    return out.withColumn("keys", F.slice("keys", 1, keys))


def _large(rows: DataFrame, keys: int, tree: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """(key, big) of the shards of each level that hold more than ``tree`` members, and (key, pieces) of
    those that do so after the last one."""
    large: list[DataFrame] = []
    while True:
        pieces = F.ceil(F.count(F.lit(1)) / tree).cast("int").alias("pieces")
        sizes = staged(_dealt(rows.select("fp", "rep", "keys"), keys, large).groupBy("key").agg(pieces).where("pieces > 1"))
        if len(large) == levels or sizes.isEmpty():
            return large, sizes
        large.append(sizes.select("key", F.lit(True).alias("big")))


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 26, keys: int = 8, tree: int = TREE, levels: int = LEVELS) -> DataFrame:
    """doc_id, component_id: documents linked by a similarity of their shingle sets.

    A radius that reaches Jaccard similarities of 0.8 with certainty is two fifths of the fingerprint, too wide to
    shard by its bits. Here the shards of the BK-trees are the documents that share one of ``keys``
    smallest shingle hashes (a pair at 0.8 shares none with a chance of 0.2 ** keys, less above). A
    common shingle makes a shard of documents that share little else, so one of more than ``tree``
    members is dealt again by ``keys`` further smallest values, up to ``levels`` times (at the same
    chance each); what is larger even then shares so many values that its members are mostly alike.
    Fingerprints count each shingle once here, as the similarity does, so repeats move nothing.
    Pairs within the radius whose sketches agree in clearly more orders than ``similarity`` are
    linked. Pairs within ``DOUBT`` of it are settled by whole sets: each shard names the members of
    such pairs that the links leave apart, and these meet again in their shards with their sets,
    where every open pair is compared unless its ends are joined already. Pairs never leave a task.
    Nulls, blanks, repeats and ids as in :func:`near_duplicates`.
    """
    found = staged(sketched(docs, shingle, keys * (1 + levels)))
    distinct = staged(found.groupBy("fp", "sig").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")))
    more = ["sig", "nth", "keys"]
    named = distinct.where("rep IS NOT NULL")
    large, pieces = _large(named, keys, tree, levels)
    dealt = _dealt(named, keys, large).select("fp", "rep", "key", *more)
    edges = staged(_linked(dealt, tree, partial(_sure_stars, radius=radius, similarity=similarity), more, large=pieces))
    sure = staged(components(edges.where("sure").select("a", "b")))
    asked = edges.where("NOT sure").select(F.col("a").alias("rep"), F.col("b").alias("key")).distinct()
    asked = staged(asked.join(sure, asked["rep"] == sure["node"], "left").select("rep", "key", F.coalesce("component", "rep").alias("part")))
    several = asked.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    asked = staged(asked.join(several, "key", "left_semi"))
    members = asked.select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members, "rep", "left_semi")
    sets = shingle_sets(texts.withColumnRenamed("rep", "doc_id"), shingle).groupBy(F.col("doc_id").alias("rep"), "fp").agg(F.first("hashes").alias("hashes"))
    with_sets = _dealt(named.join(members, "rep", "left_semi"), keys, large).join(asked, ["rep", "key"]).join(staged(sets), ["rep", "fp"])
    settled = partial(_settled_stars, radius=radius, similarity=similarity)
    joined = _linked(with_sets.select("fp", "rep", "key", *more, "part", "hashes"), tree, settled, [*more, "part", "hashes"], F.size("hashes"))
    more = components(joined.select("a", "b"))
    named = distinct.join(sure, distinct["rep"] == sure["node"], "left").select("fp", "sig", F.coalesce("component", "rep").alias("part"))
    named = named.join(more, named["part"] == more["node"], "left").select("fp", "sig", F.coalesce("component", "part").alias("component_id"))
    return found.select("doc_id", "fp", "sig").join(named, ["fp", "sig"]).select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tree: int = TREE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs(doc_id, text)``.

    Null and blank texts have fingerprint zero and are linked like any other. A text of fewer words
    than a shingle is one shingle. Repeated rows get the same result each. Rows with a null id take
    part through their text, but never name a component unless all its rows have null ids, when
    component_id is null. An empty table gives an empty result; other columns are not read.
    """
    fps = staged(fingerprints(docs, shingle))
    found = linked_components(fps, radius, tree)
    return fps.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
