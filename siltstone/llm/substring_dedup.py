"""Suffix-array de-duplication of repeated byte strings by common-prefix-aware merge sort.

Removed is each byte covered by a string of ``length`` bytes that also starts in a document with a
smaller id.

*Which suffixes.* Sorting every suffix would move many times the corpus. Instead each window of
``length`` bytes names an anchor: the place in it whose ``GRAM`` bytes hash lowest (the leftmost of
equals). The choice depends on the window's bytes alone, so equal windows have their anchors at
the same offset, and sorting the suffixes at anchors loses no match. About one place in ten is
an anchor.

*Whole copies.* A text that equals one of a smaller id loses every byte, and no other document
needs it as a witness; such texts are found by digest and take no further part.

*Runs.* Documents are dealt into runs of bounded size, staged in the shared folder. A run first
sends the hashes of its anchors, sorted and delta-coded; anchors whose hash no other anchor has
cannot match and are dropped. For the rest it forms keys: the suffix at the anchor as far as its
windows reach, then what stands before it. Equal keys of a run are one key with the smallest and
largest id; where they stand stays in the run. So the inside of a passage that a third of all documents
hold costs each run one key an anchor, however often it stands there. At its edges windows reach into
what differs from place to place, and all these keys share a gram. A gram of which runs may send very many
keys (``HOT`` in all, told with the marks of what is repeated) is therefore sent as single windows, which
are dealt by all their bytes: equal ones still meet, the others spread over all parts. The sorted keys are front-coded (length of the
common prefix, remaining bytes) and exchanged by parts, ranges of the anchor's hash.

*Merge.* Runs meet in a loser tree. Every entry carries its common prefix with the last key put
out; of two entries the one with the longer common prefix is smaller without a look at the
bytes, and equal ones are compared only beyond the known prefix. Keys come out sorted with
their common prefixes; those that share the anchor's gram are neighbours, and each window gets the
smallest id that holds it. Verdicts go back to the runs by the key's number; a run forms its keys
again, finds where they stand and cuts its texts.

*Sizes.* Each run sends at most one row to each part, and a row should hold many anchors. So the size of
runs grows with the square root of the input (within ``RUN_BYTES`` and ``MOST_RUN_BYTES``), and there
are at most as many parts as leave a run ``ROW_ANCHORS`` anchors for each; many parts share a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, quoted, staged
from . import tokens
from .exact_dedup import MAX_FREQUENT, TRACKED, with_keeper

LENGTH, GRAM = 50, 32
RUN_BYTES, MOST_RUN_BYTES, BLOCK = 8 << 20, 64 << 20, 1 << 17
PART_ANCHORS, ROW_ANCHORS, MOST_PARTITIONS = 1 << 20, 64, 1 << 15
#: Runs that have a gram, or its places in runs that have several (rounded down to powers of two), that make it hot.
HOT = 4096


class Anchors:
    """The anchors of concatenated texts: place, first and last window start, 48-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        span = length - GRAM
        at, low, high, hashes = [], [], [], []
        for a in range(0, max(0, len(data) - length + 1), BLOCK):
            part = data[a : a + BLOCK + length - 1]
            h = part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            factor, width = np.full(1, 0x2545F4914F6CDD1D, np.uint64), 1
            while width < GRAM:
                h = h[:-width] * factor + h[width:]
                factor, width = factor * factor, 2 * width
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h >>= np.uint64(16)
            key = (h >> np.uint64(8) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= span + 1:
                key, width = np.minimum(key[:-width], key[width:]), 2 * width
            if width < span + 1:
                key = np.minimum(key[: len(key) - (span + 1 - width)], key[span + 1 - width :])
            place = (key & np.uint64(0xFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            at.append(place[first] + a)
            # anchors have low hashes; a second mix spreads them evenly over the 48 bits again
            hashes.append(h[place[first]] * np.uint64(0xD6E8FEB86659FD93) & np.uint64((1 << 48) - 1))
            low.append(first + a)
            high.append(np.append(first[1:], len(place)) - 1 + a)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        at, low, high, hashes = cat(at, np.int64), cat(low, np.int64), cat(high, np.int64), cat(hashes, np.uint64)
        if len(at):  # an anchor's windows may go on in the next block
            first = np.flatnonzero(np.diff(at, prepend=-1))
            high = np.maximum.reduceat(high, first)
            at, low, hashes = at[first], low[first], hashes[first]
        # windows must not leave their document
        doc = np.searchsorted(offsets, at, "right") - 1
        low = np.maximum(low, offsets[doc])
        high = np.minimum(high, offsets[doc + 1] - length) if len(at) else high
        fine = low <= high
        self.at, self.low, self.high, self.hash, self.doc = at[fine], low[fine], high[fine], hashes[fine], doc[fine]


def pack_runs(docs: DataFrame, run_bytes: int) -> DataFrame:
    """run, n_bytes, body: rows of ``docs`` (doc_id and text first) dealt into runs of about
    ``run_bytes`` of text, each one compressed record batch."""

    def run(batches):
        tokens.forget()
        held, size = [], 0
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                end = min(int(np.searchsorted(sizes, before + run_bytes - size)) + 1, batch.num_rows)
                held.append(batch.slice(at, end - at))
                size += int(sizes[end - 1]) - before
                at = end
                if size >= run_bytes:
                    yield _run_row(held, size)
                    held, size = [], 0
        if held:
            yield _run_row(held, size)

    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *quoted(rest)).toDF(*[f"c{i}" for i in range(len(rest) + 2)]).mapInArrow(tokens.lean(run), "n_bytes long, body binary")
    return staged(rows.withColumn("run", F.monotonically_increasing_id()))


def _run_row(held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
    body = pa.Table.from_batches(held)
    body = body.set_column(1, "c1", pc.fill_null(body.column(1), b"").cast(pa.large_binary())).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, body.schema) as w:
        w.write_table(body)
    blob = zstandard.ZstdCompressor(level=6).compress(sink.getvalue())
    return pa.RecordBatch.from_arrays([pa.array([size]), pa.array([blob], pa.binary())], ["n_bytes", "body"])


def _rows(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_next_batch()


def _open(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (a null as the largest), texts as one array, offsets."""
    ids, texts = batch.column(0), batch.column(1)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[: offsets[-1]] if body else np.zeros(0, np.uint8)
    return ids.fill_null(np.iinfo(np.int64).max).to_numpy(), data, offsets


def whole_copies(source: DataFrame) -> DataFrame:
    """run, copies: the places in their run of documents that equal one of a smaller id."""

    def run(batches):
        tokens.forget()
        for batch in batches:
            for run_id, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, data, offsets = _open(_rows(blob.as_py()))
                digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([run_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ids), pa.array(digests, pa.binary())], ["run", "nth", "doc_id", "digest"])

    texts = staged(source.mapInArrow(tokens.lean(run), "run long, nth int, doc_id long, digest binary"))
    copies = with_keeper(texts, MAX_FREQUENT, TRACKED).where("doc_id > keep_id")
    return staged(copies.groupBy("run").agg(F.collect_list("nth").alias("copies")))


def _copies(pdf: pd.DataFrame) -> np.ndarray:
    return np.array([k for c in pdf["copies"] if c is not None for k in c], np.int64)


def _deltas(sorted_: np.ndarray) -> bytes:
    """Sorted distinct hashes as differences, in four bytes each where they fit."""
    d = np.diff(sorted_, prepend=np.uint64(0))
    return b"4" + d.astype("<u4").tobytes() if len(d) == 0 or d.max() < 1 << 32 else b"8" + d.astype("<u8").tobytes()


def _from_deltas(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw[1:], "<u4" if raw[:1] == b"4" else "<u8"), dtype=np.uint64)


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _hash_blocks(length: int, parts: int):
    """A run's distinct anchor hashes, in slices by part."""

    def run(batches):
        tokens.forget()
        for batch in batches:
            for run_id, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, data, offsets = _open(_rows(blob.as_py()))
                f, n = np.unique(Anchors(data, offsets, length).hash, return_counts=True)
                part = _part_of(f, parts)
                cut = np.flatnonzero(np.diff(part, prepend=-1))
                rows = [(run_id, int(part[a]), _deltas(f[a:b]), np.packbits(n[a:b] > 1).tobytes(), _squeeze(np.log2(n[a:b]).astype(np.uint8))) for a, b in zip(cut, np.append(cut[1:], len(f)))]
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["run", "part", "hashes", "own", "many"])

    return run


def _repeated(hot: int):
    """For each run's slice, marks of the hashes that stand at more than one anchor anywhere, then marks of the hot ones."""

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        slices = [_from_deltas(h) for h in pdf["hashes"]]
        own = [np.unpackbits(np.frombuffer(o, np.uint8))[: len(s)].astype(bool) for o, s in zip(pdf["own"], slices)]
        every = np.sort(np.concatenate(slices))
        several = np.concatenate([s[o] for s, o in zip(slices, own)])
        twice = distinct(np.concatenate([every[1:][every[1:] == every[:-1]], several]))
        places = 1 << np.concatenate([_unsqueeze(m, "u1")[0][o] for m, o in zip(pdf["many"], own)]).astype(np.int64)
        some, number = np.unique(several, return_inverse=True)
        often = some[np.bincount(number, places, len(some)) >= hot]
        if len(every) >= hot:
            often = distinct(np.concatenate([often, every[hot - 1 :][every[hot - 1 :] == every[: len(every) - hot + 1]]]))
        marks = [_marks(s, twice) + _marks(s, often) for s in slices]
        return pd.DataFrame({"run": pdf["run"], "part": pdf["part"], "marks": marks})

    return mark


def _marks(hashes: np.ndarray, among: np.ndarray) -> bytes:
    at = np.minimum(np.searchsorted(among, hashes), max(0, len(among) - 1))
    return np.packbits(among[at] == hashes if len(among) else np.zeros(len(hashes), bool)).tobytes()


def _marked(raw: bytes, n: int) -> np.ndarray:
    """Marks of repeated and of hot hashes (2 x n); without the latter none is hot."""
    both, size = np.frombuffer(raw, np.uint8), -(-n // 8)
    out = np.zeros((2, n), bool)
    out[0] = np.unpackbits(both[:size])[:n]
    if len(both) > size:
        out[1] = np.unpackbits(both[size:])[:n]
    return out


def _window_hash(windows: np.ndarray) -> np.ndarray:
    """48 bits of windows of bytes (n x length)."""
    n, length = windows.shape
    words = np.zeros((n, -(-length // 8) * 8), np.uint8)
    words[:, :length] = windows
    h = np.zeros(n, np.uint64)
    for x in words.view("<u8").T:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)


def front_code(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """For sorted distinct fixed-width keys (n x width bytes): common prefix with the one before, remaining bytes."""
    n, width = keys.shape
    differ = keys[1:] != keys[:-1]
    lcp = np.concatenate(([0], np.argmax(differ, axis=1) if n > 1 else [])).astype(np.uint8)[:n]
    return lcp, keys[np.arange(width)[None, :] >= lcp[:, None]].tobytes()


def decode_front(lcp: bytes, rest: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the one before, key) in order."""
    key, at = b"", 0
    for n in lcp:
        key = key[:n] + rest[at : at + width - n]
        at += width - n
        yield n, key


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(common prefix with the last key put out, run, key) over all runs, in order of keys.

    A loser tree. ``lcp[r]`` is run r's common prefix with the last winner along its path. A longer
    common prefix wins unseen; bytes are compared only from an equal one on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    keys: list[bytes | None] = [None] * k
    lcp = [0] * k
    for r, it in enumerate(runs):
        got = next(it, None)
        if got is not None:
            keys[r] = got[1]
    tree = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's common prefix is then with the winner."""
        x, y = keys[a], keys[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        m, n = lcp[a], lcp[b]
        if m > n:
            return a, b
        if n > m:
            return b, a
        if x[m:] == y[m:]:
            lcp[max(a, b)] = len(x)
            return (a, b) if a < b else (b, a)
        step = m
        while x[step] == y[step]:
            step += 1
        if x[step] < y[step]:
            lcp[b] = step
            return a, b
        lcp[a] = step
        return b, a

    def start(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(start(2 * node), start(2 * node + 1))
        return winner

    best = start(1) if k > 1 else 0
    while keys[best] is not None:
        yield lcp[best], best, keys[best]
        got = next(runs[best], None)
        if got is None:
            keys[best] = None
        else:
            lcp[best], keys[best] = got
        node = (best + k) // 2
        while node:
            other = tree[node]
            if keys[best] is None or (keys[other] is not None and lcp[other] >= lcp[best]):
                best, tree[node] = play(best, other)
            node //= 2


def _keys(length: int, parts: int):
    """A run's keys by part, of anchors that are marked as repeated and stand in no whole copy."""
    span = length - GRAM
    width = length + 1 + span + 1

    def run(data: np.ndarray, offsets: np.ndarray, marks: dict[int, bytes], copies: np.ndarray, wanted=None):
        """Yields part, sorted distinct keys, and of each of their places: document, offset, number of its
        key. Of the ``wanted`` parts only, if given."""
        copy = np.zeros(len(offsets) - 1, bool)
        copy[copies] = True
        x = Anchors(data, offsets, length)
        if not len(x.at):
            return
        order = np.argsort(x.hash, kind="stable")
        hashes = x.hash[order]
        new = np.diff(hashes, prepend=~hashes[:1]) != 0
        part = _part_of(hashes[new], parts)
        cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        mark, hot = np.concatenate([_marked(marks[int(part[a])], b - a) for a, b in zip(cut, cut[1:])], axis=1)
        of = np.cumsum(new) - 1
        keep = mark[of] & ~copy[x.doc[order]]
        take, hot = order[keep], hot[of][keep]  # by hash, so by part
        padded = np.concatenate([np.zeros(span, np.uint8), data, np.zeros(length, np.uint8)])
        after, ahead = (np.lib.stride_tricks.sliding_window_view(padded, n) for n in (length, span))
        every = [np.stack((x.at, x.low, x.high, x.doc))[:, take[~hot]]]
        all_parts = [_part_of(x.hash[take[~hot]], parts)]
        if hot.any():  # each window of a hot gram for itself
            t = take[hot]
            n = x.high[t] - x.low[t] + 1
            start = np.repeat(x.low[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
            every.append(np.stack((start, start, start, np.repeat(x.doc[t], n))))
            all_parts.append(np.concatenate([_part_of(_window_hash(after[start[a : a + BLOCK] + span]), parts) for a in range(0, len(start), BLOCK)]))
        every, all_parts = np.concatenate(every, axis=1), np.concatenate(all_parts)
        if hot.any():
            order = np.argsort(all_parts, kind="stable")
            every, all_parts = every[:, order], all_parts[order]
        cut = np.append(np.flatnonzero(np.diff(all_parts, prepend=-1)), len(all_parts))
        for a, b in zip(cut, cut[1:]):
            if wanted is not None and int(all_parts[a]) not in wanted:
                continue
            at, low, high, doc = every[:, a:b]
            right, before = high + length - at, at - low
            keys = np.empty((len(at), width), np.uint8)
            keys[:, :length] = after[at + span]
            keys[:, length] = right
            keys[:, length + 1 : -1] = ahead[at][:, ::-1]
            keys[:, -1] = before + 1
            for some, n, start in ((right, length, 0), (before, span, length + 1)):  # nothing beyond the windows
                short = np.flatnonzero(some < n)
                keys[short, start : start + n] *= np.arange(n) < some[short, None]
            sorted_, inverse = np.unique(keys.view(f"S{width}").ravel(), return_inverse=True)
            yield int(all_parts[a]), sorted_.view(np.uint8).reshape(-1, width), doc, at, inverse

    return run


def _suffix_blocks(length: int, parts: int):
    """A run's front-coded keys by part, each with the smallest and largest id that has it."""
    keys_of = _keys(length, parts)

    def run(run_id, blob: bytes, marks: dict[int, bytes], copies: np.ndarray):
        ids, data, offsets = _open(_rows(blob))
        for part, keys, doc, _, inverse in keys_of(data, offsets, marks, copies):
            order = np.argsort(inverse, kind="stable")
            first = np.flatnonzero(np.diff(inverse[order], prepend=-1))
            doc = ids[doc][order]
            lcp, rest = front_code(keys)
            yield run_id, part, _squeeze(lcp, np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first), np.frombuffer(rest, np.uint8))

    return run


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unsqueeze(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 * (n + 1), []
    for kind, size in zip(kinds, np.frombuffer(raw, "<i8", n, 8).tolist()):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


BLOCK_SCHEMA = "run long, part long, body binary"


def _judge(length: int):
    """Merges a part's runs; returns for each run the numbers of keys and the window offsets that a smaller
    id holds."""
    span = length - GRAM
    width = length + 1 + span + 1

    def flush(group, out):
        if len(group) == 1:
            _, r, i, _, lo, hi = group[0]
            if lo < hi:
                out(r, i, group[0][3], None, lo)
            return
        if all(g[0] == width for g in group[1:]):
            lo = min(g[4] for g in group)
            for _, r, i, key, _, hi in group:
                if lo < hi:
                    out(r, i, key, None, lo)
            return
        held: dict[bytes, int] = {}
        windows = []
        for _, r, i, key, lo, hi in group:
            right, left = key[length], key[length + 1 : -1][::-1]
            n = key[-1] - 1
            text = left[span - n :] + key[:right]
            own = [bytes((n - s,)) + text[s : s + length] for s in range(n + right - length + 1)]
            windows.append(own)
            for w in own:
                if held.get(w, hi + 1) > lo:
                    held[w] = lo
        for (_, r, i, key, lo, hi), own in zip(group, windows):
            s, n = 0, key[-1] - 1
            least = [held[w] for w in own]
            while s < len(least):  # equal neighbours at once
                e = s
                while e + 1 < len(least) and least[e + 1] == least[s]:
                    e += 1
                if least[s] < hi:
                    out(r, i, key, (n - e, n - s), least[s])
                s = e + 1

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens.forget()
        pdf = pdf.sort_values("run", kind="stable").reset_index(drop=True)
        lcps, least, most, rests = zip(*(_unsqueeze(x, "u1", "<i8", "<i8", "u1") for x in pdf["body"]))
        found: list[tuple[list, list, list, list]] = [([], [], [], []) for _ in range(len(pdf))]

        def out(r, i, key, windows, smallest):
            near, far = windows or (length - key[length], key[-1] - 1)
            a, b, c, d = found[r]
            a.append(i)
            b.append(near)
            c.append(far)
            d.append(smallest)

        seen, group = [0] * len(pdf), []
        for n, r, key in merge_runs([decode_front(a.tobytes(), b.tobytes(), width) for a, b in zip(lcps, rests)]):
            if n < GRAM and group:
                flush(group, out)
                group = []
            i = seen[r]
            seen[r] += 1
            group.append((n, r, i, key, int(least[r][i]), int(most[r][i])))
        if group:
            flush(group, out)
        kinds = "<u4", np.uint8, np.uint8, "<i8"
        rows = [(pdf["run"][r], pdf["part"][r], _squeeze(*map(np.array, x, kinds))) for r, x in enumerate(found) if x[0]]
        return pd.DataFrame(rows, columns=["run", "part", "reply"])

    def lean(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return judge(pdf)
        finally:
            tokens.trim()

    return lean


def covered(ids, data, offsets, keys, replies: dict[int, bytes], length: int) -> np.ndarray:
    """Marks of the bytes to remove, from the ``keys`` of :func:`_keys` and the replies by part."""
    step = np.zeros(len(data) + 1, np.int32)
    for part, _, doc, at, number in keys:
        told, near, far, smallest = _unsqueeze(replies[part], "<u4", "u1", "u1", "<i8")
        order = np.argsort(told, kind="stable")
        low, high = (np.searchsorted(told[order], number, side) for side in ("left", "right"))
        many = high - low  # a key may have several runs of windows
        place = np.repeat(np.arange(len(at)), many)
        which = order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
        hit = smallest[which] < ids[doc[place]]
        place, which = at[place[hit]], which[hit]
        np.add.at(step, place - far[which], 1)
        np.add.at(step, place - near[which] + length, -1)
    return np.cumsum(step[:-1], dtype=np.int32, out=step[:-1]) > 0


def cut_repeats(docs: DataFrame, length: int = LENGTH, run_bytes: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs(doc_id, text)``.

    Null texts count as empty. Rows that repeat an id are judged like other documents of that id:
    neither removes bytes of the other. A null id counts as larger than any other. An empty table
    gives an empty result; other columns are not read.
    """

    def shape(batch, data, offsets, gone) -> pa.Table:
        rows = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            g = gone[a:b]
            starts = np.count_nonzero(np.diff(g.view(np.int8), prepend=np.int8(0)) == 1)
            rows.append((b - a, int(g.sum()), starts, hashlib.sha256(data[a:b][~g].tobytes()).hexdigest()))
        names, kinds = ["n_bytes", "n_removed", "n_spans", "kept_sha256"], (pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        return pa.table([batch.column(0), *columns], ["doc_id", *names])

    return _judged(docs.select("doc_id", "text"), length, run_bytes, hot, shape, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_texts(docs: DataFrame, length: int = LENGTH, run_bytes: int | None = None) -> DataFrame:
    """``docs`` with the removed bytes cut out of ``text``; a character that lost a byte goes whole.
    All columns travel inside the runs, so no join follows."""
    columns = ["doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text"))]

    def shape(batch, data, offsets, gone) -> pa.Table:
        texts = [data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        return pa.table([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:]], columns)

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *quoted(columns[2:]))
    return _judged(typed, length, run_bytes, HOT, shape, typed.schema).select(quoted(docs.columns))


def _run_size(docs: DataFrame) -> int:
    """Bytes of a run, from the planner's estimate of the input's size."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(RUN_BYTES, (size * 40 * ROW_ANCHORS) ** 0.5), MOST_RUN_BYTES))


def _judged(docs: DataFrame, length: int, run_bytes: int | None, hot: int, shape, schema) -> DataFrame:
    if not GRAM <= length < GRAM + 128:
        raise ValueError(f"length must be from {GRAM} to {GRAM + 127}")
    run_bytes = run_bytes or _run_size(docs)
    runs = pack_runs(docs, run_bytes)
    total = runs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    per_anchor = (length - GRAM + 2) / 2
    parts = max(1, int(total / per_anchor) // PART_ANCHORS + 1, min(total >> 16, 12))
    parts = min(parts, max(12, int(run_bytes / per_anchor) // ROW_ANCHORS))
    spread = min(2 * parts, MOST_PARTITIONS)  # twice as many partitions as parts, so that few get several
    source = runs.select("run", "body")
    hashes = source.mapInArrow(tokens.lean(_hash_blocks(length, parts)), "run long, part long, hashes binary, own binary, many binary")
    marks = staged(hashes.repartition(spread, "part").groupBy("part").applyInPandas(_repeated(hot), "run long, part long, marks binary"))
    copies = whole_copies(source)
    none, no_list, no_part = F.lit(None).cast("binary").alias, F.lit(None).cast("array<int>").alias, F.lit(-1).cast("long").alias
    told = marks.withColumn("copies", F.lit(None).cast("array<int>")).unionByName(copies.select("run", no_part("part"), none("marks"), "copies"))
    form, keys_of = _suffix_blocks(length, parts), _keys(length, parts)

    def blocks(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tokens.forget()
        rows = []
        for run_id, body in zip(left["run"], left["body"]):
            rows += form(run_id, body, dict(zip(right["part"], right["marks"])), _copies(right))
        tokens.trim()
        return pd.DataFrame(rows, columns=["run", "part", "body"])

    exchanged = source.groupBy("run").cogroup(told.groupBy("run")).applyInPandas(blocks, BLOCK_SCHEMA)
    replies = exchanged.repartition(spread, "part").groupBy("part").applyInPandas(_judge(length), "run long, part long, reply binary")
    replies = told.withColumn("reply", none("reply")).unionByName(replies.select("run", "part", none("marks"), no_list("copies"), "reply"))

    def cut_run(body: bytes, told: dict[int, bytes], marks: dict[int, bytes], copies: np.ndarray) -> pa.Table:
        batch = _rows(body)
        ids, data, offsets = _open(batch)
        gone = covered(ids, data, offsets, keys_of(data, offsets, marks, copies, told) if told else (), told, length)
        for k in copies:
            if offsets[k + 1] - offsets[k] >= length:
                gone[offsets[k] : offsets[k + 1]] = True
        return shape(batch, data, offsets, gone)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens.forget()
        right = right.to_pandas()
        told = {part: reply for part, reply in zip(right["part"], right["reply"]) if reply is not None}
        marks = {part: mark for part, mark in zip(right["part"], right["marks"]) if mark is not None}
        copies, out = _copies(right), []
        for body in left.column("body"):
            out.append(cut_run(body.as_py(), told, marks, copies))
            tokens.trim()
        return pa.concat_tables(out)

    return source.groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(cut, schema)
