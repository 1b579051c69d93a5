"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash of the last bytes cuts texts into chunks, so a passage shared by many documents
gives the same chunks wherever it stands. Every distinct chunk in a task is encoded once. A chunk's
ids hold in any context only between its first and last stable boundary (see ``tokens``), so each
join of two chunks is repaired: what lies between the last stable boundary on the left and the
first one on the right is encoded again, widened over further chunks until both its ends are
stable. The result agrees exactly with encoding the whole text.

Reuse is within a task's cache of bounded size; sharing chunks across tasks would shuffle the
whole corpus, which costs more than the encoding it saves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import LAST_STABLE, STABLE, ByteBpe, load, slices

MASK, CACHE = 511, 8 << 20


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Offsets at which the rolling hash of the 16 bytes before cuts; never inside a character."""
    if len(data) < 17:
        return np.zeros(0, np.int64)
    h, factor = data.astype(np.uint32) * np.uint32(2654435761), np.full(1, 0x01000193, np.uint32)
    span = 1
    while span < 16:
        h = h[:-span] * factor + h[span:]
        factor, span = factor * factor, span * 2
    h ^= h >> np.uint32(15)
    cut = np.flatnonzero((h[:-1] & np.uint32(MASK)) == 0) + 16
    return cut[(data[cut] & 0xC0) != 0x80]


class ChunkCodec:
    def __init__(self, bpe: ByteBpe, limit: int = CACHE):
        self.bpe, self.limit, self.held, self.known, self.split = bpe, limit, 0, {}, {}

    def _parts(self, chunk: bytes) -> tuple[bytes, bytes | None, bytes]:
        """Head, core and tail around the first and last stable boundary; core None without one."""
        if (found := self.split.get(chunk)) is None:
            first = STABLE.search(chunk)
            if first is None:
                found = (chunk, None, b"")
            else:
                last = LAST_STABLE.match(chunk).end()
                found = (chunk[: first.end()], chunk[first.end() : last], chunk[last:])
            self.split[chunk] = found
        return found

    def spans(self, text: bytes) -> list[bytes]:
        """The text as chunk cores and repaired joins; their ids, one after another, are the text's."""
        ends = chunk_ends(np.frombuffer(text, np.uint8)).tolist()
        out, open_ = [], []
        for a, b in zip([0, *ends], [*ends, len(text)]):
            head, core, tail = self._parts(text[a:b])
            open_.append(head)
            if core is not None:
                out += [b"".join(open_), core]
                open_ = [tail]
        return [s for s in [*out, b"".join(open_)] if s]

    def encode(self, texts: list[bytes]) -> list[list[tuple[str, int, bytes]]]:
        """For each text its spans' (ids joined by commas, number of ids, decoded bytes)."""
        if self.held > self.limit:
            self.known, self.split, self.held = {}, {}, 0
        spans = [self.spans(t) for t in texts]
        new = list({s for doc in spans for s in doc if s not in self.known})
        for s, ids in zip(new, self.bpe.encode_all([s.decode() for s in new])):
            self.known[s] = (",".join(map(str, ids)), len(ids), self.bpe.decode(ids))
            self.held += len(s)
        return [[self.known[s] for s in doc] for doc in spans]


def encode_decode(docs: DataFrame, path: str, ranks_path: str | None = None) -> DataFrame:
    """doc_id, ids (comma-joined), n_tokens, decoded for every row of ``docs(doc_id, text)``.

    Null texts count as empty: no ids. Repeated rows give repeated results; an empty table an empty
    one; other columns are not read. White space of any length is encoded as the library does.
    """
    return _mapped(docs, path, ranks_path, "doc_id long, ids string, n_tokens long, decoded string", lambda ids, out: [ids, out])


def digests(docs: DataFrame, path: str, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: :func:`encode_decode` as digests."""
    return _mapped(docs, path, ranks_path, "doc_id long, ids_sha256 string, n_tokens long, decoded_sha256 string", lambda ids, out: [hashlib.sha256(x.encode()).hexdigest() for x in (ids, out)])


def _mapped(docs: DataFrame, path: str, ranks_path: str | None, schema: str, shape) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        codec = ChunkCodec(load(ByteBpe, path, ranks_path))
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for spans in codec.encode([t or b"" for t in part.column(1).to_pylist()]):
                    a, b = shape(",".join(s[0] for s in spans), b"".join(s[2] for s in spans).decode("utf-8", "replace"))
                    rows.append((a, sum(s[1] for s in spans), b))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string())))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)
