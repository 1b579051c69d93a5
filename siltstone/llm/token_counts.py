"""Token counts by overlap resynchronisation.

A text longer than a chunk is encoded as overlapping chunks, each with its tokens' byte offsets.
Neighbours are spliced at a boundary that both encodings have inside their overlap and that is
stable (see ``tokens``), so that the left ids before it and the right ids after it are those of the
whole text. An overlap without a stable boundary is doubled until it has one, before anything is
encoded; a stretch without any, however long, becomes part of one chunk. Neighbours whose encodings
do not both have the boundary are joined and encoded again. So every byte is encoded about once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import STABLE, ByteBpe, load, slices

CHUNK, OVERLAP = 1 << 14, 128


def _char_start(text: bytes, at: int) -> int:
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def overlapping(text: bytes, chunk: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, splice): chunks, each with its end in the next chunk's overlap and the stable
    boundary there; the last ends with the text."""
    out, start, at = [], 0, chunk
    while at < len(text):
        right, wide = _char_start(text, at), overlap
        while True:
            end = min(right + wide, len(text))
            if (found := STABLE.search(text, right, end)) or end == len(text):
                break
            wide *= 2
        if not found:
            break
        out.append((start, _char_start(text, end), found.end()))
        start, at = right, max(at + chunk, found.end())
    return [*out, (start, len(text), len(text))]


def spliced_ids(text: bytes, bpe: ByteBpe, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The whole text's ids."""
    chunks, done = overlapping(text, chunk, overlap), {}
    while True:
        new = [c for c in chunks if c not in done]
        done.update(zip(new, bpe.encode_all([text[a:b].decode() for a, b, _ in new])))
        out, low, joined = [], 0, []
        for a, b, high in chunks:
            offsets = np.concatenate(([a], a + np.cumsum(bpe.sizes[done[a, b, high]])))
            i, j = np.searchsorted(offsets, (low, high))
            aligned = offsets[i] == low, offsets[j] == high
            if joined and not (joined[-1][1] and aligned[0]):  # the two encodings do not share the boundary
                joined[-1] = ((joined[-1][0][0], b, high), aligned[1])
            else:
                joined.append(((a, b, high), aligned[1]))
            out += done[a, b, high][i:j]
            low = high
        if len(joined) == len(chunks):
            return out
        chunks = [c for c, _ in joined]


def token_counts(docs: DataFrame, path: str, ranks_path: str | None = None, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs(doc_id, text)``.

    Null texts count as empty. Repeated rows give repeated results; an empty table an empty one;
    other columns are not read. No shuffle; a task holds one batch of texts. White space of any length
    counts as the library has it.
    """

    def run(batches):
        bpe = load(ByteBpe, path, ranks_path)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or b"" for t in part.column(1).to_pylist()]
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                counts = np.zeros(len(texts), np.int64)
                counts[short] = list(map(len, bpe.encode_all([texts[i].decode() for i in short])))
                for i, t in enumerate(texts):
                    if len(t) > chunk:
                        counts[i] = len(spliced_ids(t, bpe, chunk, overlap))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
