"""Exact de-duplication with a heavy-hitter split, in DataFrame functions only.

1. Every text is white-space-normalised and digested (SHA-256); only (id, digest) is staged.
2. A frequent-items sketch (``approx_top_k``, a mergeable Misra-Gries summary of fixed size) names
   digests that may hold many rows. Its counts are estimates, so the candidates are counted again
   exactly; the verified winners are at most ``max_frequent`` rows whatever the input's size.
3. Winners are broadcast: rows of frequent digests get their keeper on the map side and never
   meet in one task. What remains has no large group and is shuffled by digest as usual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_name, staged
from .without import without

#: Bounds of the broadcast winners and of the sketch.
MAX_FREQUENT, TRACKED = 2048, 16384
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def text_digest(text) -> "F.Column":
    """SHA-256 (32 bytes) of the text, null as empty, each white-space run as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " "), 256))


def frequent_digests(digests: DataFrame, max_frequent: int, tracked: int) -> DataFrame:
    """Verified frequent digests: digest, keep_id, group_size; at most ``max_frequent`` candidates."""
    key = F.xxhash64("digest")
    sketch = digests.agg(F.expr(f"approx_top_k(xxhash64(digest), {max_frequent}, {tracked})").alias("top"))
    candidates = sketch.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("k"))
    rows = digests.withColumn("k", key).join(F.broadcast(candidates), "k", "left_semi")
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")


def with_keeper(digests: DataFrame, max_frequent: int, tracked: int) -> DataFrame:
    """``digests`` (digest, doc_id and any others) plus keep_id and group_size of the row's digest."""
    frequent = staged(frequent_digests(digests, max_frequent, tracked))
    hot = digests.join(F.broadcast(frequent), "digest")
    same = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(frequent), "digest", "left_anti")
    rest = rest.withColumn("keep_id", F.min("doc_id").over(same)).withColumn("group_size", F.count(F.lit(1)).over(same))
    return hot.unionByName(rest)


def exact_dedup(docs: DataFrame, max_frequent: int = MAX_FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs(doc_id, text)``.

    Null texts equal empty ones. Rows that repeat an id share that id's fate: each counts in
    group_size, and all of them are kept if the id is the group's smallest. A null id is never the
    smallest unless the group has no other. An empty table gives an empty result; columns other
    than doc_id and text are not read.
    """
    digests = staged(docs.select("doc_id", text_digest(F.col("text")).alias("digest")))
    return with_keeper(digests, max_frequent, tracked).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, max_frequent: int = MAX_FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """One row of each group of equal texts: that of the smallest id, all columns of ``docs``.

    Null texts equal empty ones; a null id is larger than any other. A row is told by its id and text
    together, so texts that share an id are judged each for itself; rows that repeat both are one row,
    any of them. Columns may have any names. An empty table gives an empty result.

    No text is shuffled for a row whose id is its own: rows are split by :func:`without.without` into those whose id
    has a row to drop and those to keep as they are, and only of ids with several rows are the digests
    told apart, for which these rows meet their digests.
    """
    doc_id, digest, keep, rows, several = (new_name(docs, n) for n in ("id", "digest", "keep", "rows", "several"))
    found = staged(with_keeper(staged(docs.select("doc_id", text_digest(F.col("text")).alias("digest"))), max_frequent, tracked))
    # by id: does any row go, and do rows of the same id differ in what becomes of them?
    gone = found.withColumn("goes", (~F.col("doc_id").eqNullSafe(F.col("keep_id"))).cast("int")).groupBy("doc_id").agg(F.max("goes").alias("goes"), F.count(F.lit(1)).alias("n"))
    gone = staged(gone.where("goes = 1 OR n > 1").select(F.col("doc_id").alias(doc_id), (F.col("n") > 1).alias(several)))
    same = F.col("doc_id").eqNullSafe(F.col(doc_id))
    out = without(docs, gone.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id")))
    if not gone.where(F.col(doc_id).isNull()).isEmpty():
        out = out.where(F.col("doc_id").isNotNull())
    twice = gone.where(several)
    if twice.isEmpty():
        return out
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(doc_id), F.col("digest").alias(keep)).distinct()
    kept = staged(kept.join(twice.select(F.col(doc_id).alias(rows)), F.col(doc_id).eqNullSafe(F.col(rows)), "left_semi"))
    some = docs.join(twice, same, "left_semi").withColumn(digest, text_digest(F.col("text")))
    some = some.join(kept, F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col(digest) == F.col(keep)), "left_semi")
    return out.unionByName(some.dropDuplicates(["doc_id", digest]).drop(digest))


ORACLE = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h FROM documents)
"""
