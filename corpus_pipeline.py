"""A training-data pipeline over ``documents``: score, de-duplicate exactly and nearly, cut repeated
passages, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Stages are written as Parquet and read again in between.

All stages take empty tables (and give empty ones), null and empty texts (a null counts as empty, but
stays null where a stage keeps it), texts of any length, and tables with more columns, whatever
their names; only those of ``documents`` go on.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, packing, quality, simhash, substring_dedup
from siltstone.llm.common import scratch, staged, table
from siltstone.llm.tokens import default_path
from siltstone.llm.without import without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark, docs, sf_dir):
    """Rows that the quality ranker, fitted on this stage's input, predicts good. Each row is judged by
    its text alone, so repeated rows share their fate and a null id makes no difference; without
    labels of both kinds all rows stay."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).select(COLUMNS)


def drop_copies(spark, docs, sf_dir):
    """Of equal texts the row with the smallest doc_id; a null id is larger than any other. Rows that
    share an id are judged by their texts, and of rows that repeat both id and text one stays."""
    return exact_dedup.drop_exact_copies(docs).select(COLUMNS)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group stays: the smallest doc_id, which names the group, so no group is
    gathered. Groups are linked by five-word shingles at a similarity of 0.8 or more. Texts without
    a word are one group. Rows that share an id go or stay together; rows without an id always stay,
    as nothing names them. No text is shuffled to drop rows."""
    found = simhash.similar_documents(docs, similarity=0.8, shingle=5)
    gone = staged(found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct())
    return without(docs, gone).select(COLUMNS)


def cut_repeats(spark, docs, sf_dir):
    """Texts without the bytes that :mod:`substring_dedup` removes; characters that lost a byte go
    whole. Documents with nothing left are dropped, null and empty ones too; n_chars follows the text. A
    null id is larger than any other, and rows that share an id take nothing from each other."""
    cut = substring_dedup.cut_texts(docs.select(COLUMNS)).where("text <> ''")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark, docs, sf_dir):
    """Token pieces with their sequence and offset; each row, repeated or without an id, has pieces of
    its own, a null or empty text one of the end id."""
    return packing.pack_documents(docs, default_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: The ranker, SimHash, byte strings and tokenizers cannot be written in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``, each staged in the shared folder before the next reads it. What a
    stage staged for itself goes when it ends."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), outlive=True)
    return STAGES[-1][1](spark, docs, sf_dir)
