"""One label for the spellings of a concept: an index of labels with letters left out.

Labels within two edits (one for shorter labels) are linked, linked labels are one concept, and its most
frequent label names it. Nothing compares all labels of a group: each label is filed under what is left of
it without one or two letters, in such a way that a file's labels are all near each other, or near
one of them, so links to a single one of them join them all:

* one letter out at the same place: all differ in that letter;
* one letter out at any place, same length: all are an insertion and a deletion apart;
* two letters out at the same places: all differ in these letters;
* a label as it is, with those that give it by one or two letters out: all are near that label;
* a label with one letter out, with those that have that letter (or another) and one more out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.graph import components
from siltstone.operators.staging import staged

BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: Labels of more letters are texts rather than labels and stand alone.
LONGEST = 100


def edits(length, one_from: int = 5, two_from: int = 8, longest: int = LONGEST):
    """Edits allowed for a label of a length (a column)."""
    return F.when(length > longest, 0).when(length >= two_from, 2).when(length >= one_from, 1).otherwise(0)


def _files(letters: np.ndarray, two: bool):
    """(row, key, centre) of labels of one length as rows of letters: under which keys each is filed, and whether links
    may go to it there."""
    n, size = letters.shape
    power = np.full(size, BASE, np.uint64)
    power[:1] = 1
    term = letters.astype(np.uint64) * np.multiply.accumulate(power)
    sums = np.concatenate((np.zeros((n, 1), np.uint64), np.cumsum(term, axis=1, dtype=np.uint64)), axis=1)
    whole, before, after = sums[:, -1:], sums[:, :-1], sums[:, -1:] - sums[:, 1:]
    one = before + after * np.uint64(BACK)
    place = np.arange(size)

    def of(hashes, kind, numbers, centre):
        key = hashes + (np.asarray(numbers, np.uint64) * np.uint64(8) + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        key = key ^ (key >> np.uint64(29))
        return np.repeat(np.arange(n), key.shape[1]), key.ravel(), np.full(key.size, centre)

    yield of(one, 1, place, True)
    yield of(whole, 2, [0], True)
    yield of(one, 2, [0], False)
    if two:
        yield of(one, 3, [size], True)
        p, q = np.triu_indices(size, 1)
        pair = before[:, p] + (sums[:, q] - sums[:, p + 1]) * np.uint64(BACK) + after[:, q] * np.uint64(BACK) * np.uint64(BACK)
        yield of(pair, 4, p * size + q, True)
        yield of(whole, 5, [0], True)
        yield of(pair, 5, [0], False)
        yield of(one, 6, place, True)
        yield of(pair, 6, p, False)
        yield of(pair, 6, q - 1, False)


def near_links(labels: DataFrame) -> DataFrame:
    """a, b (ids) of ``labels(id, label)``, distinct labels: links within their edits, enough of them that labels are
    connected as by all such links."""

    def run(batches):
        for batch in batches:
            ids, groups = batch.column(0).to_numpy(), {}
            for i, (label, allowed) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                groups.setdefault((len(label), allowed), []).append((i, label))
            for (size, allowed), some in groups.items():
                step = max(1, (1 << 18) // (size * size))
                for at in range(0, len(some), step):
                    rows, texts = zip(*some[at : at + step])
                    letters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(-1, size)
                    for row, key, centre in _files(letters, allowed == 2):
                        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(ids[np.array(rows)[row]]), pa.array(centre)], ["key", "id", "centre"])

    sized = labels.withColumn("allowed", edits(F.length("label"))).where("allowed > 0")
    filed = sized.select("id", "label", "allowed").mapInArrow(run, "key long, id long, centre boolean")
    centre = F.min(F.when(F.col("centre"), F.col("id"))).over(Window.partitionBy("key"))
    links = filed.withColumn("to", centre).where("to <> id").select("id", "to").distinct()
    # the keys are hashes, so what they say is looked at once more
    one, other = (sized.select(F.col("id").alias(i), F.col("label").alias(f"{i}_label"), F.col("allowed").alias(f"{i}_allowed")) for i in ("id", "to"))
    seen = links.join(one, "id").join(other, "to")
    distance = F.levenshtein("id_label", "to_label", 2)
    return seen.where((distance >= 0) & (distance <= F.least("id_allowed", "to_allowed"))).select(F.col("id").alias("a"), F.col("to").alias("b"))


def canonical_labels(frequency: DataFrame) -> DataFrame:
    """label, canonical, doc_frequency of ``frequency(concept, doc_frequency)``: of the labels joined by links the most
    frequent one, ties alphabetical. Labels are cleaned, repeated ones added up; null and blank ones go."""
    cleaned = frequency.select(X.clean_label(F.col("concept")).alias("label"), "doc_frequency").where(~X.missing(F.col("label")))
    counted = cleaned.groupBy("label").agg(F.sum("doc_frequency").alias("doc_frequency"))
    labels = staged(counted.withColumn("id", F.monotonically_increasing_id()))
    found = components(near_links(labels))
    grouped = labels.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = grouped.groupBy("component").agg(F.min_by("label", F.struct(-F.col("doc_frequency"), "label")).alias("canonical"))
    return grouped.join(best, "component").select("label", "canonical", "doc_frequency")


def normalized(frequency: DataFrame, most: int = 80) -> DataFrame:
    """concept, doc_frequency: the ``most`` most frequent canonical labels with the counts of all their spellings; what
    normalisation gives without a model."""
    sums = canonical_labels(frequency).groupBy(F.col("canonical").alias("concept")).agg(F.sum("doc_frequency").alias("doc_frequency"))
    return sums.orderBy(F.desc("doc_frequency"), "concept").limit(most)
