"""Concept tables: frequencies, rankings, vocabularies, top-n, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X


def phrase_frequency(phrases: DataFrame) -> DataFrame:
    """concept, doc_frequency from ``phrases(paper, phrases array)``: each phrase once for a paper."""
    # an outer explode: for the other kind the planner computes the phrases once more, to drop empty ones
    one = phrases.select(F.explode_outer(F.array_distinct("phrases")).alias("concept")).where("concept IS NOT NULL")
    return one.groupBy("concept").agg(F.count(F.lit(1)).alias("doc_frequency"))


def min_docs(frequency: DataFrame, least: int, top_n: int) -> DataFrame:
    """Phrases in at least ``least`` papers, or all if that leaves fewer than ``top_n``. The count is
    one scalar subquery, not a pass over the driver."""
    enough = frequency.where(F.col("doc_frequency") >= least).agg(F.count(F.lit(1)).alias("n"))
    return frequency.where((enough.scalar() < top_n) | (F.col("doc_frequency") >= least))


def vocabulary(frequency: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` most frequent phrases (ties alphabetical), alphabetically."""
    return frequency.orderBy(F.desc("doc_frequency"), "concept").limit(top_n).orderBy("concept")


def rankings(rows: DataFrame) -> DataFrame:
    """concept, doc_frequency (rows), avg_relevance; best first, ties by concept."""
    out = rows.groupBy("concept").agg(F.count("paper").alias("doc_frequency"), F.avg("relevance").alias("avg_relevance"))
    return out.orderBy(F.desc("doc_frequency"), F.desc("avg_relevance"), "concept")


def paper_frequency(rows: DataFrame) -> DataFrame:
    """concept, doc_frequency (distinct papers). De-duplicates first, so a concept that most papers
    have is counted by partial sums and not by one task's set of papers."""
    return rows.select("concept", "paper").where("paper IS NOT NULL").distinct().groupBy("concept").agg(F.count(F.lit(1)).alias("doc_frequency"))


def top_concepts(ranked: DataFrame, n: int = 80) -> DataFrame:
    order = [F.desc("doc_frequency"), *([F.desc("avg_relevance")] if "avg_relevance" in ranked.columns else []), F.asc("concept")]
    return ranked.orderBy(*order).limit(n)


def top_n_per_paper(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` most relevant rows of each paper; a missing relevance counts 0, ties keep ``pos`` order.
    Spark filters ranks before the shuffle too, so a paper with very many rows sends n of each task."""
    order = Window.partitionBy("paper").orderBy(F.desc(F.coalesce("relevance", F.lit(0.0))), "pos")
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def unique_labels(rows: DataFrame, column: str = "concept") -> DataFrame:
    return rows.select(X.clean_label(F.col(column)).alias("concept")).where(~X.missing(F.col("concept"))).distinct()


def normalize_fallback(labels: DataFrame, most: int = 80) -> DataFrame:
    """The first ``most`` unique labels alphabetically: what normalisation gives without a model."""
    return labels.select("concept").where(~X.missing(F.col("concept"))).distinct().orderBy("concept").limit(most)


def label_variants(rows: DataFrame, column: str = "concept") -> DataFrame:
    """Labels that only differ in hyphens, spaces or a plural s, with the most frequent one as canonical."""
    key = F.regexp_replace(F.regexp_replace(F.col("label"), "[-_ ]+", " "), "(?<=[a-z]{3})s$", "")
    counted = rows.select(X.clean_label(F.col(column)).alias("label")).groupBy("label").count().withColumn("key", key)
    best = counted.groupBy("key").agg(F.min_by("label", F.struct(-F.col("count"), F.col("label"))).alias("canonical"))
    return counted.join(best, "key").select("label", "canonical")


def batches(concepts: DataFrame, size: int = 40) -> DataFrame:
    """``concepts`` (concept, doc_frequency) with batch: fixed-size groups in order of frequency.

    Rows are numbered within groups of equal frequency and equal first letters, from the place where
    their group starts. Those places are summed in two steps: within each power of two of the
    frequency, and over these powers, 65 rows at most; so no task sees all concepts or all groups.
    Rows without a concept are left out.
    """
    power = F.floor(F.log2(F.greatest(F.col("doc_frequency"), F.lit(1)))).alias("_power")
    keyed = concepts.where("concept IS NOT NULL AND doc_frequency IS NOT NULL").withColumn("_head", F.substring("concept", 1, 4))
    group = ["doc_frequency", "_head"]
    earlier = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = keyed.groupBy(*group).count().select("*", power)
    powers = counts.groupBy("_power").agg(F.sum("count").alias("count")).select("_power", earlier(Window.orderBy(F.desc("_power"))).alias("_base"))
    inside = counts.select(*group, "_power", earlier(Window.partitionBy("_power").orderBy(F.desc("doc_frequency"), "_head")).alias("_in"))
    starts = inside.join(F.broadcast(powers), "_power").select(*group, (F.col("_base") + F.col("_in")).alias("_before"))
    numbered = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy(*group).orderBy("concept")))
    return numbered.join(starts, group).select(*concepts.columns, F.floor((F.col("_before") + F.col("_nth") - 1) / size).cast("int").alias("batch"))
