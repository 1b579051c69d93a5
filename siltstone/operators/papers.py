"""Filters and reports over papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.ordinals import numbered


def with_abstract(papers: DataFrame) -> DataFrame:
    return papers.where(~X.missing(F.col("abstract")))


def with_any_text(papers: DataFrame) -> DataFrame:
    return papers.where(~X.missing(F.col("abstract")) | ~X.missing(F.col("full_text")))


def missing_text(papers: DataFrame) -> DataFrame:
    """Titles without full text; the texts themselves are not read further than their emptiness."""
    return papers.where(X.missing(F.col("full_text"))).select("title")


def chosen_text(papers: DataFrame, most: int = 80_000) -> DataFrame:
    """``papers`` plus text: the full text, else the abstract, cut to ``most`` characters."""
    return papers.withColumn("text", F.substring(X.prefer(F.col("full_text"), F.col("abstract")), 1, most))


def progress(papers: DataFrame) -> DataFrame:
    """``papers`` plus progress: ``[i/n] title`` in the collection's order; no task sees a whole collection."""
    order = ["pos", *[c for c in ("key",) if c in papers.columns]]
    found = numbered(papers, order, ["collection"], "_place", "_total")
    return found.select(*papers.columns, F.format_string("[%d/%d] %s", "_place", "_total", F.substring("title", 1, 70)).alias("progress"))


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns that the table has, in the order named."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def union_collections(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
