"""Concept lists and tables from CSV files of several layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import concepts as C

#: Header names of wide tables that are not concepts.
NOT_CONCEPTS = {"domain", "doi", "title", "paper"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings: labels that look like numbers stay labels, and words such as "NA" are
    kept as words. Quoted cells may hold line feeds and doubled quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _column(df: DataFrame, name: str) -> str | None:
    return next((c for c in df.columns if c.strip().lower() == name.lower()), None)


def concept_column(df: DataFrame, column: str = "concept") -> DataFrame:
    """concept: the cleaned labels of a column, without nulls and blanks."""
    c = X.clean_label(F.col(f"`{_column(df, column)}`"))
    return df.select(c.alias("concept")).where(~X.missing(F.col("concept")))


def header_concepts(df: DataFrame) -> list[str]:
    """A wide table's headers as concepts, case kept, base columns left out."""
    return [c for c in df.columns if c.strip().lower() not in NOT_CONCEPTS]


def concept_list(df: DataFrame, column: str = "concept", most: int = 10_000) -> list[str]:
    """Concepts of a file: its column, or its headers if it has no such column. The list goes to the
    driver and into plans, so its length is checked."""
    if _column(df, column) is None:
        return header_concepts(df)
    rows = [r[0] for r in concept_column(df, column).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} concepts")
    return rows


def load_concepts(df: DataFrame) -> DataFrame:
    """concept, doc_frequency from any known layout, told by its headers: rankings (taken as they are),
    canonical concept rows, or short concept rows; most frequent first."""
    names = {c.strip().lower(): f"`{c}`" for c in df.columns}
    if {"concept", "doc_frequency"} <= names.keys():
        out = df.select(X.strip(F.col(names["concept"])).alias("concept"), F.col(names["doc_frequency"]).cast("long").alias("doc_frequency"))
    elif "canonical" in names:
        out = C.paper_frequency(df.select(F.col(names["paper"]).alias("paper"), X.clean_label(F.col(names["canonical"])).alias("concept")))
    elif {"concept", "paper"} <= names.keys():
        out = C.paper_frequency(df.select(F.col(names["paper"]).alias("paper"), X.clean_label(F.col(names["concept"])).alias("concept")))
    else:
        raise ValueError(f"unknown concept file layout: {df.columns}")
    return out.where(~X.missing(X.strip(F.col("concept")))).orderBy(F.desc("doc_frequency"), "concept")
