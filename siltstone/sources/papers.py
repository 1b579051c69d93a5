"""Paper collections: catalog, items, attachments, and papers with their text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import text as X
from siltstone.sources import pdf_text


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """name, key of all collections, from JSON lines; of a repeated name the last one counts."""
    return catalog(spark.read.schema("name string, key string, pos long").json(path))


def catalog(raw: DataFrame) -> DataFrame:
    """name, key of ``raw(name, key, pos)``: the last key of each name."""
    return raw.groupBy("name").agg(F.max_by("key", F.coalesce("pos", F.lit(0))).alias("key"))


def collection_key(catalog: DataFrame, name: str) -> DataFrame:
    return catalog.where(F.col("name") == name).select("key")


def search_catalog(catalog: DataFrame, query: str) -> DataFrame:
    """Collections whose name contains the query, whatever its case, by name."""
    return catalog.where(F.contains(F.lower("name"), F.lit(query.lower()))).orderBy("name")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items from JSON lines; ``pos`` is their order in the collection."""
    return spark.read.schema(schemas.ITEMS).json(path)


def real_items(items: DataFrame) -> DataFrame:
    """Without attachments, notes and untitled items; an item without a type stays."""
    return items.where(~F.coalesce("item_type", F.lit("")).isin("attachment", "note") & ~X.missing(F.col("title")))


def last_by(df: DataFrame, key, order: str = "pos", keep_first_place: bool = True) -> DataFrame:
    """One row for each key: the last by ``order``, at the place of the first, like an overwritten
    dictionary entry. One shuffle, by the key; the aggregate combines on the map side."""
    fields = F.struct(*[c for c in df.columns if c != order])
    out = df.groupBy(key.alias("_key")).agg(F.max_by(fields, order).alias("_row"), (F.min if keep_first_place else F.max)(order).alias(order))
    return out.select(order, "_row.*").select(df.columns)


def first_text(attachments: DataFrame, parse: Callable[[bytes], str] | None = None) -> DataFrame:
    """item_key, full_text: of each item the first PDF that parses, even to an empty text.

    ``attachments(item_key, pos, content_type, content)``; ``parse`` takes bytes and may raise, which
    moves on to the next attachment. The default takes the content as UTF-8 text.
    """
    pdfs = attachments.where(F.col("content_type") == "application/pdf").select("item_key", "pos", "content")

    def run(frames):
        for pdf in frames:
            rows = []
            for key, pos, content in zip(pdf["item_key"], pdf["pos"], pdf["content"]):
                try:
                    rows.append((key, pos, (parse or (lambda b: b.decode()))(bytes(content))))
                except Exception:  # noqa: BLE001  any parser's failure means: try the next attachment
                    continue
            yield pd.DataFrame(rows, columns=["item_key", "pos", "full_text"])

    parsed = pdfs.mapInPandas(run, "item_key string, pos long, full_text string")
    return parsed.groupBy("item_key").agg(F.min_by("full_text", "pos").alias("full_text"))


def page_texts(attachments: DataFrame, pages: Callable[[bytes], list[str]] = pdf_text.page_texts) -> DataFrame:
    """item_key, pos, page, text, error: one row a page (from 0) of every PDF among
    ``attachments(item_key, pos, content_type, content)``; one that cannot be read is one row with an error."""
    schema = pa.schema([("item_key", pa.string()), ("pos", pa.int64()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())])

    def rows(key, pos, content):
        try:
            return [(key, pos, i, text, None) for i, text in enumerate(pages(content or b""))]
        except Exception as e:  # noqa: BLE001  a file that cannot be read must not lose the others
            return [(key, pos, None, None, f"{type(e).__name__}: {e}")]

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for row in zip(*(batch.column(i) for i in range(3))):  # a file at a time
                found = rows(*(x.as_py() for x in row))
                held += found
                size += sum(len(r[3] or "") for r in found)
                if size > 1 << 20 or len(held) > 1 << 12:
                    yield record(held)
                    held, size = [], 0
            if held:
                yield record(held)

    def record(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    pdfs = attachments.where(F.col("content_type") == "application/pdf").select("item_key", F.col("pos").cast("long").alias("pos"), "content")
    return pdfs.mapInArrow(run, "item_key string, pos long, page int, text string, error string")


def read_attachment_files(spark: SparkSession, path: str) -> DataFrame:
    """Attachments from files ``<item_key>/<name>.pdf`` below ``path``, in order of name."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    key = F.element_at(F.split("path", "/"), -2)
    return raw.select(key.alias("item_key"), "path", "content").select(
        "item_key", F.row_number().over(Window.partitionBy("item_key").orderBy("path")).cast("long").alias("pos"), F.lit("application/pdf").alias("content_type"), "content"
    )


def papers(items: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Papers of a collection: real items joined with their text, one for each title whatever its case.
    Items are de-duplicated before the join, so no text is moved for a row that goes."""
    kept = last_by(real_items(items), F.lower("title"))
    if texts is None:
        return kept.withColumn("full_text", F.lit(""))
    joined = kept.join(texts.select(F.col("item_key").alias("key"), "full_text"), "key", "left")
    return joined.withColumn("full_text", F.coalesce("full_text", F.lit(""))).select(schemas.PAPERS.fieldNames())


def title_texts(items: DataFrame, texts: DataFrame) -> DataFrame:
    """title, full_text by exact title; the last item of a title counts."""
    kept = last_by(real_items(items), F.col("title")).select(F.col("key").alias("item_key"), "title")
    return kept.join(texts, "item_key", "left").select("title", F.coalesce("full_text", F.lit("")).alias("full_text"))
