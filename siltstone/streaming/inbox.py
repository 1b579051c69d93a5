"""Paper records that arrive as files: the batch operators over Structured Streaming.

The checkpoint folder makes a broken run resume where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from siltstone.functions import text as X
from siltstone.sources.papers import real_items


def read_inbox(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)


def new_papers(items: DataFrame, event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """Real items, the first of each title whatever its case. With an event time, titles are
    remembered for as long as late records are awaited, so state is bounded."""
    titled = real_items(items).withColumn("title_key", F.lower("title"))
    if event_time is None:
        return titled.dropDuplicates(["title_key"])
    return titled.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["title_key"])


def stream_rankings(rows: DataFrame) -> DataFrame:
    """Running rankings of a stream of (paper, concept, relevance); for complete mode, which sorts."""
    out = rows.groupBy("concept").agg(F.count("paper").alias("doc_frequency"), F.avg("relevance").alias("avg_relevance"))
    return out.orderBy(F.desc("doc_frequency"), F.desc("avg_relevance"), "concept")


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataStreamWriter:
    """Applies a batch operator to every micro-batch. Each batch has its own folder and overwrites
    it, so a batch that is run again after a failure leaves no repeated rows."""

    def run(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def sentence_stream(papers: DataFrame, term: str) -> DataFrame:
    """paper, sentence: matching sentences of a stream of papers; stateless."""
    return papers.select("paper", F.explode(X.matching(X.sentences(F.col("text")), F.lit(term))).alias("sentence"))
