"""Rankings that are kept up to date: each batch of a stream is summed, and sums are merged.

A concept's partial result is the number of its rows, the exact sum of their relevance and the number of
papers not seen with it before. Partial results add up, so the ranking after any number of batches is that of
all rows at once, however they were split. Every batch has folders of its own and reads only those of
earlier batches, so one that is run again after a failure gives the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from siltstone.sources.files import parquet_if_any

SUMS = "concept string, n long, scored long, total decimal(38,12), papers long"


@dataclass(frozen=True)
class Rankings:
    """A folder with the sums after each batch, and the papers that each batch was the first to name with a concept."""

    folder: str

    def _sums(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The sums after the last batch, or the last one before a batch."""
        kept = parquet_if_any(spark, f"{self.folder}/sums", f"{SUMS}, batch long")
        kept = kept if before is None else kept.where(F.col("batch") < before)
        last = kept.agg(F.max("batch")).first()[0]  # one folder is then read
        return kept.where(F.col("batch") == F.lit(last)).drop("batch")

    def update(self, rows: DataFrame, batch: int) -> None:
        """Takes in one batch of ``rows(paper, concept, relevance)``. Rows without a concept are left out; a row without a paper
        or relevance counts for the others. Relevance is summed to twelve decimals."""
        spark = rows.sparkSession
        rows = rows.where("concept IS NOT NULL")
        pairs = f"{self.folder}/pairs"
        seen = parquet_if_any(spark, pairs, "concept string, paper string, batch long").where(F.col("batch") < batch)
        new = rows.where("paper IS NOT NULL").select("concept", "paper").distinct().join(seen.select("concept", "paper"), ["concept", "paper"], "left_anti")
        new.write.mode("overwrite").parquet(f"{pairs}/batch={batch}")
        new = spark.read.schema("concept string, paper string").parquet(f"{pairs}/batch={batch}")
        zero = F.lit(0).cast("long")
        own = rows.groupBy("concept").agg(F.count("paper").alias("n"), F.count("relevance").alias("scored"), F.coalesce(F.sum(F.col("relevance").cast("decimal(28,12)")), F.lit(0)).cast("decimal(38,12)").alias("total"), zero.alias("papers"))
        first = new.groupBy("concept").agg(zero.alias("n"), zero.alias("scored"), F.lit(0).cast("decimal(38,12)").alias("total"), F.count(F.lit(1)).alias("papers"))
        merged = self._sums(spark, batch).unionByName(own).unionByName(first).groupBy("concept").agg(*[F.sum(c).cast(k).alias(c) for c, k in (("n", "long"), ("scored", "long"), ("total", "decimal(38,12)"), ("papers", "long"))])
        merged.write.mode("overwrite").parquet(f"{self.folder}/sums/batch={batch}")

    def table(self, spark: SparkSession) -> DataFrame:
        """concept, doc_frequency, avg_relevance, papers: best first, as :func:`concepts.rankings`, and the distinct papers."""
        average = F.when(F.col("scored") > 0, F.col("total").cast("double") / F.col("scored"))
        out = self._sums(spark).select("concept", F.col("n").alias("doc_frequency"), average.alias("avg_relevance"), "papers")
        return out.orderBy(F.desc("doc_frequency"), F.desc("avg_relevance"), "concept")

    def follow(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        """Keeps the rankings of a stream of rows; without new rows they stay as they are."""
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True)
