"""Finding files through Spark's own file listing, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def discover(spark: SparkSession, folder: str, glob: str = "concepts_*.csv") -> DataFrame:
    """path, modified of all files below a folder, in order of path; an error if there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    out = files.select("path", F.col("modificationTime").alias("modified")).orderBy("path")
    if out.isEmpty():
        raise FileNotFoundError(f"no {glob} below {folder}")
    return out


def latest(spark: SparkSession, folder: str, glob: str) -> str | None:
    """Path of the file modified last, or None."""
    try:
        files = discover(spark, folder, glob)
    except FileNotFoundError:
        return None
    return files.agg(F.max_by("path", F.struct("modified", "path"))).first()[0]


def parquet_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, empty as long as nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
