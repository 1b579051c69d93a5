"""Helpers shared by the training-data operators: table access and staged intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables, seen by the driver and every executor.

    It is the folder the cluster names in ``spark.checkpoint.dir``. Only a local master, where all
    threads share one disk, may go without that setting; elsewhere its absence is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        root = getattr(sc, "_siltstone_tmp", None)
        if root is None:
            root = sc._siltstone_tmp = "file://" + tempfile.mkdtemp(prefix="siltstone-")
            fs, p = _path(spark, root)
            fs.deleteOnExit(p)
    return f"{root.rstrip('/')}/siltstone-{sc.applicationId}"


_open: list[list[str]] = []


def staged(df: DataFrame, outlive: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, so a lost
    executor costs no recomputation of what came before. The folder goes when the enclosing
    :func:`scratch` ends (with ``outlive`` the one around that), at the latest with the driver's JVM,
    whether or not the session was stopped."""
    spark = df.sparkSession
    root = shared_dir(spark)
    sc = spark.sparkContext
    if getattr(sc, "_siltstone_root", None) != root:
        fs, p = _path(spark, root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        sc._siltstone_root = root
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_open) > outlive:
        _open[-1 - outlive].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Removes, at its end, the tables staged inside it, so a long session does not gather them.
    DataFrames that read them must have been written or staged to outlive it by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def _path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def quoted(names: list[str]) -> list[str]:
    """Column names as ``select`` takes them literally, dots and all. (``mapInArrow`` takes no dots even
    so: rename first.)"""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; sorting beats the hash table that ``np.unique`` takes for them."""
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))]


def new_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id) -> "F.Column":
    """Rows kept from every fit: crc32 of the id's text leaves remainder 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
