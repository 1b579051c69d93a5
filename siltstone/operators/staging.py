"""Tables that iterative operators keep between their rounds, in the shared folder of checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

#: Spark's setting for shuffle files that go at the end of the action that wrote them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(df: DataFrame) -> str:
    """The session's folder of checkpoints. Only a local master, where all threads share one disk, may go without that
    setting; elsewhere its absence is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        if not folder:
            folder = tempfile.mkdtemp(prefix="siltstone-checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept: a reliable checkpoint in the folder that the session names in
    ``spark.checkpoint.dir``, so lineage ends there and lost executors lose nothing."""
    _folder(df)
    return df.checkpoint()


def packed(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` computed once and kept as compressed columns in the same folder, and its path for :func:`drop`. Its shuffles are
    removed as soon as it is written, not when the driver happens to collect garbage."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, was)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(df: DataFrame, path: str) -> None:
    """Removes a table of :func:`packed` that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
