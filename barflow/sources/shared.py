"""Folders that the driver and all executors see, and tables written there between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_roots: dict[str, str] = {}


def hadoop_path(spark: SparkSession, path: str):
    """The path, and the file system of the store that it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name under ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder of this machine takes its place, but only in
    local mode, where driver and executors are one process; elsewhere that is an error. All
    folders of a driver lie in one, which goes when its JVM ends (a lazy frame may read them
    until then); a session without a JVM of its own leaves it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _local[0]
    if base not in _roots:
        _roots[base] = f"{base.rstrip('/')}/barflow-{uuid.uuid4().hex}"
        if getattr(spark.sparkContext, "_jvm", None):
            at, store = hadoop_path(spark, _roots[base])
            store.mkdirs(at)
            store.deleteOnExit(at)
    return f"{_roots[base]}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written once to the shared folder and read back.

    This cuts the lineage: what reads it several times computes it once, and a lost executor
    costs a re-read.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder, in the store that its path names."""
    at, store = hadoop_path(spark, path)
    store.delete(at, True)
