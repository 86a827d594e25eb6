"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on one machine (tests) one of our own if it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="hakumei-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again.

    Cuts the lineage with a table that survives the loss of executors; the
    table is removed when it is released, or when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hakumei-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._materialised = path
    return table


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file to the shared folder; it is removed when the interpreter ends."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(jvm_path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    atexit.register(_remove, spark, path)


def release(table: DataFrame) -> None:
    """Remove a materialised table that nothing reads any more."""
    _remove(table.sparkSession, table._materialised)
