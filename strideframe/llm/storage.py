"""Written tables in the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which the shuffle files of a query go when it ends, where it has one.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local one on a local master, as in tests; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def materialise(df: DataFrame) -> tuple[DataFrame, str]:
    """The table written and read again, and its path. A lost executor costs the tasks that it had, not the history.

    The shuffle files of the write go with its end, as the table holds their result. Whoever makes a table discards it when nothing reads it any more; one that a returned DataFrame still reads goes
    when the driver ends.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    fs, path = _path(spark, at)
    before = spark.conf.get(_CLEANUP, None)
    try:
        if before is not None:
            spark.conf.set(_CLEANUP, "true")
        df.write.parquet(at)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    fs.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at), at


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for at in paths:
        fs, path = _path(spark, at)
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)
