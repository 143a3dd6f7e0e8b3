"""The folder that driver and executors share, and frames whose lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; in local mode, if that is unset, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base}/catalogue-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame written as Parquet and read again: its plan is a scan, and a lost executor costs nothing before it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold 4 MB at most: texts differ in length, and each batch stands in the JVM and in Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def folder(spark: SparkSession, path: str):
    """(file system, path) as Hadoop knows them, so that any store that Spark reads will do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, where = folder(spark, path)
    return files.exists(where)
