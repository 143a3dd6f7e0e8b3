"""Resumable processing in micro-batches, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_batches(spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 1) -> int:
    """Run what is new in a Parquet folder through a transform and append it; returns the rows of this run.

    The checkpoint keeps which files are done, so a run that was cut off goes
    on where it stopped, and a file is never done twice: each micro-batch
    writes its own folder and a repeated one overwrites it.
    """
    done = []

    def write(df: DataFrame, batch: int) -> None:
        out = transform(df)
        out.write.mode("overwrite").parquet(f"{target}/batch={batch}")
        done.append(df.sparkSession.read.parquet(f"{target}/batch={batch}").count())

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(done)


def clear_checkpoint(spark: SparkSession, checkpoint: str) -> None:
    """Forget what is done; the next run starts over."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], aggregates: dict[str, Column], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates by time window and keys; on a stream ``late`` is how long rows are waited for."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark("_ts", late)
    w = F.window("_ts", width, slide) if slide else F.window("_ts", width)
    out = rows.groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], aggregates: dict[str, Column], late: str | None = None) -> DataFrame:
    """Aggregates by session: rows of a key less than the gap apart."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark("_ts", late)
    out = rows.groupBy(F.session_window("_ts", gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)
