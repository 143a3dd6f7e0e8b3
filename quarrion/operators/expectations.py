"""The fields that each source is expected to give, kept in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder_exists, written
from ..sources.sinks import guard_path
from .setops import symmetric_ratio

#: A change of more than this share of the fields before is reported.
CHANGED = 0.1


def _all(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema("source string, expected array<string>, version int").parquet(path) if folder_exists(spark, path) else None


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(source, expected): of each source the last fields that were registered, up to a version if one is named."""
    every = _all(spark, path)
    if every is None:
        return spark.createDataFrame([], "source string, expected array<string>")
    every = every if version is None else every.where(F.col("version") <= version)
    return every.groupBy("source").agg(F.max_by("expected", "version").alias("expected"))


def register(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Keep (source, expected) as the next version; (source, added, removed, ratio, changed) against what was registered before.

    Fields count once; the ratio is that of the fields that only one side has to
    the fields before. A source that is new has not changed; sources that are not named keep their fields.
    """
    new = written(expected.groupBy("source").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("expected")))).alias("expected")))
    before = written(current(spark, path).withColumnRenamed("expected", "old"))
    every = _all(spark, path)
    version = 1 + ((every.agg(F.max("version")).first()[0] or 0) if every is not None else 0)
    new.select("source", "expected").write.parquet(f"{guard_path(path)}/version={version}")
    both = new.join(before, "source", "left")
    ratio = F.when(F.col("old").isNotNull(), symmetric_ratio(F.col("old"), F.col("expected"))).otherwise(0.0)
    out = both.select("source", F.array_except("expected", F.coalesce("old", "expected")).alias("added"), F.array_except(F.coalesce("old", "expected"), "expected").alias("removed"), ratio.alias("ratio"))
    return out.withColumn("changed", F.col("ratio") > CHANGED)
