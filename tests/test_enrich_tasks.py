"""Enrichment's rows are dealt out."""

from pyspark.sql import functions as F

from quarrion.operators import enrich


def test_rows_of_one_file_are_enriched_in_many_tasks(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), F.lit("V").alias("vendor"), F.concat(F.lit("SM8"), F.col("id") + 100).alias("model")).coalesce(1)
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it joins partitions of a few rows
    try:
        many = enrich.enrich(rows).select("id", "year").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    assert len(many) == 4 and sum(r["count"] for r in many) == 400 and max(r["count"] for r in many) < 200
