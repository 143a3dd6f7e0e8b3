"""Summaries by group and over all records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import is_filled


def group_summary(df: DataFrame, group: str = "vendor", score: str = "completeness", unknown: str | None = "Unknown") -> DataFrame:
    """(group, count, avg of the score to three places, null as 0), in order of the group."""
    g = F.coalesce(F.col(group).cast("string"), F.lit(unknown)) if unknown is not None else F.col(group)
    return df.groupBy(g.alias(group)).agg(F.count(F.lit(1)).alias("count"), F.round(F.avg(F.coalesce(F.col(score).cast("double"), F.lit(0.0))), 3).alias(f"avg_{score}")).orderBy(group)


def global_stats(df: DataFrame, group: str = "vendor", year: str = "year", score: str = "completeness", present: tuple[str, ...] = ("architecture", "gpu", "cores", "process_nm")) -> DataFrame:
    """One row: total, groups, first and last year, average score, rows that have each of some fields."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(group).alias("groups"),
        F.min(F.when(F.col(year) != 0, F.col(year))).alias("year_min"),
        F.max(F.when(F.col(year) != 0, F.col(year))).alias("year_max"),
        F.round(F.avg(F.coalesce(F.col(score), F.lit(0.0))), 3).alias("avg_score"),
        *[F.sum(is_filled(df, c).cast("long")).alias(f"with_{c}") for c in present if c in df.columns],
    )


def positive_average(df: DataFrame, score: str = "completeness") -> DataFrame:
    """Average of the scores above 0."""
    return df.agg(F.round(F.avg(F.when(F.col(score) > 0, F.col(score))), 3).alias("avg_score"))
