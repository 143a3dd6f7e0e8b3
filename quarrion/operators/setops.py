"""Set operations on rows and on arrays of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def symmetric_ratio(a: Column, b: Column) -> Column:
    """Names that only one array has, over those of the first."""
    differ = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return differ / F.greatest(F.size(a), F.lit(1))


def all_keys(a: Column, b: Column, skip: tuple[str, ...] = ()) -> Column:
    """Keys of either map but the skipped ones."""
    return F.array_except(F.array_union(F.map_keys(a), F.map_keys(b)), F.array(*[F.lit(s) for s in skip]).cast("array<string>"))
