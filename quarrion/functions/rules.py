"""Ordered rules as Column expressions: ladders, first match, fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ladder(value: Column, steps: Sequence[tuple], default=None) -> Column:
    """Result of the first step (least value, result) that the value reaches, else the default; null of a null."""
    out = F.lit(default)
    for least, result in reversed(steps):
        out = F.when(value >= least, result if isinstance(result, Column) else F.lit(result)).otherwise(out)
    return F.when(value.isNotNull(), out)


def first_match(text: Column, pairs: Sequence[tuple[str, object]], default=None) -> Column:
    """Value of the first pair whose key the text contains."""
    out = F.lit(default)
    for key, value in reversed(pairs):
        out = F.when(text.contains(key), F.lit(value)).otherwise(out)
    return out


def first_prefix(text: Column, pairs: Sequence[tuple[str, object]], default=None) -> Column:
    """Value of the first pair whose key the text starts with."""
    out = F.lit(default)
    for key, value in reversed(pairs):
        out = F.when(text.startswith(key), F.lit(value)).otherwise(out)
    return out


def first_pattern(text: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """Group of the first pattern that matches; null if none does. The order of patterns decides, not of places."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def number(text: Column, pattern: str, group: int = 1, kind: str = "int") -> Column:
    """A group of a pattern as a number; null without a match."""
    return F.regexp_extract(text, pattern, group).try_cast(kind)


def fill(current: Column, filled: Column, value: Column) -> Column:
    """The current value where it has content, else the new one."""
    return F.when(filled, current).otherwise(F.coalesce(value, current))


def barrier(df: DataFrame) -> DataFrame:
    """A projection that the optimizer doesn't merge with what follows: the row goes through an array of one."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")
