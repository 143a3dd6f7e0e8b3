"""First and last rows by key, top rows by group, carry-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: list) -> list:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Catalyst limits groups before the exchange."""
    w = Window.partitionBy(*group).orderBy(*_order(order))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return top_per_group(df, key, order, 1)


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return top_per_group(df, key, [F.col(c).desc() for c in order], 1)


def carry_forward(df: DataFrame, group: list[str], order: list, value: str, out: str, need=None, least: int = 0) -> DataFrame:
    """Adds the last value before each row where ``need`` holds and there are ``least`` rows before; else the row's own."""
    w = Window.partitionBy(*group).orderBy(*_order(order))
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    need = F.col(value).isNull() if need is None else need
    return df.withColumn(out, F.when(need & (F.row_number().over(w) > least), before).otherwise(F.col(value)))
