"""Sinks: partitioned tables, exports, indexes, metrics, reports."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder_exists, written

# Columns of a CSV export.
CSV_COLUMNS = ("id", "name", "vendor", "model", "architecture", "cores", "process_nm", "gpu", "year", "completeness")


def guard_path(path: str, protected: tuple[str, ...] = ("docs",)) -> str:
    """The path, unless one of its folders is protected."""
    if any(part in protected for part in PurePath(path).parts):
        raise PermissionError(f"protected: {path}")
    return path


def write_vendors(df: DataFrame, path: str, vendor: str = "vendor") -> None:
    """Overwrite the partitions of the vendors that occur, each sorted by (year, null last, name)."""
    guard_path(path)
    year = [F.coalesce("year", F.lit(9999))] if "year" in df.columns else []
    name = [F.col("name")] if "name" in df.columns else []
    out = df.repartition(vendor).sortWithinPartitions(vendor, *year, *name)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(vendor).parquet(path)


def merge_vendors(spark: SparkSession, path: str, new: DataFrame, aliases: DataFrame | None = None, derive: Callable[[DataFrame], DataFrame] | None = None, least: float = 0.28) -> dict[str, int]:
    """Merge records into the table by vendor at a path (``resolve.merge_into``), prune it, and overwrite the vendors that the records name.

    Only their partitions are read and written; the result stands in a folder of its own before a
    partition is replaced, so a failure while merging leaves the table as it was. ``derive`` is applied
    to what is written. Gives the numbers of added, updated, renamed and pruned rows.
    """
    from ..operators.resolve import merge_into, prune

    new = new.where("vendor is not null")
    existing = spark.read.parquet(path).join(new.select("vendor").distinct(), "vendor", "left_semi") if folder_exists(spark, path) else new.drop("_pos").limit(0)
    merged = written(merge_into(existing, new, aliases))
    left = prune(merged, merged.where("_merge <> 'kept'").select("id"), least) if "completeness" in merged.columns else merged
    left = written(left)
    counts = {r[0]: r[1] for r in left.groupBy("_merge").count().collect()}
    out = left.drop("_merge")
    write_vendors(derive(out) if derive else out, path)
    return {k: counts.get(k, 0) for k in ("added", "updated", "renamed")} | {"pruned": merged.count() - sum(counts.values())}


def load(df: DataFrame, path: str, id_col: str = "id", order: str = "_pos", force: bool = False) -> dict:
    """Write the last record of each id as a table, unless one is there; total and count by vendor of what was given."""
    from ..operators.windows import last_wins

    spark = df.sparkSession
    if not force and folder_exists(spark, path) and not spark.read.schema(df.schema).parquet(path).isEmpty():
        return {"total": 0, "per_vendor": {}, "skipped": True}
    per_vendor = {r[0]: r[1] for r in df.groupBy("vendor").count().collect()}
    last_wins(df, [id_col], [order]).drop(order).write.mode("overwrite").parquet(guard_path(path))
    return {"total": sum(per_vendor.values()), "per_vendor": per_vendor, "skipped": False}


def export(df: DataFrame, path: str, fmt: str) -> None:
    """All records as json, json.gz or csv (of the export's columns, nulls as empty texts)."""
    guard_path(path)
    if fmt == "json":
        df.write.json(path)
    elif fmt == "json.gz":
        df.write.option("compression", "gzip").json(path)
    elif fmt == "csv":
        cols = [c for c in CSV_COLUMNS if c in df.columns] or df.columns
        df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]).write.option("header", True).option("emptyValue", "").csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def build_index(df: DataFrame, file_col: str = "_file", pos_col: str = "_pos") -> DataFrame:
    """(file, vendor of its first record, count, average completeness to three places)."""
    return df.groupBy(file_col).agg(
        F.min_by("vendor", pos_col).alias("vendor"), F.count("*").alias("count"), F.round(F.avg(F.coalesce("completeness", F.lit(0.0))), 3).alias("avg_completeness")
    )


def vendor_metrics(df: DataFrame, vendor: str = "vendor") -> dict:
    """Row count and counts by vendor, as gauges."""
    per = {r[0]: r[1] for r in df.groupBy(F.coalesce(vendor, F.lit("Unknown")).alias("v")).count().collect()}
    return {"total": sum(per.values()), "per_vendor": per}


def prometheus(metrics: dict, prefix: str = "catalogue") -> str:
    """The metrics in text form."""
    lines = [f"{prefix}_records_total {metrics['total']}"]
    return "\n".join(lines + [f'{prefix}_vendor_records{{vendor="{v}"}} {n}' for v, n in sorted(metrics["per_vendor"].items())]) + "\n"


def text_table(rows: list[list], headers: list[str]) -> str:
    """A plain table with columns as wide as their widest cell."""
    cells = [[("" if v is None else str(v)) for v in r] for r in rows]
    width = [max(len(h), *(len(r[i]) for r in cells)) if cells else len(h) for i, h in enumerate(headers)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip()
    return "\n".join([line(headers), line(["-" * w for w in width]), *map(line, cells)])
