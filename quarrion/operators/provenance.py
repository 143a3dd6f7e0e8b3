"""Provenance: a map from field to the source of its value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SYSTEM_FIELDS, is_filled

_EMPTY = "map<string,string>"


def _map(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.create_map().cast(_EMPTY))


def merge_maps(first: Column, second: Column) -> Column:
    """Both maps together; the first one's values stay."""
    return F.map_concat(first, F.map_filter(second, lambda k, v: ~F.map_contains_key(first, k)))


def track(df: DataFrame, source: str, fields: list[str] | None = None, force: bool = False, column: str = "provenance") -> Column:
    """The map with every field that has content put down to the source, where it has no entry or by force."""
    fields = fields or [c for c in df.columns if c not in SYSTEM_FIELDS and not c.startswith("_") and c != column]
    entries = F.array_compact(F.array(*[F.when(is_filled(df, f), F.struct(F.lit(f).alias("k"), F.lit(source).alias("v"))) for f in fields]))
    new = F.map_from_entries(entries)
    old = _map(column) if column in df.columns else F.create_map().cast(_EMPTY)
    return merge_maps(new, old) if force else merge_maps(old, new)


def record_field(provenance: Column, field: str, source: str) -> Column:
    """The map with one entry set, whatever it was."""
    return merge_maps(F.create_map(F.lit(field), F.lit(source)), _map(provenance))


def bulk_record(provenance: Column, mapping: dict[str, str], force: bool = False) -> Column:
    new = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]).cast(_EMPTY) if mapping else F.create_map().cast(_EMPTY)
    old = _map(provenance)
    return merge_maps(new, old) if force else merge_maps(old, new)


def get_source(provenance: Column, field: str) -> Column:
    return F.try_element_at(provenance, F.lit(field))


def resolve(current: Column, incoming: Column, current_source: Column, incoming_source: Column, priority: list[str]) -> Column:
    """The value of the source that comes first by priority; what is empty gives way, without priority the current one stays."""
    rank = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]).cast("array<string>"), s), F.lit(0)), F.lit(1 << 30))
    blank = lambda c: F.coalesce(c.cast("string") == "", F.lit(True))
    return (
        F.when(blank(current) | current.eqNullSafe(incoming), incoming)
        .when(blank(incoming), current)
        .when(rank(incoming_source) < rank(current_source), incoming)
        .otherwise(current)
    )


def is_conflict(current: Column, incoming: Column) -> Column:
    """Whether both values have content and differ."""
    blank = lambda c: F.coalesce(c.cast("string") == "", F.lit(True))
    return ~blank(current) & ~blank(incoming) & ~current.eqNullSafe(incoming)


def apply(df: DataFrame, source: str, force: bool = False, column: str = "provenance") -> DataFrame:
    """Tracks all rows; those that have any provenance only by force."""
    tracked = track(df, source, force=force, column=column)
    if column in df.columns and not force:
        tracked = F.when(F.size(_map(column)) > 0, F.col(column)).otherwise(tracked)
    return df.withColumn(column, tracked)


def reapply(df: DataFrame, legacy: str, fallback: str = "enrichment", known: str = "source", column: str = "provenance") -> DataFrame:
    """Entries of the legacy source are put down to the row's known one, or the fallback; missing ones are added."""
    own = F.coalesce(F.nullif(F.col(known), F.lit("")), F.lit(fallback)) if known in df.columns else F.lit(fallback)
    fixed = F.transform_values(_map(column), lambda k, v: F.when(v == legacy, own).otherwise(v))
    out = df.withColumn(column, fixed)
    return out.withColumn(column, track(out, fallback, column=column))
