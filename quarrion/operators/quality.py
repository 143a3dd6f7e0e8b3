"""Data quality: fill rates, source diversity, conflicts, completeness, drift, constraints."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FIELD_GROUPS, FIELD_WEIGHTS, SYSTEM_FIELDS, is_filled
from .windows import top_per_group


def _rates(df: DataFrame, fields: list[str], group: list[str]) -> DataFrame:
    """(group, field, fill_rate) of fields that have any value in the group: one aggregation, then unpivoted."""
    n = F.count(F.lit(1))
    one = [F.round(F.sum(is_filled(df, f).cast("double")) / n, 4).alias(f"r{i}") for i, f in enumerate(fields)]
    seen = [F.count(F.col(f"`{f}`")).alias(f"s{i}") for i, f in enumerate(fields)]
    wide = df.groupBy(*group).agg(*one, *seen)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"r{i}").alias("fill_rate"), F.col(f"s{i}").alias("seen")) for i, f in enumerate(fields)])
    out = wide.select(*group, F.explode(cells).alias("c")).where("c.seen > 0")
    return out.select(*group, "c.field", "c.fill_rate")


def fill_rates(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    fields = fields or [c for c in df.columns if c not in SYSTEM_FIELDS and not c.startswith("_")]
    return _rates(df, fields, [])


def fill_rates_by(df: DataFrame, group: str = "vendor", fields: list[str] | None = None) -> DataFrame:
    """Fill rates by group; rows without one are the group Unknown."""
    fields = fields or [c for c in df.columns if c not in SYSTEM_FIELDS and not c.startswith("_") and c != group]
    return _rates(df.withColumn(group, F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit("Unknown"))), fields, [group])


def top_fields(rates: DataFrame, group: str = "vendor", k: int = 5) -> DataFrame:
    return top_per_group(rates, [group], [F.col("fill_rate").desc(), "field"], k)


def group_rates(rates: DataFrame, groups: dict[str, list[str]] = FIELD_GROUPS) -> DataFrame:
    """(field_group, avg_rate, fields) over the fields of each group that have a rate."""
    member = F.lit(None).cast("string")
    for g, fs in groups.items():
        member = F.when(F.col("field").isin(*fs), F.lit(g)).otherwise(member)
    return rates.withColumn("field_group", member).where(F.col("field_group").isNotNull()).groupBy("field_group").agg(F.round(F.avg("fill_rate"), 4).alias("avg_rate"), F.count("*").alias("fields"))


def _entries(df: DataFrame, group: str, provenance: str) -> DataFrame:
    g = F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit("Unknown")).alias(group)
    return df.select(g, F.explode_outer(provenance).alias("field", "source"))


def source_diversity(df: DataFrame, group: str = "vendor", provenance: str = "provenance") -> DataFrame:
    """(group, unique_sources, sources in order, entries, records)."""
    g = F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit("Unknown")).alias(group)
    records = df.groupBy(g).agg(F.count(F.lit(1)).alias("records"))
    # Counts by source first: what is collected for a group is its distinct sources.
    by_source = _entries(df, group, provenance).where(F.col("source").isNotNull()).groupBy(group, "source").agg(F.count("*").alias("n"))
    found = by_source.groupBy(group).agg(F.count("*").alias("unique_sources"), F.sort_array(F.collect_list("source")).alias("sources"), F.sum("n").alias("entries"))
    out = records.join(found, group, "left")
    return out.select(group, F.coalesce("unique_sources", F.lit(0)).alias("unique_sources"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("entries", F.lit(0)).alias("entries"), "records")


def conflict_rate(df: DataFrame, group: str = "vendor", provenance: str = "provenance") -> DataFrame:
    """(group, conflicts, fields, conflict_rate): fields with more than one source among those with any."""
    per = _entries(df, group, provenance).where(F.col("source").isNotNull()).groupBy(group, "field").agg(F.countDistinct("source").alias("n"))
    return per.groupBy(group).agg(F.sum((F.col("n") > 1).cast("long")).alias("conflicts"), F.count("*").alias("fields")).withColumn("conflict_rate", F.round(F.col("conflicts") / F.col("fields"), 4))


def completeness(df: DataFrame, fields: list[str] | None = None, weights: dict[str, int] = FIELD_WEIGHTS) -> Column:
    """Weighted share of fields with content, to four places; fields that the frame lacks count as empty."""
    fields = fields or [f for fs in FIELD_GROUPS.values() for f in fs]
    total = sum(weights.get(f, 1) for f in fields)
    got = sum((F.when(is_filled(df, f), weights.get(f, 1)).otherwise(0) for f in fields if f in df.columns), F.lit(0))
    return F.round(got / F.lit(total), 4)


def score(df: DataFrame, on: date, source: str = "enrichment", **kw) -> DataFrame:
    """Sets completeness, then ``updated`` and, where there are none, ``sources`` and ``provenance``."""
    out = df.withColumn("completeness", completeness(df, **kw))
    empty = F.create_map().cast("map<string,string>")
    out = out.withColumn("sources", F.coalesce(F.col("sources"), empty) if "sources" in df.columns else empty)
    out = out.withColumn("updated", F.lit(on))
    if "provenance" in df.columns:
        from .provenance import track

        out = out.withColumn("provenance", F.when(F.size(F.coalesce("provenance", empty)) > 0, F.col("provenance")).otherwise(track(df, source)))
    return out


def drift(keys: DataFrame, expected: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(source, coverage, missing, unexpected, drift) from (source, key) observed and (source, expected array).

    Without any key observed there is drift; a source without expectation has none.
    """
    seen = keys.select("source", "key").distinct().groupBy("source").agg(F.sort_array(F.collect_list("key")).alias("actual"))
    out = seen.join(expected, "source", "full")
    actual = F.coalesce("actual", F.array().cast("array<string>"))
    want = F.coalesce("expected", F.array().cast("array<string>"))
    covered = F.when(F.size(want) > 0, F.size(F.array_intersect(want, actual)) / F.size(want)).otherwise(1.0)
    return out.select(
        "source", F.round(covered, 4).alias("coverage"), F.sort_array(F.array_except(want, actual)).alias("missing"),
        F.when(F.size(want) > 0, F.sort_array(F.array_except(actual, want))).otherwise(F.array().cast("array<string>")).alias("unexpected"),
        ((F.size(want) > 0) & ((F.size(actual) == 0) | (covered < threshold))).alias("drift"),
    )


def constraint_report(df: DataFrame, required: list[str], unique: str, ints: list[str]) -> DataFrame:
    """(rule, broken): rows without a required field, ids that occur again, values that are no whole number."""
    n = F.sum
    rules = [n((~is_filled(df, c)).cast("long")).alias(f"missing_{c}") for c in required]
    rules += [n((F.col(c).isNotNull() & F.col(c).cast("string").try_cast("bigint").isNull()).cast("long")).alias(f"type_{c}") for c in ints]
    wide = df.agg(*rules)
    out = wide.unpivot([], wide.columns, "rule", "broken")
    again = df.groupBy(unique).count().where("count > 1").agg(F.lit(f"duplicate_{unique}").alias("rule"), F.count("*").alias("broken"))
    return out.unionByName(again)


class QualityReport:
    """The quality measures of a frame, as a dict, JSON or Markdown; all but small aggregates stays distributed."""

    def __init__(self, df: DataFrame, vendor: str = "vendor"):
        self.vendor = vendor
        rows = lambda d: [r.asDict(True) for r in d.collect()]
        fields = [c for c in df.columns if c not in SYSTEM_FIELDS and not c.startswith("_")]
        by = fill_rates_by(df, vendor)
        self.total = df.count()
        self.rates = rows(fill_rates(df, fields).orderBy("field"))
        self.by_vendor = rows(by.orderBy(vendor, "field"))
        self.top = rows(top_fields(by, vendor).orderBy(vendor, F.col("fill_rate").desc(), "field"))
        self.groups = rows(group_rates(fill_rates(df, fields)).orderBy("field_group"))
        has = "provenance" in df.columns
        self.sources = rows(source_diversity(df, vendor).orderBy(vendor)) if has else []
        self.conflicts = rows(conflict_rate(df, vendor).orderBy(vendor)) if has else []

    def to_dict(self) -> dict:
        return {"total": self.total, "fill_rates": self.rates, "vendor_fill_rates": self.by_vendor, "field_groups": self.groups, "source_diversity": self.sources, "conflict_rate": self.conflicts}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False)

    def markdown(self) -> str:
        bar = lambda x: "█" * round(x * 20) + "░" * (20 - round(x * 20))
        out = ["# Data quality", "", f"Records: {self.total}", "", "## Field groups", "", "| group | fill rate | |", "|---|---:|---|"]
        out += [f"| {r['field_group']} | {r['avg_rate']:.2%} | {bar(r['avg_rate'])} |" for r in self.groups]
        out += ["", "## Best filled fields", "", "| vendor | field | fill rate |", "|---|---|---:|"]
        out += [f"| {r[self.vendor]} | {r['field']} | {r['fill_rate']:.2%} |" for r in self.top]
        out += ["", "## Conflicts", "", "| vendor | conflicts | fields | rate |", "|---|---:|---:|---:|"]
        out += [f"| {r[self.vendor]} | {r['conflicts']} | {r['fields']} | {r['conflict_rate']:.2%} |" for r in self.conflicts]
        return "\n".join(out) + "\n"
