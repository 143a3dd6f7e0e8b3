"""Bindings of triple patterns: facts of vendors in versioned layers, and records.

A binding is a map from variable to (type, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import barrier
from ..functions.text import extract_model, slug
from ..scratch import folder_exists
from ..sources.sinks import guard_path
from .extract import DEFAULT_ARCHITECTURE, DEFAULT_CORES, jsonld, jsonld_records, score_rows, table_cells
from .resolve import merge_layers

#: Variables of the three queries: kind of the fact, and which variable is its value.
FACTS = {"process_map": "processNode", "gpu_map": "gpuLabel", "architecture": "architectureLabel"}
# Items of architectures.
ARCHITECTURES = {
    "Q28053211": "ARMv9-A", "Q116171328": "ARMv9.2-A", "Q627843": "ARMv8-A", "Q49387": "ARMv8-A", "Q189589": "ARMv7-A", "Q28053214": "ARMv8.1-A", "Q28053216": "ARMv8.2-A",
    "Q28053218": "ARMv8.3-A", "Q28053220": "ARMv8.4-A", "Q28053222": "ARMv8.5-A", "Q28053224": "ARMv8.6-A",
}
# Names that are none of a record's, and words of them.
NOT_NAMES, NOT_IN_NAMES = ("Category:", "List of"), ("series", "family", "processor", "comparison", "architecture", "instruction set", "microarchitecture", "category:", "template:", "wikipedia:")


def value(name: str, binding: str = "binding") -> Column:
    """A variable's value, null if it has none or an empty one."""
    return F.nullif(F.try_element_at(binding, F.lit(name))["value"], F.lit(""))


def model_key(label: Column) -> Column:
    """The model number in a label, in lower case, else the label."""
    return F.coalesce(F.lower(extract_model(label)), F.trim(F.lower(label)))


def facts(bindings: DataFrame) -> DataFrame:
    """(vendor, kind, key, value) of rows (vendor, kind, pos, binding): the last binding of each key, but the first architecture of a vendor.

    Bindings without a label or a value, and nodes that are no whole numbers, are none.
    """
    own = F.coalesce(*[F.when(F.col("kind") == k, value(v)) for k, v in FACTS.items()])
    whole = F.col("kind") != "process_map"
    rows = bindings.select("vendor", "kind", "pos", own.alias("value"), F.when(F.col("kind") == "architecture", F.lit("")).otherwise(model_key(value("itemLabel"))).alias("key"))
    rows = rows.where(F.col("value").isNotNull() & ((F.col("kind") == "architecture") | (F.col("key") != "")) & (whole | F.col("value").rlike(r"^\s*[+-]?\d+\s*$")))
    order = F.when(F.col("kind") == "architecture", -F.col("pos")).otherwise(F.col("pos"))
    out = rows.groupBy("vendor", "kind", "key").agg(F.max_by("value", F.struct(order, "value")).alias("value"))
    return out.select("vendor", "kind", "key", F.when(~whole, F.col("value").try_cast("int").cast("string")).otherwise(F.col("value")).alias("value"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the layer at a path, in order; as many as there were refreshes."""
    if not folder_exists(spark, path):
        return []
    return sorted(r.version for r in spark.read.parquet(path).select("version").distinct().collect())


def refresh(spark: SparkSession, path: str, bindings: DataFrame, dry_run: bool = False) -> DataFrame:
    """The facts of bindings, kept as the next version of the layer at a path; a dry run keeps nothing, and bindings without facts are no version."""
    found = facts(bindings)
    if dry_run or found.isEmpty():
        return found
    version = (versions(spark, path) or [0])[-1] + 1
    found.write.parquet(f"{guard_path(path)}/version={version}")
    return spark.read.parquet(f"{path}/version={version}")


def knowledge(spark: SparkSession, base: DataFrame, path: str | None = None, overrides: DataFrame | None = None, version: int | None = None) -> DataFrame:
    """(vendor, kind, key, value): the base, with the last (or a named) version of the layer at a path and corrections merged in; the base alone where there is no layer."""
    known = versions(spark, path) if path else []
    if not known:
        return base.select("vendor", "kind", "key", "value")
    live = spark.read.parquet(f"{path}/version={known[-1] if version is None else version}")
    return merge_layers(base, live, overrides)


def records(bindings: DataFrame, architectures: dict[str, str] = ARCHITECTURES) -> DataFrame:
    """(id, name, vendor, qid, model, cores, architecture, gpu, process, year, max_freq) of rows (vendor, pos, binding), the first of each item; rows without an item all stay.

    Labels of lists, families and the like are no records; a record without a usable
    slug is named by its item. Cores and architecture have usual values
    where the binding has none; ``architectures`` maps items of architectures to names.
    """
    # Variables are columns of their own before anything looks at them.
    variables = ("itemLabel", "item", "modelNumber", "cores", "arch", "archLabel", "gpuLabel", "processNode", "publicationDate", "maxFreq")
    bindings = barrier(barrier(bindings.select("vendor", "pos", "binding")).select("vendor", "pos", *[value(v).alias(v) for v in variables]))
    name = F.col("itemLabel")
    low = F.lower(name)
    out = F.lit(False)
    for w in NOT_NAMES:
        out = out | name.startswith(w)
    for w in NOT_IN_NAMES:
        out = out | low.contains(w)
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    number = lambda n: F.trim(F.col(n)).try_cast("double")
    qid, model = F.coalesce(tail(F.col("item")), F.lit("")), F.col("modelNumber")
    known = F.lit(None).cast("string")
    for q, a in architectures.items():
        known = F.when(tail(F.col("arch")) == q, F.lit(a)).otherwise(known)
    nm = F.coalesce(F.concat(number("processNode").try_cast("int").cast("string"), F.lit("nm")), F.nullif(F.regexp_extract(F.coalesce(F.col("processNode"), F.lit("")), r"(?i)\d+\s*nm", 0), F.lit("")))
    year, freq = F.left(F.col("publicationDate"), F.lit(4)).try_cast("int"), number("maxFreq")
    made = slug(name, F.coalesce(model, F.lit("")))
    rows = bindings.where(name.isNotNull() & ~out).select(
        F.when(made == "unknown", F.concat(F.lit("wd_"), qid)).otherwise(made).alias("id"), name.alias("name"), "vendor", qid.alias("qid"), model.alias("model"), F.coalesce(number("cores").try_cast("int"), F.lit(DEFAULT_CORES)).alias("cores"),
        F.coalesce(known, F.col("archLabel"), F.lit(DEFAULT_ARCHITECTURE)).alias("architecture"), F.col("gpuLabel").alias("gpu"), nm.alias("process"), F.when((year > 1980) & (year < 2028), year).alias("year"),
        F.when(freq >= 1000, F.format_string("%.2f GHz", freq / 1000)).when(freq.isNotNull(), F.format_string("%.0f MHz", freq)).alias("max_freq"), "pos",
    )
    fields = [c for c in rows.columns if c != "pos"]
    item = F.when(F.col("qid") != "", F.col("qid")).otherwise(F.concat_ws("/", F.lit("row"), "vendor", F.col("pos").cast("string")))
    return rows.groupBy(item.alias("item")).agg(F.min_by(F.struct(*fields), "pos").alias("r")).select("r.*")


def page_scores(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, name, single, multi): scores of a page's JSON-LD, its table rows only where that gave none; the first of each name's slug in a page."""
    said = jsonld_records(jsonld(pages, key, html), key).where("name <> '' and (single is not null or multi is not null)").select(key, "name", "single", "multi", F.struct("place", F.lit(0).alias("row")).alias("at"))
    rest = pages.join(said.select(key).distinct(), key, "left_anti")
    rows = score_rows(table_cells(rest, key, html), key).select(key, "name", "single", "multi", F.struct(F.col("table_no").alias("place"), F.col("row_no").alias("row")).alias("at"))
    both = said.unionByName(rows).withColumn("id", slug(F.col("name")))
    return both.groupBy(key, "id").agg(F.min_by(F.struct("name", "single", "multi"), "at").alias("r")).select(key, "r.*")
