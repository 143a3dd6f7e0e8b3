"""Scans: JSON and Parquet catalogues, point lookup, cached reads, triple patterns."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import record_schema
from ..scratch import written


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All records of the arrays in a folder's JSON files, without the index and files that begin with ``_``.

    Keys outside the schema are kept as text in ``_extra``. Files whose top
    level is an empty object give no record.
    """
    schema = schema or record_schema()
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "[!_]*.json").text(path)
    files = files.select(F.col("_metadata.file_name").alias("_file"), "value").where(F.col("_file") != "index.json")
    # The text of a file is an array of objects; as maps of texts they keep what is outside the schema.
    rows = files.where(F.ltrim("value").startswith("[")).select("_file", F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("_pos", "_map"))
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    extra = F.map_filter("_map", lambda k, v: ~F.array_contains(known, k))
    scalar = (T.StringType, T.NumericType, T.BooleanType, T.DateType)
    cols = []
    for f in schema.fields:
        if f.name == "_extra":
            cols.append(F.when(F.size(extra) > 0, extra).alias("_extra"))
        elif isinstance(f.dataType, scalar):
            cols.append(F.try_element_at("_map", F.lit(f.name)).try_cast(f.dataType).alias(f.name))
        else:
            cols.append(F.from_json(F.try_element_at("_map", F.lit(f.name)), f.dataType).alias(f.name))
    return rows.select("_file", "_pos", *cols).where(F.col("id").isNotNull())


def read_catalogue(spark: SparkSession, json_path: str, parquet_path: str, backend: str = "parquet") -> DataFrame:
    """The table, or the JSON files; a table that is missing is built from JSON first, any other failure is the caller's to see."""
    if backend == "json":
        return read_json(spark, json_path).drop("_file", "_pos")
    if backend != "parquet":
        raise ValueError(f"unknown backend: {backend}")
    try:
        return spark.read.parquet(parquet_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        read_json(spark, json_path).drop("_file", "_pos").write.mode("overwrite").partitionBy("vendor").parquet(parquet_path)
        return spark.read.parquet(parquet_path)


def in_order(df: DataFrame, keys=("vendor", "name", "id")) -> DataFrame:
    return df.orderBy(*[k for k in keys if k in df.columns])


def by_id(df: DataFrame, value, id_col: str = "id") -> DataFrame:
    """Point lookup; the equality reaches the scan."""
    return df.where(F.col(id_col) == F.lit(value)).limit(1)


class CachedScan:
    """A frame that is kept for ``ttl`` seconds and read anew after that; where reading fails, the fallback is read in its place."""

    def __init__(self, load: Callable[[], DataFrame], ttl: float = 300.0, clock: Callable[[], float] = time.monotonic, fallback: Callable[[], DataFrame] | None = None):
        self.load, self.ttl, self.clock, self.fallback = load, ttl, clock, fallback
        self.frame: DataFrame | None = None
        self.at = 0.0

    def get(self) -> DataFrame:
        if self.frame is None or self.clock() - self.at > self.ttl:
            self.clear()
            self.frame, self.at = self._read().persist(), self.clock()
        return self.frame

    def _read(self) -> DataFrame:
        try:
            return self.load()
        except (PySparkException, Py4JJavaError):
            if self.fallback is None:
                raise
            return self.fallback()

    def clear(self) -> None:
        if self.frame is not None:
            self.frame.unpersist()
            self.frame = None


def read_overrides(path: str) -> dict:
    """A small JSON object of overrides; empty if it is missing, broken or no object."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def triple_query(triples: DataFrame, vendor: str, classes: list[str], property_: str, limit: int | None = 500) -> DataFrame:
    """Items of some classes made by a vendor, with a property's value: three patterns over (s, p, o), distinct."""
    kind = triples.where((F.col("p") == "instance_of") & F.col("o").isin(classes)).select("s")
    maker = triples.where((F.col("p") == "manufacturer") & (F.col("o") == vendor)).select("s")
    value = triples.where(F.col("p") == property_).select("s", F.col("o").alias("value"))
    out = value.join(kind, "s", "left_semi").join(maker, "s", "left_semi").distinct()
    return out.orderBy("s", "value").limit(limit) if limit is not None else out


def union_tagged(frames: dict[str, DataFrame], tag: str = "_query_type") -> DataFrame:
    """Results of several queries one under the other, each tagged with its name."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def live_or_baseline(live: DataFrame, baseline: DataFrame) -> DataFrame:
    """What was parsed, or the baseline where that is nothing."""
    return baseline if live.isEmpty() else live


def follow_pages(pages: DataFrame, start: str, url: str = "url", following: str = "next_url") -> DataFrame:
    """Pages reached from a start by their links to the next one, each once, with ``page_no`` from 0 on.

    Links are followed by doubling: after k rounds the pages within 2**k steps
    are known, so a chain of any length takes a number of rounds that is its
    logarithm. A link back to a page that was met ends the chain.
    """
    links = pages.select(F.col(url).alias("u"), F.nullif(following, F.lit("")).alias("v")).where("v is not null").groupBy("u").agg(F.min("v").alias("v"))
    links = written(links)
    reached = written(pages.where(F.col(url) == start).select(F.col(url).alias("u"), F.lit(0).cast("long").alias("page_no")).distinct())
    jump, step, n = links, 1, reached.count()
    while True:
        ahead = reached.join(jump, "u").select(F.col("v").alias("u"), (F.col("page_no") + step).alias("page_no"))
        reached = written(reached.unionByName(ahead).groupBy("u").agg(F.min("page_no").alias("page_no")))
        more = reached.count()
        if more == n:
            break
        n, step = more, 2 * step
        onward = jump.select(F.col("u").alias("v"), F.col("v").alias("w"))
        jump = written(jump.join(onward, "v").select("u", F.col("w").alias("v")))
    return pages.join(reached, F.col(url) == F.col("u")).drop("u").dropDuplicates([url]).orderBy("page_no")


class Registry:
    """Named sources; a name may be registered once."""

    def __init__(self):
        self._sources: dict[str, Callable] = {}

    def register(self, name: str):
        def add(f: Callable) -> Callable:
            if name in self._sources:
                raise ValueError(f"already registered: {name}")
            self._sources[name] = f
            return f

        return add

    def get(self, name: str) -> Callable | None:
        return self._sources.get(name)

    def all(self) -> dict[str, Callable]:
        return dict(sorted(self._sources.items()))

    def clear(self) -> None:
        self._sources.clear()
