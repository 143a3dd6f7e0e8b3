"""Records of a known catalogue: rows of pages matched to it by several key forms, and facts by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_cpu, parse_gpu, parse_process
from ..functions.text import slug

#: Fixed value: what a record has where nothing says otherwise.
ARCHITECTURE = "ARMv8.6-A"
#: Kinds of facts by name; cores are performance and efficiency cores joined by a plus.
FACTS = ("cores", "gpu_cores", "npu_cores", "memory_bandwidth", "tdp")


def table_pairs(tables: DataFrame, key: str, classes: str = "wikitable") -> DataFrame:
    """(key, table_no, place, first, second): the first two data cells of rows with three or more, in tables of a class (``tables.page_tables``)."""
    rows = tables.where(F.array_contains(F.split("classes", r"\s+"), classes)).select(key, "table_no", F.posexplode("rows").alias("place", "row"))
    rows = rows.select(key, "table_no", "place", F.filter("row", lambda c: ~c["head"]).alias("row")).where("size(row) >= 3")
    return rows.select(key, "table_no", "place", F.trim(F.col("row")[0]["text"]).alias("first"), F.trim(F.col("row")[1]["text"]).alias("second"))


def matched(rows: DataFrame, key: str, catalogue: DataFrame) -> DataFrame:
    """(key, id, name, model, year, process, cpu, gpu) of rows that the catalogue (key, name, model, year, process, cpu, gpu) knows, the first of each id in a page.

    A row asks by both cells joined by an underscore, then by the first, then by the second;
    the first form that is a key counts. All forms meet the catalogue in one join.
    """
    forms = F.array(F.concat_ws("_", "first", "second"), F.col("first"), F.col("second"))
    asked = rows.select(F.col(key).alias("_page"), "table_no", "place", F.posexplode(forms).alias("form", "key"))
    facts = [c for c in ("name", "model", "year", "process", "cpu", "gpu")]
    met = asked.join(catalogue.select("key", F.struct(*facts).alias("info")), "key").groupBy("_page", "table_no", "place").agg(F.min_by("info", "form").alias("info"))
    met = met.withColumn("id", slug(F.col("info.name"), F.col("info.model")))
    return met.groupBy(F.col("_page").alias(key), "id").agg(F.min_by("info", F.struct("table_no", "place")).alias("info")).select(key, "id", "info.*")


def described(records: DataFrame) -> DataFrame:
    """Typed fields of the catalogue's descriptions; a record without a model has its name's, one without an architecture a usual one."""
    r = records.withColumn("_p", parse_process(F.col("process"))).withColumn("_c", parse_cpu(F.col("cpu"))).withColumn("_g", parse_gpu(F.col("gpu")))
    kept = [c for c in records.columns if c not in ("process", "cpu", "gpu", "model")]
    return r.select(*kept, F.coalesce(F.nullif("model", F.lit("")), "name").alias("model"), F.col("_p.process_nm").alias("process_nm"), F.col("_c.cores").alias("cores"), F.coalesce("_c.architecture", F.lit(ARCHITECTURE)).alias("architecture"), F.col("_g.gpu").alias("gpu"))


def with_facts(records: DataFrame, facts: DataFrame, name: str = "name") -> DataFrame:
    """Adds what facts (name, kind, value) say of a record's name: cores by kind, graphics, neural engine, memory and power.

    The facts of a name become one row before they are joined, so all kinds take one join.
    """
    wide = facts.groupBy(F.col("name").alias(name)).agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"_{k}") for k in FACTS])
    r = records.join(wide, name, "left")
    part = lambda i: F.get(F.split("_cores", r"\+"), F.lit(i)).try_cast("int")
    some = lambda c, text: F.when(F.coalesce(F.col(c).try_cast("int"), F.lit(0)) != 0, text)
    engine = lambda kind, c: some(c, F.concat(F.lit(f"Apple {kind} ("), F.col(c), F.lit("-core)")))
    values = {
        "performance_cores": part(0), "efficiency_cores": part(1), "cores": part(0) + part(1), "cluster_config": F.col("_cores"), "gpu": engine("GPU", "_gpu_cores"), "npu": engine("Neural Engine", "_npu_cores"),
        "memory_bandwidth": some("_memory_bandwidth", F.col("_memory_bandwidth").try_cast("int")), "memory_type": some("_memory_bandwidth", F.lit("Unified")), "tdp": F.nullif(F.col("_tdp").try_cast("double"), F.lit(0.0)),
    }
    out = r.withColumns({k: F.coalesce(v, F.col(k)) if k in records.columns else v for k, v in values.items()})
    return out.drop(*[f"_{k}" for k in FACTS])


def filled(records: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Records, and those of the known ones whose key none of them has."""
    return records.unionByName(known.join(records.select(key), key, "left_anti"), allowMissingColumns=True)
