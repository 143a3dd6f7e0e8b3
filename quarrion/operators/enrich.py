"""Enrichment: ordered rules that fill empty fields, as a chain of projections."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import barrier, first_match, first_prefix, ladder, number
from ..functions.text import canonical_id, strip_now
from ..functions.years import with_inferred_year
from ..knowledge import knowledge as default_knowledge
from ..schema import is_filled
from .quality import score

# What a year stands for where nothing better is known.
YEAR_MEMORY = ([(2023, "LPDDR5X"), (2021, "LPDDR5"), (2019, "LPDDR4X"), (2016, "LPDDR4"), (2014, "LPDDR3"), (2012, "LPDDR2")], "LPDDR")
YEAR_PROCESS = ([(2024, 3), (2023, 4), (2021, 5), (2019, 7), (2017, 10), (2015, 14), (2013, 20), (2011, 28), (2009, 40)], 65)
YEAR_STORAGE = ([(2021, "UFS 3.1"), (2019, "UFS 3.0"), (2017, "UFS 2.1"), (2015, "UFS 2.0")], "eMMC 5.0")
YEAR_WIFI = ([(2023, "Wi-Fi 7"), (2021, "Wi-Fi 6E"), (2019, "Wi-Fi 6"), (2015, "Wi-Fi 5"), (2010, "Wi-Fi 4"), (2005, "Wi-Fi 3")], "Wi-Fi 2")
YEAR_BLUETOOTH = ([(2025, "5.4"), (2023, "5.3"), (2021, "5.2"), (2019, "5.0"), (2017, "4.2"), (2015, "4.1"), (2012, "4.0"), (2010, "3.0"), (2007, "2.1")], "2.0")
# Clocks of a memory type that was given, and of one that was inferred.
GIVEN_CLOCK = [("LPDDR5X", 4266), ("LPDDR5T", 4800), ("LPDDR5", 3200), ("LPDDR4X", 2133), ("LPDDR4", 1600), ("LPDDR3", 800), ("DDR5", 4800), ("DDR4", 2400), ("DDR3", 1333)]
INFERRED_CLOCK = [("LPDDR6", 6400), ("LPDDR5X", 4266), ("LPDDR5", 3200), ("LPDDR4X", 2133), ("LPDDR4", 1600), ("LPDDR3", 933), ("LPDDR2", 533), ("LPDDR", 400)]
# Graphics by vendor where the model says nothing: by year, then for all years.
VENDOR_GPU_BY_YEAR = {
    "Allwinner": ([(2015, "Mali-450 MP")], "Mali-400 MP"),
    "Amlogic": ([(2017, "Mali-G31 MP2")], "Mali-450 MP"),
    "Rockchip": ([(2017, "Mali-G52 MP2"), (2014, "Mali-T760 MP4")], "Mali-400 MP"),
    "Ingenic": ([(2014, "GC800")], "GC400"),
}
VENDOR_GPU = {
    "Nvidia": "Nvidia GPU", "Intel Atom": "Intel HD Graphics", "TI OMAP": "PowerVR SGX", "Actions": "Mali-400 MP", "MediaTek": "Mali GPU",
    "Qualcomm": "Adreno GPU", "Samsung": "Mali GPU", "HiSilicon": "Mali GPU", "Unisoc": "Mali GPU", "NXP i.MX": "Vivante GC", "Xilinx": "Mali GPU",
}
# Vendors whose designs have one architecture.
VENDOR_ARCHITECTURE = dict.fromkeys(("Qualcomm", "MediaTek", "Samsung", "HiSilicon", "Apple", "Rockchip", "Unisoc", "Allwinner", "Amlogic"), "ARMv8")
# Modems by model number and generation.
QUALCOMM_MODEMS = [(8750, "X80"), (8650, "X75"), (8550, "X70"), (8450, "X65"), (8350, "X60"), (8250, "X55"), (8150, "X50"), (8000, "X24")]
GENERATION_MODEMS = {3: "X70", 2: "X65", 1: "X60"}
# Code names of model numbers.
CODENAMES = {"SM8250": "Kona", "SM8350": "Lahaina", "SM8450": "Waipio", "SM8475": "Waipio", "SM8550": "Kalama", "SM8650": "Pineapple", "SM8750": "Pineapple"}
VALID_YEARS = (2003, 2026)


def _set(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Fills a field where it has no content; a null leaves it as it is."""
    if name not in df.columns:
        return df.withColumn(name, value)
    return df.withColumn(name, F.when(is_filled(df, name), F.col(name)).otherwise(F.coalesce(value.cast(df.schema[name].dataType), F.col(name))))


def _with(df: DataFrame, **kinds: str) -> DataFrame:
    for name, kind in kinds.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def _upper(name: str) -> Column:
    return F.upper(F.coalesce(F.col(name), F.lit("")))


def _known(field: str, knowledge: dict | None, upper: bool = False) -> Column:
    """First entry of the vendor's map whose key is in the model; the maps are one literal, whatever their length."""
    entry = lambda k, v: F.struct(F.lit(k.upper()).alias("k"), F.lit(str(v)).alias("v"))
    maps = {vendor: facts[field] for vendor, facts in (knowledge or {}).items() if facts.get(field)}
    if not maps:
        return F.lit(None).cast("string")
    table = F.create_map(*[x for vendor, known in maps.items() for x in (F.lit(vendor), F.array(*[entry(k, v) for k, v in known.items()]))])
    model = F.col("_upper") if upper else _upper("model")
    return F.get(F.filter(F.try_element_at(table, F.col("vendor")), lambda e: model.contains(e["k"])), F.lit(0))["v"]


def with_known(df: DataFrame, knowledge: dict | None) -> DataFrame:
    """Adds what is known of the model as columns, so that rules that run twice look it up once."""
    df = barrier(df.withColumn("_upper", _upper("model")))
    return barrier(df.withColumns({f"_{f}": _known(f, knowledge, True) for f in ("process_map", "gpu_map")}).drop("_upper"))


def _fact(df: DataFrame, field: str, knowledge: dict | None) -> Column:
    return F.col(f"_{field}") if f"_{field}" in df.columns else _known(field, knowledge)


def clean_names(df: DataFrame) -> DataFrame:
    """Drops ``(now ...)`` notes; a model that is empty becomes the name if that looks like a model, else the id."""
    df = df.withColumn("name", strip_now(F.col("name"))).withColumn("model", strip_now(F.col("model")))
    looks = F.col("name").rlike(r"^[A-Za-z0-9][A-Za-z0-9 _+.\-/]{1,30}$") & F.col("name").rlike(r"\d")
    return _set(df, "model", F.coalesce(F.when(looks, F.col("name")), F.nullif("id", F.lit("")), F.lit("unknown")))


def fill_uuid(df: DataFrame) -> DataFrame:
    """The identifier of vendor and model; of a model without a letter or digit a slug of the name."""
    given = lambda c: F.coalesce(c, F.lit(""))
    return _set(df, "uuid", canonical_id(given("vendor"), given("model"), given("name")))


def infer_cpu(df: DataFrame, knowledge: dict | None = None) -> DataFrame:
    by_vendor = VENDOR_ARCHITECTURE | {v: f["architecture"] for v, f in (knowledge or {}).items() if f.get("architecture")}
    out = F.lit(None).cast("string")
    for v, a in by_vendor.items():
        out = F.when(F.col("vendor") == v, a).otherwise(out)
    return _set(df, "architecture", out)


def infer_memory(df: DataFrame) -> DataFrame:
    given = F.nullif("memory_type", F.lit(""))
    df = _set(df, "memory_clock", first_match(F.upper(given), GIVEN_CLOCK))
    df = _set(df, "memory_bus", F.when(given.isin("LPDDR5X", "LPDDR5", "LPDDR4X", "LPDDR4"), 64))
    df = _set(df, "memory_type", ladder(F.nullif("year", F.lit(0)), *YEAR_MEMORY))
    kind = F.nullif("memory_type", F.lit(""))
    df = _set(df, "memory_clock", first_prefix(kind, INFERRED_CLOCK))
    return _set(df, "memory_bus", first_prefix(kind, [("LPDDR4", 64), ("LPDDR5", 64), ("LPDDR6", 64), ("LPDDR", 32)]))


def infer_process(df: DataFrame, knowledge: dict | None = None) -> DataFrame:
    found = F.coalesce(_fact(df, "process_map", knowledge).cast("int"), ladder(F.nullif("year", F.lit(0)), *YEAR_PROCESS))
    had = is_filled(df, "process_nm")
    df = df.withColumn("process_name", F.when(~had & found.isNotNull(), F.concat(found.cast("string"), F.lit("nm"))).otherwise(F.col("process_name")))
    return _set(df, "process_nm", found)


def infer_gpu(df: DataFrame, knowledge: dict | None = None) -> DataFrame:
    year = F.nullif("year", F.lit(0))
    default = F.lit(None).cast("string")
    for v, g in VENDOR_GPU.items():
        default = F.when(F.col("vendor") == v, g).otherwise(default)
    for v, steps in VENDOR_GPU_BY_YEAR.items():
        default = F.when(F.col("vendor") == v, ladder(year, *steps)).otherwise(default)
    return _set(df, "gpu", F.coalesce(_fact(df, "gpu_map", knowledge).cast("string"), F.when(year.isNotNull(), default)))


def validate_year(df: DataFrame, strict: bool = False) -> DataFrame:
    """Drops years out of range and infers missing ones; inferred years are checked only if strict."""
    low, high = VALID_YEARS
    own = F.when(F.col("year").between(low, high), F.col("year"))
    df = with_inferred_year(df, "_inferred", barrier, own.isNull())
    found = F.col("_inferred")
    if strict:
        found = F.when(found.between(low, high), found)
    return df.withColumn("year", F.coalesce(own, found).cast("int")).drop("_inferred")


def infer_storage(df: DataFrame) -> DataFrame:
    return _set(df, "storage_type", ladder(F.nullif("year", F.lit(0)), *YEAR_STORAGE))


def infer_wifi(df: DataFrame) -> DataFrame:
    return _set(df, "wifi", ladder(F.nullif("year", F.lit(0)), *YEAR_WIFI))


def infer_bluetooth(df: DataFrame) -> DataFrame:
    return _set(df, "bluetooth", ladder(F.nullif("year", F.lit(0)), *YEAR_BLUETOOTH))


def infer_npu(df: DataFrame) -> DataFrame:
    m, name, v = _upper("model"), _upper("name"), F.col("vendor")
    found = (
        F.when(v == "Apple", "Neural Engine")
        .when((v == "Qualcomm") & m.rlike("(?:SM|SDM)[678]"), "Hexagon NPU")
        .when((v == "MediaTek") & (m.contains("DIMENSITY") | name.contains("DIMENSITY") | (number(m, r"MT(\d{4})") >= 8000)), "MediaTek APU")
        .when((v == "Samsung") & m.rlike(r"EXYNOS\s*(?:21|22|24|25)"), "Samsung NPU")
        .when((v == "HiSilicon") & m.rlike(r"KIRIN\s*[987]"), "HiSilicon NPU")
    )
    return _set(df, "npu", F.when(F.col("year") >= 2017, found))


def infer_modem(df: DataFrame) -> DataFrame:
    m, v, year = _upper("model"), F.col("vendor"), F.nullif("year", F.lit(0))
    named = lambda c: F.concat(F.lit("Snapdragon "), c, F.lit(" 5G"))
    gen = r"SNAPDRAGON\s*(\d+)\s*GEN\s*(\d+)"
    by_gen = F.lit(None).cast("string")
    for g, x in GENERATION_MODEMS.items():
        by_gen = F.when(number(m, gen, 2) == g, x).otherwise(by_gen)
    qualcomm = F.coalesce(
        named(ladder(number(m, r"(?:SM|SDM)(\d{4})"), QUALCOMM_MODEMS)),
        named(F.when(number(m, gen) >= 8, by_gen)),
        ladder(year, [(2019, "Snapdragon 5G"), (2013, "Snapdragon 4G LTE")]),
    )
    found = (
        F.when(v == "Qualcomm", qualcomm)
        .when((v == "MediaTek") & m.rlike(r"DIMENSITY|MT\d{4}"), ladder(year, [(2020, "MediaTek 5G"), (2015, "MediaTek 4G LTE")]))
        .when((v == "Samsung") & m.contains("EXYNOS"), ladder(year, [(2020, "Exynos 5G"), (2014, "Exynos 4G LTE")]))
        .when((v == "Apple") & (year >= 2019), "Apple 5G")
        .when((v == "HiSilicon") & m.contains("KIRIN"), ladder(year, [(2019, "Balong 5G"), (2014, "Balong 4G LTE")]))
    )
    return _set(df, "modem", F.when(year.isNotNull(), found))


def infer_aliases(df: DataFrame) -> DataFrame:
    name, model = F.coalesce("name", F.lit("")), F.coalesce("model", F.lit(""))
    both = F.when((name != "") & (model != "") & ~name.contains(model), F.concat(name, F.lit(" ("), model, F.lit(")")))
    codes = [F.when(F.upper(model).contains(k), c) for k, c in CODENAMES.items()]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(both, *codes))))
    return _set(df, "aliases", F.when(F.size(found) > 0, found))


def enrich(df: DataFrame, facts: dict | None = None, on: date = date(2026, 1, 1), strict: bool = False) -> DataFrame:
    """All rules in their order; memory, process and graphics run before and after the year is known.

    ``facts`` is {vendor: {architecture, process_map, gpu_map}}, by default
    what ``quarrion.knowledge`` holds. Every rule is a JVM expression; the chain is
    one narrow projection, over rows that are dealt out first: a table of a few
    megabytes, which one task would read, is minutes of work.
    """
    knowledge = default_knowledge() if facts is None else facts
    df = _with(
        df, id="string", name="string", vendor="string", model="string", uuid="string", architecture="string", memory_type="string", memory_clock="int", memory_bus="int",
        process_nm="int", process_name="string", gpu="string", year="int", storage_type="string", npu="string", modem="string", wifi="string", bluetooth="string", aliases="array<string>",
        completeness="double", sources="map<string,string>", provenance="map<string,string>",
    )
    df = df.repartition("id", "vendor", "model", "name")
    # Rules read what earlier rules filled in: without barriers their expressions would be copied into one another.
    df = with_known(fill_uuid(clean_names(df)), knowledge)
    df = infer_gpu(infer_process(barrier(infer_memory(infer_cpu(df, knowledge))), knowledge), knowledge)
    df = barrier(validate_year(barrier(df), strict))
    df = infer_gpu(infer_process(df, knowledge), knowledge).drop("_process_map", "_gpu_map")
    df = barrier(infer_memory(df))
    df = barrier(infer_modem(infer_npu(infer_storage(df))))
    df = barrier(infer_aliases(infer_bluetooth(infer_wifi(df))))
    return score(df, on)
