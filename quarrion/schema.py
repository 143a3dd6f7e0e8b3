"""The catalogue record: schema, field groups and weights, emptiness, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of a catalogue record by type.
STRING_FIELDS = (
    "id", "name", "vendor", "model", "codename", "description", "architecture", "isa", "cluster_config", "max_freq", "process_name", "process",
    "gpu", "memory_type", "storage_type", "npu", "modem", "cellular", "video_decode", "video_encode", "display_max", "camera_max", "video_capture",
    "wifi", "bluetooth", "connectivity", "dsp", "usb", "navigation", "charging", "revision", "status", "source", "datasheet_url", "wikipedia_url",
    "wikidata_id", "linux_dt_compatible", "parent", "market_segment", "wifi_version", "pcie_version", "usb_version", "bluetooth_version", "gnss",
    "fingerprint", "display_resolution", "video_capture_max", "isp_config", "dsp_type", "security", "l2_cache", "l3_cache", "soc_id", "package",
    "die_size", "uuid",
)
INT_FIELDS = (
    "cores", "threads", "clock_max", "clock_mid", "clock_min", "process_nm", "gpu_clock", "memory_max", "memory_clock", "memory_bus",
    "memory_bandwidth", "modem_dl", "modem_ul", "isps", "year", "charging_max_w", "display_max_refresh", "camera_max_mp", "arm_cores_total",
    "performance_cores", "efficiency_cores",
)
DOUBLE_FIELDS = ("tdp", "gpu_tflops", "ai_ops", "completeness", "ai_int8_tops", "ai_fp16_tflops")
BOOLEAN_FIELDS = ("modem_5g_mmwave", "video_decode_av1", "video_encode_av1", "satellite_connectivity", "av1_decode")
DATE_FIELDS = ("announced", "updated")
ARRAY_FIELDS = ("aliases", "gpu_api", "devices", "alternative_names", "tags")
MAP_FIELDS = ("sources", "provenance", "_extra")

# Groups of fields for quality reports, and weights of completeness (1 where none is given).
FIELD_GROUPS = {
    "identity": ("id", "name", "vendor", "model", "aliases", "codename", "description"),
    "core": ("architecture", "isa", "cores", "threads", "cluster_config", "clock_max", "clock_mid", "clock_min", "max_freq", "cache", "arm_cores_total", "performance_cores", "efficiency_cores", "l2_cache", "l3_cache"),
    "process": ("process_nm", "process_name", "process", "tdp", "package", "die_size"),
    "gpu": ("gpu", "gpu_clock", "gpu_api", "gpu_tflops"),
    "memory": ("memory_type", "memory_max", "memory_clock", "memory_bus", "memory_bandwidth", "storage_type"),
    "ai": ("npu", "ai_ops", "ai_int8_tops", "ai_fp16_tflops", "dsp_type"),
    "modem": ("modem", "modem_dl", "modem_ul", "cellular", "modem_5g_mmwave"),
    "media": ("video_decode", "video_encode", "display_max", "camera_max", "isps", "video_capture", "video_decode_av1", "video_encode_av1", "av1_decode", "display_max_refresh", "display_resolution", "camera_max_mp", "video_capture_max", "isp_config"),
    "connectivity": ("wifi", "wifi_version", "bluetooth", "bluetooth_version", "usb", "usb_version", "navigation", "gnss", "charging", "charging_max_w", "satellite_connectivity", "pcie_version"),
    "lifecycle": ("year", "announced", "revision", "status", "market_segment"),
    "provenance": ("completeness", "sources", "updated", "datasheet_url", "wikipedia_url", "wikidata_id", "linux_dt_compatible", "provenance"),
    "metadata": ("devices", "alternative_names", "parent", "tags", "rating", "benchmarks", "soc_id", "security", "fingerprint"),
}
FIELD_WEIGHTS = (
    dict.fromkeys(("name", "vendor", "model"), 5)
    | dict.fromkeys(("architecture", "cores"), 4)
    | dict.fromkeys(("process_nm", "gpu", "year", "clock_max", "ai_int8_tops", "ai_fp16_tflops", "arm_cores_total"), 3)
    | dict.fromkeys(
        (
            "memory_type", "clock_min", "modem", "npu", "wifi", "bluetooth", "memory_clock", "memory_bus", "display_max", "camera_max", "charging",
            "cluster_config", "market_segment", "charging_max_w", "wifi_version", "modem_5g_mmwave", "video_decode_av1", "video_encode_av1",
            "pcie_version", "usb_version", "bluetooth_version", "satellite_connectivity", "gnss", "fingerprint", "display_max_refresh",
            "display_resolution", "camera_max_mp", "video_capture_max", "isp_config", "dsp_type", "security", "performance_cores",
            "efficiency_cores", "l2_cache", "l3_cache", "soc_id", "package", "die_size",
        ),
        2,
    )
)
#: Fields that are about the record rather than its content.
SYSTEM_FIELDS = frozenset(("id", "uuid", "completeness", "provenance", "sources", "updated", "source"))
#: Fields left out of listings unless asked for.
HEAVY_FIELDS = tuple(("provenance", "sources", "description", "video_decode", "video_encode", "devices", "alternative_names", "tags", "benchmarks", "rating"))


def record_schema() -> T.StructType:
    """Schema of a record; keys outside it go to the map ``_extra``."""
    text, count = T.StringType(), T.IntegerType()
    fields = [T.StructField(c, text) for c in STRING_FIELDS]
    fields += [T.StructField(c, count) for c in INT_FIELDS]
    fields += [T.StructField(c, T.DoubleType()) for c in DOUBLE_FIELDS]
    fields += [T.StructField(c, T.BooleanType()) for c in BOOLEAN_FIELDS]
    fields += [T.StructField(c, T.DateType()) for c in DATE_FIELDS]
    fields += [T.StructField(c, T.ArrayType(text)) for c in ARRAY_FIELDS]
    fields += [T.StructField(c, T.MapType(text, text)) for c in MAP_FIELDS]
    struct = lambda names, t: T.StructType([T.StructField(n, t) for n in names.split()])
    fields.append(T.StructField("cache", struct("l1 l2 l3", text)))
    fields.append(T.StructField("rating", struct("performance efficiency gpu_score ai_score modem_score", T.DoubleType())))
    fields.append(T.StructField("benchmarks", struct("antutu_v10 geekbench_6_single geekbench_6_multi geekbench_5_single geekbench_5_multi", count)))
    return T.StructType(fields)


def _filled(c: Column, kind: T.DataType, empty_map: bool) -> Column:
    if isinstance(kind, T.StringType):
        out = c != ""
    elif isinstance(kind, T.NumericType):
        out = c != 0
    elif isinstance(kind, T.BooleanType):
        out = c
    elif isinstance(kind, T.ArrayType):
        out = F.size(c) > 0
    elif isinstance(kind, T.MapType) and not empty_map:
        out = F.size(c) > 0
    else:
        out = c.isNotNull()
    return F.coalesce(out, F.lit(False))


def is_filled(df: DataFrame, name: str) -> Column:
    """Whether a field has content: not null, '', 0, false or an empty array; an empty map has."""
    return _filled(F.col(f"`{name}`"), df.schema[name].dataType, True)


def is_truthy(df: DataFrame, name: str) -> Column:
    """As is_filled, but an empty map has no content either."""
    return _filled(F.col(f"`{name}`"), df.schema[name].dataType, False)


# Ranges that a record's numbers must be in, and the statuses there are.
RANGES = {"cores": (1, 256), "year": (2007, 2030), "completeness": (0, 1)}
REQUIRED = ("id", "name", "vendor")


def violations(df: DataFrame, required=REQUIRED, ranges=RANGES, id_col: str = "id", id_pattern: str = "^[a-z0-9_]+$") -> DataFrame:
    """Adds ``_violations``, the names of the constraints that a row breaks."""
    rules = [F.when(~is_filled(df, c), F.lit(f"missing_{c}")) for c in required if c in df.columns]
    rules += [F.when(~F.col(c).between(*r), F.lit(f"range_{c}")) for c, r in ranges.items() if c in df.columns]
    if id_col in df.columns and id_pattern:
        rules.append(F.when(~F.col(id_col).cast("string").rlike(id_pattern), F.lit(f"pattern_{id_col}")))
    return df.withColumn("_violations", F.array_compact(F.array(*rules)))
