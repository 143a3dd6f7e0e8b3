"""Field extraction from cell texts as Column expressions: numbers, units, specs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_match, first_prefix, number
from .text import begins


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    """Group of the first match; null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def extract_int(text: Column) -> Column:
    return number(text, r"(\d+)")


def extract_freq(text: Column) -> Column:
    return F.trim(_first(text, r"(?i)[\d.]+\s*(?:MHz|GHz)"))


def extract_process(text: Column) -> Column:
    return _first(text, r"(?i)\d+\s*nm")


def int_or_null(value: Column) -> Column:
    """A whole number from a number or a text; null if it is none."""
    return F.trim(value.cast("string")).try_cast("int")


# Core names that stand for an architecture or make a cluster.
ARCHITECTURES = (("ARMv9", "ARMv9-A"), ("ARMv8", "ARMv8.2-A"), ("ARMv7", "ARMv7-A"))
ARM_CORES = ("Cortex", "Kryo", "Swift", "Hurricane", "Zephyr", "Mistral", "Lightning", "Thunder", "Avalanche", "Blizzard")
CLUSTER_CORES = r"Cortex|Kryo|Gold|Silver|A\d+|Avalanche|Blizzard|Lightning|Thunder|Everest|Sawtooth|Mistral|Zephyr|Hurricane|Monsoon|Icestorm|Firestorm|Vortex|Tempest|Typhoon|Cyclone"


def parse_cpu(text: Column) -> Column:
    """Struct of architecture, cores, cluster_config, clock_min, clock_mid, clock_max, max_freq.

    Cores come from a total, else the sum of named clusters, else of small
    multipliers (two at least), else a usual number. A clock is in GHz if that
    unit follows the first place where its digits stand.
    """
    arch = F.coalesce(first_match(text, ARCHITECTURES), F.when(text.rlike(r"(?i)\b(?:" + "|".join(ARM_CORES) + r")\b"), "ARMv8.2-A"))
    named = F.regexp_extract_all(text, F.lit(rf"(\d+)[xX*×]\s*(?:[\d.]+\s*(?:GHz|MHz)\s+)?(?:{CLUSTER_CORES})"), F.lit(1))
    ints = lambda a: F.filter(F.transform(a, lambda s: s.try_cast("int")), lambda v: v <= 8)
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    loose = ints(F.regexp_extract_all(text, F.lit(r"(\d+)\s*[xX*×]"), F.lit(1)))
    cores = F.coalesce(
        number(text, r"(?i)(\d+)\s*(?:-core|cores?\b)"),
        F.when(F.size(named) > 0, add(F.transform(named, lambda s: s.try_cast("int")))),
        F.when(F.size(loose) >= 2, add(loose)),
        number(text, r"\b(8|10|12|6|4|16|2)\b"),
    )
    tight = F.transform(ints(F.regexp_extract_all(text, F.lit(r"(\d+)[xX*×]"), F.lit(1))), lambda v: v.cast("string"))
    clusters = F.when(F.size(named) >= 2, named).otherwise(tight)
    speeds = F.regexp_extract_all(text, F.lit(r"(?i)([\d.]+)\s*(?:GHz|MHz)"), F.lit(1))

    def mhz(s: Column) -> Column:
        at = F.instr(text, s)
        # The slice from two before to four after; of a text that begins with the number it is empty.
        near = F.when(at >= 3, F.substring(text, at - 2, F.length(s) + 6)).otherwise("")
        v = s.try_cast("double")
        return F.when(near.contains("GHz"), v * 1000).otherwise(v).cast("int")

    clocks = F.array_sort(F.filter(F.transform(speeds, mhz), lambda v: v.isNotNull()))
    n = F.size(clocks)
    top = F.get(clocks, n - 1)
    freq = F.when(top >= 1000, F.concat(F.format_string("%.2f", top / 1000), F.lit(" GHz"))).otherwise(F.concat(top.cast("string"), F.lit(" MHz")))
    return F.struct(
        arch.alias("architecture"),
        F.when((cores > 0) & (cores <= 256), cores).alias("cores"),
        F.when(F.size(clusters) >= 2, F.array_join(F.slice(clusters, 1, 3), "+")).alias("cluster_config"),
        F.get(clocks, F.lit(0)).alias("clock_min"),
        F.when(n >= 3, F.get(clocks, F.floor(n / 2).cast("int"))).alias("clock_mid"),
        top.alias("clock_max"),
        F.when(n > 0, freq).alias("max_freq"),
    )


def parse_gpu(text: Column) -> Column:
    apis = F.filter(F.array(*[F.lit(x) for x in ("OpenGL ES", "Vulkan", "DirectX", "Metal", "OpenCL")]), lambda a: F.lower(text).contains(F.lower(a)))
    return F.struct(F.left(F.trim(text), F.lit(120)).alias("gpu"), number(text, r"(?i)(\d+)\s*MHz").alias("gpu_clock"), F.when(F.size(apis) > 0, apis).alias("gpu_api"))


def parse_process(text: Column) -> Column:
    nm = number(text, r"(?i)(\d+)\s*nm")
    return F.struct(nm.alias("process_nm"), F.concat(nm.cast("string"), F.lit("nm")).alias("process_name"), F.concat(nm.cast("string"), F.lit(" nm")).alias("process"))


def parse_memory(text: Column) -> Column:
    kinds = [(k, k) for k in ("LPDDR5", "LPDDR4X", "LPDDR4", "LPDDR3", "DDR5", "DDR4", "DDR3")]
    return F.struct(
        first_match(F.upper(text), kinds).alias("memory_type"),
        number(text, r"(?i)(\d+)\s*MHz").alias("memory_clock"),
        number(text, r"(?i)(\d+)\s*GB").alias("memory_max"),
        number(text, r"(?i)(\d+)\s*-?bit").alias("memory_bus"),
    )


def _rate(text: Column, pattern: str) -> Column:
    """Mbit/s of the first match."""
    v = number(text, pattern, 1, "double")
    return F.when(F.upper(F.regexp_extract(text, pattern, 0)).contains("G"), v * 1000).otherwise(v).cast("int")


def parse_modem(text: Column) -> Column:
    unit = r"(?i)([\d.]+)\s*(?:Gbps|Mbps|Gb/s|Mb/s)"
    down = _rate(text, unit)
    stated = (number(text, r"(?i)down\s*([\d.]+)\s*Gbps", 1, "double") * 1000).cast("int")
    return F.struct(F.left(F.trim(text), F.lit(80)).alias("modem"), F.when(down > 0, down).otherwise(F.coalesce(stated, down)).alias("modem_dl"), _rate(text, unit + r"\s*(?:upload|UL|uplink)").alias("modem_ul"))


def parse_connectivity(text: Column) -> Column:
    wifi = F.coalesce(
        F.concat(F.lit("Wi-Fi "), _first(text, r"(?i)Wi-?Fi\s*(\d+|[\d.]+)", 1)),
        _first(text, r"(?i)(802\.11\w*)", 1),
        F.when(text.rlike(r"(?i)\bWi-?Fi\b"), "Wi-Fi"),
    )
    return F.struct(wifi.alias("wifi"), _first(text, r"(?i)Bluetooth\s*([\d.]+)", 1).alias("bluetooth"), F.when(text.rlike(r"\bNFC\b"), "NFC").alias("connectivity"))


def parse_video(text: Column) -> Column:
    return F.left(F.trim(text), F.lit(100))


def parse_display(text: Column) -> Column:
    size = F.concat(_first(text, r"(\d+)×(\d+)", 1), F.lit("×"), _first(text, r"(\d+)×(\d+)", 2))
    rate = F.coalesce(F.concat(F.lit(" @ "), _first(text, r"(\d+)Hz", 1), F.lit("Hz")), F.lit(""))
    return F.coalesce(F.concat(size, rate), F.when(text.rlike("(?i)4K|8K|WQHD|FHD"), F.left(F.trim(text), F.lit(80))))


def parse_camera(text: Column) -> Column:
    return F.struct(F.when(text.rlike(r"(?i)\d+\s*MP"), F.left(F.trim(text), F.lit(80))).alias("camera_max"), number(text, r"(?i)(\d+)\s*(?:ISP|image signal processor)").alias("isps"))


def parse_year(text: Column) -> Column:
    """The first 20xx, if it is a plausible year."""
    y = number(text, r"(20\d{2})")
    return F.when(y.between(2005, 2030), y)


def detect_year(text: Column) -> Column:
    """The first 20xx that is a plausible year."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(20\d{2})"), F.lit(1)), lambda s: s.cast("int"))
    return F.get(F.filter(years, lambda y: y.between(2005, 2030)), F.lit(0))


def keyword_match(text: Column, keyword: str) -> Column:
    """A short keyword as a word, a longer one anywhere; in either case."""
    if len(keyword) <= 3:
        return text.rlike(rf"(?i)\b{keyword}\b")
    return F.lower(text).contains(keyword.lower())


# Header keywords of each field, in the order in which fields are tried.
COLUMN_KEYWORDS = (
    ("model", ("model number", "model", "soc", "chipset", "chip name")),
    ("name", ("product name", "brand", "marketing name")),
    ("cpu", ("cpu", "cpu cores", "cpu config", "cpu cluster")),
    ("gpu", ("gpu", "graphics")),
    ("dsp", ("dsp",)),
    ("npu", ("npu", "ai", "ai accelerator", "machine learning")),
    ("memory", ("memory", "memory support", "ram", "memory type")),
    ("process", ("process", "fabrication", "node", "process node", "technology", "fab", "process technology")),
    ("modem", ("modem", "cellular", "mobile radio")),
    ("connectivity", ("connectivity", "wifi", "wi-fi", "bluetooth", "wireless", "wireless radio technologies")),
    ("charging", ("charging", "charge", "fast charge", "battery charging", "quick charge")),
    ("storage", ("storage", "storage type")),
    ("video", ("video", "video codec", "video encode/decode", "video codecs", "video encoding/decoding")),
    ("display", ("display", "display support", "screen")),
    ("camera", ("camera", "isp", "isps", "image signal", "camera specs")),
    ("location", ("location", "gnss", "navigation", "gps", "positioning")),
    ("year", ("released", "release date", "announced", "launch", "introduced", "year")),
)


def detect_column(header: Column, keywords=COLUMN_KEYWORDS) -> Column:
    """Field of a table's header cell: the first of the list with a keyword in it."""
    out = F.lit(None).cast("string")
    for field, words in reversed(keywords):
        hit = keyword_match(header, words[0])
        for w in words[1:]:
            hit = hit | keyword_match(header, w)
        out = F.when(hit, F.lit(field)).otherwise(out)
    return out


def cell_text(text: Column) -> Column:
    """A cell's text; null where it only marks that there is none."""
    t = F.trim(text)
    return F.when(~t.isin("—", "-", "?", "", "N/A", "n/a"), t)


def detect_vendor(name: Column, prefixes) -> Column:
    """Vendor of the first prefix that the name starts with, in either case; else Unknown."""
    return first_prefix(F.lower(name), [(p.lower(), v) for p, v in prefixes], "Unknown")


def model_token(name: Column) -> Column:
    return _first(name, r"[A-Za-z]+[- ]?\d{3,}\w*")


def parse_tdp(text: Column) -> Column:
    return number(text, r"(\d+)\s*W")


def parse_cache_size(text: Column) -> Column:
    p = r"(?i)([\d.]+)\s*(KB|MB)"
    return F.concat(_first(text, p, 1), F.lit(" "), F.upper(_first(text, p, 2)))


def parse_memory_max(text: Column) -> Column:
    p = r"(?i)(\d+)\s*(GB|TB)"
    return F.concat(_first(text, p, 1), F.lit(" "), F.upper(_first(text, p, 2)))


def parse_clock(text: Column) -> Column:
    """Struct of base and boost in GHz."""
    v = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)([\d.]+)\s*(?:GHz|to)"), F.lit(1)), lambda s: s.try_cast("double"))
    return F.struct(F.get(v, F.lit(0)).alias("clock"), F.get(v, F.lit(1)).alias("boost"))


def parse_core_thread(text: Column) -> Column:
    """Struct of cores and threads; threads are as many as cores where only one number is given."""
    v = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda s: s.try_cast("int"))
    return F.struct(F.get(v, F.lit(0)).alias("cores"), F.coalesce(F.get(v, F.lit(1)), F.get(v, F.lit(0))).alias("threads"))


# Nanometres of named process nodes.
INTEL_NODES = {7: 10, 4: 7, 3: 5, 20: 14, 22: 14}


def parse_process_node(text: Column) -> Column:
    node = number(text, r"(?i)Intel\s*(\d+)")
    named = F.lit(None).cast("int")
    for n, nm in INTEL_NODES.items():
        named = F.when(node == n, nm).otherwise(named)
    return F.coalesce(number(text, r"(?i)(\d+)\s*nm"), named)


def parse_score(text: Column) -> Column:
    """A whole number with thousands separators; fractions are cut."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double").cast("int")


def parse_benchmark_value(text: Column) -> Column:
    return F.replace(F.replace(F.trim(text), F.lit(","), F.lit("")), F.lit(" "), F.lit("")).try_cast("double")


def parse_npu(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)NPU|APU|neural|\bAI\b"), F.left(F.trim(text), F.lit(80)))


def parse_ai_ops(text: Column) -> Column:
    return F.concat(_first(text, r"(?i)([\d.]+)\s*TOPS", 1), F.lit(" TOPS"))


def parse_charging(text: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Quick Charge "), _first(text, r"(?i)Quick\s*Charge\s*([\d.+]+)", 1)), F.nullif(F.left(F.trim(text), F.lit(60)), F.lit("")))


def page_title(url: Column) -> Column:
    return _first(url, r"/wiki/([^?#]+)", 1)


def api_url(title: Column, base: str) -> Column:
    """URL of a page's parse request; blanks are written %20."""
    return F.concat(F.lit(base + "?action=parse&format=json&prop=text&page="), F.replace(F.url_encode(title), F.lit("+"), F.lit("%20")))


def etag(*columns: str) -> Column:
    return F.md5(F.to_json(F.struct(*columns)))


def trailing_model(name: Column) -> Column:
    """Digits, three at least, that end a name, with what follows them; else the last word that has three digits."""
    end = F.nullif(F.ltrim(F.regexp_extract(F.trim(name), r"[- ]?(\d{3,}[A-Za-z0-9]*)$", 1)), F.lit(""))
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w.rlike(r"\d{3,}"))
    return F.coalesce(end, F.try_element_at(words, F.lit(-1)))


# Patterns of processor names in the order in which they are tried.
PROCESSOR_NAMES = (
    r"(?i)Intel\s+(?:Core\s+(?:Ultra\s+\d+\s+)?\w+\s*-?\d{3,}|Xeon\s+\w+\s*\d{3,}|Pentium|Celeron|Atom\s+\w+)",
    r"(?i)AMD\s+(?:Ryzen\s+(?:\w+\s+)?\d{3,}|EPYC\s+\d{3,}|Threadripper|Athlon\s+\w+\s*\d{3,})",
    r"(?i)\b(?:Core|Ryzen)\s+\w+\s*\d{3,}",
)


def processor_name(text: Column) -> Column:
    return F.coalesce(*[F.trim(_first(text, p)) for p in PROCESSOR_NAMES])


def apple_chip(text: Column) -> Column:
    """Name of an M or A series chip with its suffix, as it is written."""
    m, a = r"(?i)\bM([1-4])\s*(Pro|Max|Ultra)?\b", r"(?i)\bA(1[5-9])\s*(Bionic|Pro)?\b"
    named = lambda letter, p: F.when(text.rlike(p), F.concat_ws(" ", F.concat(F.lit(letter), F.regexp_extract(text, p, 1)), F.nullif(F.regexp_extract(text, p, 2), F.lit(""))))
    return F.coalesce(named("M", m), named("A", a))


def record_name(cell: Column, heading: Column, prefixes: tuple[str, ...]) -> Column:
    """A record's name: the cell if it begins like one, else the heading of its section."""
    text = F.trim(F.regexp_replace(cell, r"\s*\[.*?\]\s*", " "))
    before = lambda c: F.trim(F.split(c, r"\[")[0])
    return (
        F.when(begins(text, prefixes), before(text))
        .when(text.rlike(r"^[A-Z][A-Za-z0-9]{2,}\d{2,}"), F.left(before(text), F.lit(60)))
        .when(begins(heading, prefixes), before(heading))
        .otherwise(_first(heading, r"(?i)(Tegra\s+\d\w*|i\.MX\s+[\d\w]+|Atom\s+\w+)", 1))
    )


def heading_name(vendor: Column, heading: Column) -> Column:
    """Name that a section's heading gives to its records, for vendors whose tables have none."""
    return (
        F.when(vendor == "Nvidia", _first(heading, r"(?i)(Tegra\s+\d+\w*)", 1))
        .when(vendor == "NXP i.MX", F.replace(_first(heading, r"(?i)(i\.MX[\s-]*\d\w*)", 1), F.lit("-"), F.lit(" ")))
        .when(vendor == "Intel Atom", F.concat(F.lit("Atom "), _first(heading, r"Atom\s+\w+")))
    )


# Texts that are labels of specifications, not of records.
SPEC_LABELS = (
    r"armv\d", r"^\d+\s*(nm|bit|gb|mb|ghz|mhz|gflops|tops|core)", r"(mhz|ghz|gb/s|mb/s|gflops|tops|nm)$", r"^(october|november|december|january|february|march|april|may|june|july|august|september)\b",
    r"^\d{4}-\d{2}-\d{2}", r"octa.nucleo|nona.core|hexa.core|quad.core|dual.core", r"^64.bits?|^32.bits?", r"\d×\d+\s*bit", r"lpddr|ddr\d", r"ufs\s*\d\.", r"wifi|bluetooth|gnss|nfc",
    r"^(feature|device|model number|part number|codename|fabrication|manufacturer|memory|storage|connectivity|charging|video|camera|display)", r"^trustzone|^trusty\s+os", r"^edge\s+tpu",
    r"^gen\s+\d+\s+edge\s+tpu", r"exynos\s+\d+\w?\b", r"^mali\b", r"^\d+x\s+\d+-bit", r"^quad-channel", r"^1st\s+gen|^2nd\s+gen|^3rd\s+gen|^\d+th\s+gen",
)
SUB_LABELS = ("launch date", "type", "frequency", "speed", "bandwidth", "bit width", "bus width", "model number", "part number", "codename", "μarch", "isa", "fabrication", "manufacturer")


#: Fixed value: units that make a label of any text that has them.
SPEC_UNITS = r"(mhz|ghz|tops|gflops|fps|gbps|mbps)\b"


def is_spec_label(text: Column) -> Column:
    """Whether a text is the label of a specification; one without a letter is."""
    low = F.lower(F.trim(text))
    return ~low.rlike("[a-z]") | low.rlike("|".join(f"(?:{p})" for p in (SPEC_UNITS, *SPEC_LABELS)))


def is_sub_label(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*SUB_LABELS)
