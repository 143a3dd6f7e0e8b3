"""Records from free text: a page's articles, and ordered rules over their texts.

A page is parsed once into articles with their texts, classed sections and
headings. What a maker's pages say is a table of rules, (field, pattern,
group, form), the first match counts; all of them are applied in one Arrow pass. Sections that need a
parser of their own go on as columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import barrier
from ..functions.scalars import detect_vendor, parse_ai_ops, parse_clock, parse_cpu, parse_memory_max, parse_process_node, parse_tdp, processor_name, trailing_model
from ..functions.text import slug
from ..scratch import written
from .extract import _VOID, spec_records
from .windows import first_wins

ARTICLE_TAGS = ("article", "div", "section", "li")
SECTION_TAGS, HEADING_TAGS, FOLLOWING_TAGS = ("div", "p", "span", "section"), ("h2", "h3", "h4", "h5", "strong"), ("p", "div", "span")


@dataclass
class Node:
    tag: str
    classes: str = ""
    inside: list = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        for x in self.inside:
            if isinstance(x, Node):
                yield x
                yield from x.walk()

    def texts(self) -> Iterator[str]:
        todo = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                todo.extend(reversed(x.inside))
            elif x.strip():
                yield x.strip()

    def text(self) -> str:
        return " ".join(self.texts())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs).get("class") or "", parent=self.at)
        self.at.inside.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.inside.append(data)


def _followed(node: Node) -> list[tuple[str, str]]:
    """(heading, text of the next paragraph beside it) of headings that have a text and nothing else."""
    out = []
    for x in node.walk():
        if x.tag in HEADING_TAGS and len(x.inside) == 1 and isinstance(x.inside[0], str):
            beside = x.parent.inside
            after = beside[next(i for i, y in enumerate(beside) if y is x) + 1 :]
            out.append((x.inside[0], next((y.text() for y in after if isinstance(y, Node) and y.tag in FOLLOWING_TAGS), "")))
    return out


@dataclass(frozen=True)
class Maker:
    """How a maker's articles are read: the classes of articles, name and model, the rules, and the sections that parsers take.

    ``sections`` are (column, pattern, whether a heading will do): the text of the first section whose class
    matches, or of what follows such a heading. ``without`` are rules that count where a section is missing.
    """

    classes: str
    tags: tuple[str, ...]
    name: str
    model: str
    rules: tuple[tuple[str, str, int, str], ...]
    sections: tuple[tuple[str, str, bool], ...] = ()
    without: tuple[tuple[str, str, str, int, str], ...] = ()


# Patterns of makers' articles.
_NM, _LPDDR, _GB = ("process_nm", r"(\d+)\s*nm", 1, "int"), ("memory_type", r"(LPDDR\d[X]?)", 1, "upper"), ("memory_max", r"(?:up to\s+)?(\d+)\s*GB", 1, "int")
_WIFI, _BLUETOOTH = ("wifi", r"(Wi-?Fi\s*\d+|802\.11\w*)", 1, "text"), ("bluetooth", r"Bluetooth\s*([\d.]+)", 1, "text")
_YEAR = ("year", r"\b(200[5-9]|201\d|202\d|2030)\b", 1, "int")
_UP_TO = ("cpu", "clock_max", r"up to\s*([\d.]+)\s*GHz", 1, "thousand")
QUALCOMM = Maker(
    r"(product|chip|card|tile|item)", ("article", "div", "section"), r"Snapdragon\s+\d[\s\w/+]*", r"\b(SM\d{4}|SDM\d{3,}|MSM\d{4,}|APQ\d{4,}|SC\d{4}|QCS\d{3,}|QCM\d{3,})\b",
    (
        _NM, ("gpu", r"(Adreno\s+\d{3,})", 1, "text"), ("npu", r"(Qualcomm\s+)?(AI\s+Engine|Hexagon|NPU|AI\s+accelerator)", 0, "text"), ("ai_ops", r"(\d+)\s*(TOPS|trillion operations per second)", 1, "tops"),
        ("modem", r"(Snapdragon\s+)?(X\d+\s*(LTE|5G)?|Modem|5G|LTE)", 0, "text"), ("modem_dl", r"down\s*([\d.]+)\s*Gbps", 1, "thousand"), ("modem_ul", r"up\s*([\d.]+)\s*Gbps", 1, "thousand"), _LPDDR, _GB, _WIFI, _BLUETOOTH, _YEAR,
        ("display_max", r"(4K|8K|WQHD|FHD\+?|DisplayPort)", 0, "text"), ("camera_max", r"(\d+)\s*MP", 0, "text"),
        ("charging", r"(Quick\s*Charge\s*[\d+.]+|QC\s*[\d+.]*)", 1, "text"), ("charging", r"\A(?=[\s\S]*(?:charging|fast\s*charge))([\s\S]{1,60})", 1, "text"),
    ),
    (("cpu", r"(CPU|Processor|Kryo)", False),), (("cpu", "cores", r"(\d+)[- ]?core", 1, "int"), _UP_TO),
)
MEDIATEK = Maker(
    r"(product|chip|item|card|tile|processor)", ARTICLE_TAGS, r"(Dimensity\s+\d{3,}|Helio\s+\w+\s*\d{3,}|Kompanio\s+\d{3,}|Pentonic\s+\d{3,})", r"\b(MT\d{4,})\b",
    (
        _NM, ("gpu", r"(Immortalis-G\d{3}|Mali-G\d{3,}|Mali-G\d{2}|Arm\s+(Immortalis|Mali))", 0, "text"), _LPDDR, _GB, ("display_max", r"(4K|8K|WQHD\+?|FHD\+?)", 0, "text"), _WIFI, _BLUETOOTH,
        ("modem", r"(5G|LTE|4G|3G)\s*(modem|NR|cellular)", 0, "text"), ("modem_dl", r"(?:download|DL)\s*(?:up to\s+)?([\d.]+)\s*Gbps", 1, "thousand"), _YEAR,
    ),
    (("cpu", r"(CPU|Processor|core)", True), ("npu", r"(APU|NPU|AI)", True)), (("cpu", "cores", r"(\d+)\s*(?:-core|cores?)", 1, "int"), _UP_TO),
)
PROCESSORS = Maker(
    r"(product|processor|chip|card|item)", ARTICLE_TAGS, "", "",
    (
        ("cores", r"(?:cores?|threads?)\s*:?\s*(\d+)\s*/\s*(\d+)", 1, "int"), ("cores", r"(\d+)\s*/\s*(\d+)\s*(?:cores?|threads?)", 1, "int"), ("cores", r"(\d+)\s*(?:-core|cores?)", 1, "int"),
        ("threads", r"(?:cores?|threads?)\s*:?\s*(\d+)\s*/\s*(\d+)", 2, "int"), ("threads", r"(\d+)\s*/\s*(\d+)\s*(?:cores?|threads?)", 2, "int"),
        ("l2_cache", r"L2\s*(?:cache\s+)?(\d+\s*(?:MB|KB))", 1, "text"), ("l3_cache", r"L3\s*(?:cache\s+)?(\d+\s*(?:MB|KB))", 1, "text"), ("memory_type", r"(DDR\d|LPDDR\d)", 1, "upper"),
        ("gpu", r"(Intel\s+(UHD|Iris|Arc)\s+Graphics[\s\w]*|AMD\s+Radeon\s+(Graphics|HD)\s?[\w]*)", 0, "text"), ("socket", r"(LGA\s*\d{3,}|Socket\s+\w+|AM\d|sTR\d|SP\d)", 0, "text"),
    ),
)
INTEL_PREFIXES = ("intel", "core", "xeon", "pentium", "celeron", "atom", "xeon phi", "core ultra")
AMD_PREFIXES = ("amd", "ryzen", "epyc", "threadripper", "athlon", "sempron", "fx-", "a-series")
NPU = r"(?i)APU|NPU|AI\s+Processing\s+Unit"
NAME_LABELS = ("processor", "name", "product", "model")

_FORMS = {"text": str.strip, "upper": str.upper, "int": lambda v: str(int(v)), "thousand": lambda v: str(int(float(v) * 1000)), "tops": lambda v: f"{v} TOPS"}


def articles(pages: DataFrame, key: str, maker: Maker, html: str = "html") -> DataFrame:
    """(key, place, text, name, model, said, one column for each section): the articles of a page that have a name, in order; nested ones too.

    ``said`` is a map from field to text by the maker's rules. Without a
    pattern for it, name and model are null and every article with a text is there.
    """
    kind = pages.schema[key].dataType.simpleString()
    columns = [s[0] for s in maker.sections]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = lambda p: re.compile(p, re.IGNORECASE).search
        fits, name, model = find(maker.classes), find(maker.name), find(maker.model)
        rules = [(f, find(p), g, _FORMS[form]) for f, p, g, form in maker.rules]
        without = [(s, f, find(p), g, _FORMS[form]) for s, f, p, g, form in maker.without]
        sections = [(s, find(p), heads) for s, p, heads in maker.sections]
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tree = _Tree()
                tree.feed(text.as_py() or "")
                tree.close()
                for place, node in enumerate(n for n in tree.root.walk() if n.tag in maker.tags and fits(n.classes)):
                    body = node.text()
                    named = name(body) if maker.name else None
                    if not body or maker.name and not named:
                        continue
                    number = model(body) if maker.model else None
                    parts = {}
                    for s, p, heads in sections:
                        parts[s] = next((t for x in node.walk() if x.tag in SECTION_TAGS and p(x.classes) and (t := x.text())), "")
                        if heads and not parts[s]:
                            parts[s] = next((t for h, t in _followed(node) if p(h)), "")
                    said: dict[str, str] = {}
                    for f, p, g, form in [*rules, *((f, p, g, form) for s, f, p, g, form in without if not parts[s])]:
                        if f not in said and (m := p(body)):
                            said[f] = form(m[g])
                    out.append((k, place, body, named[0].strip() if named else None, number[1].upper() if number else None, said, *(parts[c] or None for c in columns)))
            cells = list(zip(*out)) or [()] * (6 + len(columns))
            types = [batch.column(0).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), *[pa.string()] * len(columns)]
            arrays = [pa.array([list(m.items()) for m in c] if i == 5 else c, t) for i, (c, t) in enumerate(zip(cells, types))]
            yield pa.RecordBatch.from_arrays(arrays, [key, "place", "text", "name", "model", "said", *columns])

    return pages.select(key, html).mapInArrow(read, f"`{key}` {kind}, place int, text string, name string, model string, said map<string, string>" + "".join(f", `{c}` string" for c in columns))


def _with(df: DataFrame, said: Column, values: dict[str, Column], over: bool = False) -> DataFrame:
    """The frame with ``fields``, a map of texts with further values; those that are there stand, or go ``over`` them. The values are made once, behind a barrier."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()]), lambda e: e["v"].isNotNull())
    df, more, said = barrier(df.withColumn("_said", said).withColumn("_more", F.map_from_entries(entries))), F.col("_more"), F.col("_said")
    fields = F.map_concat(F.map_filter(said, lambda k, _: ~F.map_contains_key(more, k)), more) if over else F.map_concat(said, F.map_filter(more, lambda k, _: ~F.map_contains_key(said, k)))
    return df.withColumn("fields", fields)


def _record(df: DataFrame, key: str, name: Column, vendor: Column, model: Column) -> DataFrame:
    return df.select(key, "place", slug(name, F.coalesce(model, F.lit(""))).alias("id"), name.alias("name"), vendor.alias("vendor"), F.coalesce(model, name).alias("model"), "fields")


def phone_records(pages: DataFrame, key: str, maker: Maker, vendor: str, html: str = "html") -> DataFrame:
    """(key, place, id, name, vendor, model, fields) of the articles of QUALCOMM's or MEDIATEK's pages.

    What the section about the processor says goes over the rules; an architecture is
    the text's, else the section's (QUALCOMM) and else a usual one.
    """
    a = articles(pages, key, maker, html)
    a = barrier(a.withColumn("_cpu", parse_cpu(F.col("cpu"))))
    cpu = {k: F.col(f"_cpu.{k}") for k in ("architecture", "cores", "cluster_config", "clock_min", "clock_mid", "clock_max", "max_freq")}
    v8, v9 = F.col("text").contains("ARMv8"), F.col("text").contains("ARMv9")
    if maker is QUALCOMM:
        arch = F.when(v8, "ARMv8.2-A").when(v9, "ARMv9-A").otherwise(F.coalesce(cpu["architecture"], F.lit("ARMv8.2-A")))
        more = {}
    else:
        arch = F.when(v9, "ARMv9-A").otherwise("ARMv8.2-A")
        more = {"npu": F.when(F.col("npu").rlike(NPU), F.left(F.trim("npu"), F.lit(80))), "ai_ops": parse_ai_ops(F.col("npu"))}
    return _record(_with(a, F.col("said"), cpu | more | {"architecture": arch}, over=True), key, F.col("name"), F.lit(vendor), F.col("model"))


def processor_records(pages: DataFrame, tables: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The same of pages about processors: first the tables of labels and values (``tables.page_tables``), then the articles.

    A table is a record if one of its labels is a name's; rows before the first
    of these say nothing, the last of them gives the name. Both are decided where the table is,
    and such tables are written, so that pages are read once for names and values.
    """
    vendor = lambda n: detect_vendor(n, [(p, "Intel") for p in INTEL_PREFIXES] + [(p, "AMD") for p in AMD_PREFIXES])
    a = articles(pages, key, PROCESSORS, html).withColumn("name", processor_name(F.col("text"))).where("name is not null")
    text, clock = F.col("text"), parse_clock(F.col("text"))
    year = F.regexp_extract(text, r"(\d+)", 1).try_cast("int")
    more = {"clock": clock["clock"], "boost": clock["boost"], "tdp": parse_tdp(text), "process_nm": parse_process_node(text), "memory_max": parse_memory_max(text), "year": F.when(year.between(2000, 2026), year)}
    prose = _record(_with(a, F.col("said"), more), key, F.col("name"), vendor(F.col("name")), trailing_model(F.col("name"))).withColumn("_part", F.lit(1))
    text_at = lambda row, i: F.trim(F.get(row, F.lit(i))["text"])
    rows = F.transform("rows", lambda row, i: F.struct(i.alias("place"), F.lower(text_at(row, 0)).alias("k"), text_at(row, 1).alias("v")))
    shown = barrier(tables.select(key, "table_no", F.filter(rows, lambda r: (r["k"] != "") & ~r["v"].isin("—", "-", "", "N/A")).alias("pairs")))
    names = F.filter("pairs", lambda r: r["k"].rlike("|".join(NAME_LABELS)))
    named = barrier(shown.withColumn("names", names)).where("size(names) > 0")
    heads = written(named.select(key, "table_no", F.element_at("names", -1)["v"].alias("name"), F.filter("pairs", lambda r: r["place"] >= F.col("names")[0]["place"]).alias("pairs")))
    pairs = heads.select(F.struct(key, "table_no").alias("t"), F.explode("pairs").alias("r")).select("t", "r.place", "r.k", "r.v")
    specs = spec_records(pairs, "t").select(F.col(f"t.{key}").alias(key), F.col("t.table_no").alias("table_no"), "specs")
    facts = heads.drop("pairs").join(specs.hint("merge"), [key, "table_no"], "left").withColumn("place", F.col("table_no"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    listed = _record(facts.withColumn("fields", F.coalesce("specs", empty)), key, F.col("name"), vendor(F.col("name")), trailing_model(F.col("name"))).withColumn("_part", F.lit(0))
    return listed.unionByName(prose).withColumn("place", F.col("_part") * (1 << 20) + F.col("place")).drop("_part")


def first_records(records: DataFrame, key: str) -> DataFrame:
    """The first record of each id, by page and place."""
    return first_wins(records, ["id"], [key, "place"])


def typed_fields(records: DataFrame, types: dict[str, str]) -> DataFrame:
    """Fields of the map as columns; a text that is no value of its type is null."""
    return records.select("id", "name", "vendor", "model", *[F.try_element_at("fields", F.lit(k)).try_cast(t).alias(k) for k, t in types.items()])
