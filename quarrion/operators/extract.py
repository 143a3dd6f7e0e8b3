"""Extraction from pages: HTML elements and tables, JSON-LD, records from tables."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (
    cell_text,
    detect_column,
    extract_int,
    heading_name,
    is_spec_label,
    model_token,
    parse_benchmark_value,
    parse_cache_size,
    parse_camera,
    parse_clock,
    parse_connectivity,
    parse_core_thread,
    parse_cpu,
    parse_display,
    parse_gpu,
    parse_memory,
    parse_memory_max,
    parse_modem,
    parse_process,
    parse_process_node,
    parse_score,
    parse_tdp,
    parse_video,
    parse_year,
    record_name,
)
from ..functions.rules import barrier
from ..functions.text import clean, extract_model, slug
from .filters import NAME_PREFIXES, valid_name
from .windows import first_wins

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Tables(HTMLParser):
    """Cells of all tables, with the heading before them and whether a cell is a header."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple] = []
        self.classes: list[str] = []
        self.heading, self.table, self.open_tables = "", -1, []
        self.text: list[str] | None = None
        self.head: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table += 1
            self.classes.append(dict(attrs).get("class") or "")
            self.open_tables.append([self.table, -1, -1])
        elif tag == "tr" and self.open_tables:
            self._close()
            self.open_tables[-1][1] += 1
            self.open_tables[-1][2] = -1
        elif tag in ("td", "th") and self.open_tables:
            self._close()
            self.open_tables[-1][2] += 1
            self.text, self.is_head = [], tag == "th"
        elif tag in ("h1", "h2", "h3", "h4"):
            self.head = []

    def _close(self):
        if self.text is not None and self.open_tables:
            t, r, c = self.open_tables[-1]
            self.cells.append((t, r, c, " ".join(" ".join(self.text).split()), self.is_head, self.heading))
        self.text = None

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._close()
        elif tag == "table" and self.open_tables:
            self._close()
            self.open_tables.pop()
        elif tag in ("h1", "h2", "h3", "h4") and self.head is not None:
            self.heading, self.head = " ".join(" ".join(self.head).split()), None

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)
        if self.head is not None:
            self.head.append(data)


class _Elements(HTMLParser):
    """Texts of elements of some tags, in order of their starts."""

    def __init__(self, tags: frozenset):
        super().__init__(convert_charrefs=True)
        self.tags, self.out, self.open = tags, [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.tags and tag not in _VOID:
            # One that may not nest ends where the next of its kind starts.
            if tag in ("p", "li"):
                self.handle_endtag(tag)
            self.out.append([tag, dict(attrs), []])
            self.open.append((tag, self.out[-1]))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k]
                break

    def handle_data(self, data):
        for _, e in self.open:
            e[2].append(data)


@F.udtf(returnType="table_no int, row_no int, col_no int, text string, is_header boolean, heading string")
class TableCells:
    """One row for each cell of each table of a page."""

    def eval(self, html: str):
        if html:
            p = _Tables()
            p.feed(html)
            p.close()
            yield from p.cells


@F.udtf(returnType="tag string, place int, text string, href string")
class Elements:
    """One row for each element of the wanted tags (a comma-joined list)."""

    def eval(self, html: str, tags: str):
        if html:
            p = _Elements(frozenset(tags.split(",")))
            p.feed(html)
            p.close()
            for k, (tag, attrs, text) in enumerate(p.out):
                yield tag, k, " ".join("".join(text).split()), attrs.get("href")


def table_cells(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    return pages.select(key, html).lateralJoin(TableCells(F.col(html).outer())).select(key, "table_no", "row_no", "col_no", "text", "is_header", "heading")


def elements(pages: DataFrame, key: str, tags: list[str], html: str = "html") -> DataFrame:
    return pages.select(key, html).lateralJoin(Elements(F.col(html).outer(), F.lit(",".join(tags)))).select(key, "tag", "place", "text", "href")


def standard_records(cells: DataFrame, key: str) -> DataFrame:
    """(key, table_no, row_no, fields): each row below the header as a map from detected field to text, the first cell of a field."""
    head = cells.where("row_no = 0").select(key, "table_no", "col_no", detect_column(F.lower(F.trim("text"))).alias("field")).where("field is not null")
    body = cells.where("row_no > 0").withColumn("text", cell_text(F.col("text"))).where("text is not null")
    rows = first_wins(body.join(head, [key, "table_no", "col_no"]), [key, "table_no", "row_no", "field"], ["col_no"])
    return rows.groupBy(key, "table_no", "row_no").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "text")))).alias("fields"))


#: Fields of a typed record that parsers fill, with their types.
TYPED = {
    "cores": "int", "architecture": "string", "gpu": "string", "gpu_clock": "int", "process_nm": "int", "process_name": "string", "memory_type": "string", "memory_clock": "int", "memory_max": "int", "memory_bus": "int",
    "modem": "string", "modem_dl": "int", "modem_ul": "int", "wifi": "string", "bluetooth": "string", "video_decode": "string", "display_max": "string", "camera_max": "string", "isps": "int", "year": "int",
    "npu": "string", "charging": "string", "storage_type": "string", "navigation": "string",
}


#: Fields of a page's tables that go to parsers.
FIELDS = ("cpu", "gpu", "process", "memory", "modem", "connectivity", "video", "display", "camera", "year", "npu", "charging", "storage", "location")


def typed(text: Callable[[str], Column]) -> dict[str, Column]:
    """What the parsers of a record's fields give; a field that a parser doesn't fill is null.

    ``text`` gives the text of each of FIELDS; it goes to the parser of its
    kind, text without one is cut to 80 letters.
    """
    short = lambda k: F.left(F.trim(text(k)), F.lit(80))
    cpu, gpu, process, memory, modem, radio, camera = (f(text(k)) for f, k in ((parse_cpu, "cpu"), (parse_gpu, "gpu"), (parse_process, "process"), (parse_memory, "memory"), (parse_modem, "modem"), (parse_connectivity, "connectivity"), (parse_camera, "camera")))
    out = {
        "cores": cpu["cores"], "architecture": cpu["architecture"], "gpu": gpu["gpu"], "gpu_clock": gpu["gpu_clock"], "process_nm": process["process_nm"], "process_name": process["process_name"],
        "memory_type": memory["memory_type"], "memory_clock": memory["memory_clock"], "memory_max": memory["memory_max"], "memory_bus": memory["memory_bus"], "modem": modem["modem"], "modem_dl": modem["modem_dl"], "modem_ul": modem["modem_ul"],
        "wifi": radio["wifi"], "bluetooth": radio["bluetooth"], "video_decode": parse_video(text("video")), "display_max": parse_display(text("display")), "camera_max": camera["camera_max"], "isps": camera["isps"],
        "year": parse_year(text("year")), "npu": short("npu"), "charging": short("charging"), "storage_type": short("storage"), "navigation": short("location"),
    }
    return {k: v.cast(TYPED[k]) for k, v in out.items()}


#: What a record is taken to have where its page says nothing; sections without records.
DEFAULT_CORES, DEFAULT_ARCHITECTURE = 8, "ARMv8.2-A"
SKIPPED_SECTIONS = ("features of", "comparison", "acronym", "bluetooth", "qcc", "finances", "acquisitions", "products", "history")


def key_value_records(cells: DataFrame, key: str) -> DataFrame:
    """(key, table_no, fields): tables of two columns as a map from lower-case label to value."""
    label, value = F.max(F.when(F.col("col_no") == 0, F.lower(F.trim("text")))), F.max(F.when(F.col("col_no") == 1, F.trim("text")))
    two = cells.where(F.col("col_no") < 2).groupBy(key, "table_no", "row_no").agg(label.alias("_label"), value.alias("_value"))
    two = first_wins(two.where("_label <> '' and _value is not null"), [key, "table_no", "_label"], ["row_no"])
    return two.groupBy(key, "table_no").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_label", "_value")))).alias("fields"))


def score_rows(cells: DataFrame, key: str, least: int = 100) -> DataFrame:
    """(key, table_no, row_no, name, single, multi, compute): the first three scores above ``least`` of each row."""
    rows = cells.groupBy(key, "table_no", "row_no").agg(F.sort_array(F.collect_list(F.struct("col_no", "text"))).alias("c"))
    scores = F.filter(F.transform("c", lambda x: parse_score(x["text"])), lambda v: v > least)
    return rows.select(key, "table_no", "row_no", F.col("c")[0]["text"].alias("name"), *[F.get(scores, F.lit(i)).alias(n) for i, n in enumerate(("single", "multi", "compute"))]).where("single is not null")


def jsonld(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, place, item): items of JSON-LD scripts: an object, the elements of an array, or of an ItemList."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="?application/ld\+json"?[^>]*>(.*?)</script>'), F.lit(1))
    blocks = pages.select(key, F.posexplode(scripts).alias("script_no", "json")).select(key, "script_no", F.expr("try_parse_json(json)").alias("v")).where("v is not null")
    lists = F.expr("coalesce(try_variant_get(v, '$.itemListElement', 'array<variant>'), try_variant_get(v, '$', 'array<variant>'), array(v))")
    items = blocks.select(key, "script_no", F.posexplode(lists).alias("place", "e"))
    return items.select(key, "script_no", "place", F.expr("to_json(coalesce(try_variant_get(e, '$.item', 'variant'), e))").alias("item"))


def jsonld_records(items: DataFrame, key: str) -> DataFrame:
    """(key, place, name, single, multi): scores by their own keys, else from the description."""
    get = lambda p: F.get_json_object("item", p)
    said = lambda p: parse_score(F.nullif(F.regexp_extract(F.coalesce(get("$.description"), F.lit("")), p, 1), F.lit("")))
    return items.select(
        key, "place", get("$.name").alias("name"),
        F.coalesce(parse_score(get("$.singleCoreScore")), said(r"(?i)single[- ]core[^\d]*([\d,]+)")).alias("single"),
        F.coalesce(parse_score(get("$.multiCoreScore")), said(r"(?i)multi[- ]core[^\d]*([\d,]+)")).alias("multi"),
    )


def binding_records(bindings: DataFrame, qid: str = "item", pos: str = "pos") -> DataFrame:
    """The first binding of each item, its variables as a map from name to value; bindings are maps to (type, value)."""
    rows = bindings.withColumn("values", F.transform_values("binding", lambda k, v: v["value"]))
    rows = rows.withColumn("qid", F.regexp_extract(F.try_element_at("values", F.lit(qid)), r"(Q\d+)$", 1)).where("qid <> ''")
    return first_wins(rows, ["qid"], [pos]).select("qid", "values")


def largest_or_named(cells: DataFrame, key: str, words: tuple[str, ...]) -> DataFrame:
    """Cells of one table a page: the first whose beginning has one of the words, else the one of most rows."""
    head = F.lower(F.left(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "col_no", "text"))), lambda c: c["text"]), " "), F.lit(200)))
    per = cells.groupBy(key, "table_no").agg(head.alias("_head"), F.max("row_no").alias("_rows"))
    named = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.col("_head").contains(w))
    order = [(~named).cast("int"), F.when(named, F.col("table_no")).otherwise(-F.col("_rows")), "table_no"]
    chosen = first_wins(per, [key], order).select(key, "table_no")
    return cells.join(chosen, [key, "table_no"], "left_semi")


def benchmark_records(cells: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(key, row_no, name, fields): each row's numbers by field; ``columns`` maps field to the pattern of its header.

    Plain header words (processor, core, clock, tdp) go before the patterns,
    so a header that has both is the plain field.
    """
    low, text = F.lower(F.col("text")), F.col("text")
    pattern = F.lit(None).cast("string")
    for f, p in reversed(columns.items()):
        pattern = F.when(text.rlike(p), F.lit(f)).otherwise(pattern)
    field = (
        F.when(low.rlike("processor|name|model"), "name")
        .when(low.contains("core") & ~low.rlike("thread|clock"), "cores")
        .when(low.rlike("clock|speed"), "clock")
        .when(low.rlike("tdp|power"), "tdp")
        .otherwise(pattern)
    )
    head = cells.where("row_no = 0").select(key, "table_no", "col_no", field.alias("field")).where("field is not null")
    body = cells.where("row_no > 0 and trim(text) <> ''").join(head, [key, "table_no", "col_no"])
    value = parse_benchmark_value(F.col("text"))
    rows = body.groupBy(key, "table_no", "row_no").agg(
        F.min_by(F.when(F.col("field") == "name", F.col("text")), F.when(F.col("field") == "name", F.col("col_no"))).alias("name"),
        F.sort_array(F.collect_list(F.when((F.col("field") != "name") & value.isNotNull(), F.struct("field", value.alias("value"))))).alias("f"),
    )
    # Of columns of one field the largest value stays, so that a map can hold it.
    latest = F.aggregate("f", F.create_map().cast("map<string,double>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["field"]), F.create_map(x["field"], x["value"])))
    return rows.where("name is not null").select(key, "table_no", "row_no", "name", latest.alias("fields"))


def positional_records(cells: DataFrame, key: str) -> DataFrame:
    """Processor rows: name, cores/threads, clock, process and TDP by place, the rest by what their text looks like.

    Of the remaining cells the first of each kind counts; a cell is of the
    first kind that fits: memory, cache, graphics, socket, year.
    """
    rows = cells.where("row_no > 0").groupBy(key, "table_no", "row_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "text"))), lambda c: c["text"]).alias("c")).where(F.size("c") >= 6)
    at = lambda k: F.get("c", F.lit(k))
    rest = F.filter(F.slice("c", 6, 1 << 20), lambda t: ~F.trim(t).isin("", "—", "-", "N/A"))
    year_of = lambda t: extract_int(t)
    kinds = (
        ("memory", lambda t: t.rlike(r"(?i)(?:LP)?DDR\d")),
        ("cache", lambda t: t.rlike(r"(?i)L2|L3")),
        ("gpu", lambda t: t.rlike(r"(?i)Intel|AMD|Radeon|Iris|UHD|Graphics|Adreno|Mali")),
        ("socket", lambda t: t.rlike(r"(?i)LGA|Socket|AM\d|BGA|sTR|SP\d")),
        ("year", lambda t: year_of(t).between(2000, 2026)),
    )

    def kind(t):
        out = F.lit(None).cast("string")
        for name, fits in reversed(kinds):
            out = F.when(fits(t), F.lit(name)).otherwise(out)
        return out

    pick = lambda k: F.get(F.filter(rest, lambda t: kind(t) == k), F.lit(0))
    name = F.trim(at(0))
    cores, clock = parse_core_thread(at(1)), parse_clock(at(2))
    memory = F.upper(F.nullif(F.regexp_extract(pick("memory"), r"(?i)((?:LP)?DDR\dX?)", 1), F.lit("")))
    out = rows.select(
        key, "row_no", name.alias("name"), model_token(name).alias("model"), slug(name, F.coalesce(model_token(name), F.lit(""))).alias("id"), cores["cores"].alias("cores"), cores["threads"].alias("threads"),
        clock["clock"].alias("clock"), clock["boost"].alias("boost"), parse_process_node(at(3)).alias("process_nm"), parse_tdp(at(4)).alias("tdp"), memory.alias("memory_type"), parse_memory_max(pick("memory")).alias("memory_max"),
        F.when(F.upper(pick("cache")).contains("L2"), parse_cache_size(pick("cache"))).alias("l2_cache"), F.when(~F.upper(pick("cache")).contains("L2"), parse_cache_size(pick("cache"))).alias("l3_cache"),
        pick("gpu").alias("gpu"), pick("socket").alias("socket"), year_of(pick("year")).alias("year"),
    )
    return first_wins(out, ["id"], [key, "row_no"])


def spec_records(pairs: DataFrame, key: str) -> DataFrame:
    """(key, specs): specification fields from rows of (key, place, k, v), the label's words deciding; the first row of a field counts."""
    k, v = F.lower(F.col("k")), F.trim(F.col("v"))
    shown = F.when(~v.isin("—", "-", "", "N/A"), v)
    text = lambda c: c.cast("string")
    named = F.array_compact(
        F.array(*[
            F.when(fits & value.isNotNull(), F.struct(F.lit(name).alias("field"), value.alias("value")))
            for name, fits, value in (
                ("cores", k.contains("core") & ~k.contains("thread"), text(parse_core_thread(v)["cores"])),
                ("threads", k.contains("thread") | k.contains("core"), text(F.when(k.contains("thread"), parse_core_thread(v)["cores"]).otherwise(parse_core_thread(v)["threads"]))),
                ("clock", k.rlike("clock|frequency|speed"), text(parse_clock(v)["clock"])),
                ("boost", k.rlike("clock|frequency|speed"), text(parse_clock(v)["boost"])),
                ("tdp", k.rlike("tdp|power"), text(parse_tdp(v))),
                ("l2_cache", k.contains("cache") & k.rlike("l2|level 2"), parse_cache_size(v)),
                ("l3_cache", k.contains("cache") & ~k.rlike("l2|level 2"), parse_cache_size(v)),
                ("process_nm", k.rlike("process|lithography"), text(parse_process_node(v))),
                ("memory_type", k.rlike("memory|ram"), F.upper(F.nullif(F.regexp_extract(v, r"(?i)((?:LP)?DDR\d)", 1), F.lit("")))),
                ("memory_max", k.rlike("memory|ram"), parse_memory_max(v)),
                ("gpu", k.rlike("graphics|gpu"), shown),
                ("socket", k.contains("socket"), shown),
                ("year", k.rlike("year|launch|introduced"), text(F.when(extract_int(v).between(2000, 2026), extract_int(v)))),
            )
        ])
    )
    rows = first_wins(pairs.select(key, "place", F.explode(named).alias("s")).select(key, "place", "s.field", "s.value"), [key, "field"], ["place"])
    return rows.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("specs"))
