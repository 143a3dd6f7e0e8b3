"""Records from the tables of pages: upright ones, and those whose records are columns.

A page is parsed once. A table is one row with its cells as arrays, so layout,
names and alignment are decided where the page is read; the texts of
a record's fields become rows of (kind, text), each goes to the parser of its kind, and one
aggregation makes the records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import barrier
from ..functions.scalars import cell_text, detect_column, heading_name, is_spec_label, is_sub_label, record_name
from ..functions.text import clean, extract_model, slug, tidy
from ..scratch import written
from .extract import DEFAULT_ARCHITECTURE, DEFAULT_CORES, SKIPPED_SECTIONS, TYPED, _Tables, typed
from .filters import NAME_PREFIXES, valid_name
from .windows import first_wins

_CELLS = pa.list_(pa.list_(pa.struct([("text", pa.string()), ("head", pa.bool_())])))

# Kinds of a row label where records are columns, by what the label has in it, in the order in which they are tried; all words of an inner tuple must be there.
LABEL_KINDS = (
    ("cpu", (("cpu",), ("core",))),
    ("gpu", (("gpu",), ("graphic",))),
    ("process", (("process",), ("fab",), ("node",))),
    ("memory", (("memory",), ("ram",))),
    ("modem", (("modem",),)),
    ("connectivity", (("connect",), ("wifi",), ("bluetooth",), ("wireless",))),
    ("video", (("video",),)),
    ("display", (("display",), ("screen",))),
    ("camera", (("camera",), ("isp",))),
    ("year", (("launch",), ("released",), ("announced",), ("date",), ("soc",))),
    ("model", (("model", "number"),)),
    ("codename", (("codename",),)),
    ("npu", (("npu",), ("ai",), ("tpu",))),
    ("charging", (("charge",), ("battery",))),
    ("storage", (("storage",), ("ufs",))),
)


def page_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table_no, heading, classes, rows): each table of a page with the heading before it, its rows as arrays of cells (text, head). A null page has none."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, headings, classes, tables = [], [], [], [], []
            for k, text in zip(batch.column(0), batch.column(1)):
                parser = _Tables()
                parser.feed(text.as_py() or "")
                parser.close()
                found: dict[int, tuple[str, dict[int, list]]] = {}
                for table, row, _, cell, head, heading in parser.cells:
                    found.setdefault(table, (heading, {}))[1].setdefault(row, []).append({"text": cell, "head": head})
                for table, (heading, rows) in sorted(found.items()):
                    keys.append(k), numbers.append(table), headings.append(heading), classes.append(parser.classes[table]), tables.append([rows[r] for r in sorted(rows)])
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], batch.column(0).type), pa.array(numbers, pa.int32()), pa.array(headings, pa.string()), pa.array(classes, pa.string()), pa.array(tables, _CELLS)], [key, "table_no", "heading", "classes", "rows"])

    return pages.select(key, html).mapInArrow(parse, f"`{key}` {kind}, table_no int, heading string, classes string, rows array<array<struct<text: string, head: boolean>>>")


def is_turned(rows: Column, label: Callable[[Column], Column] = is_spec_label) -> Column:
    """Whether a table's records are its columns.

    Its corner is blank, it has three rows or more, two of them with data cells,
    and either more than two data rows for each column or labels in half of the first five
    data rows' first cells.
    """
    first = lambda row: F.get(F.filter(row, lambda c: ~c["head"]), F.lit(0))["text"]
    data = F.filter(F.transform(F.slice(rows, 2, 1 << 20), first), lambda t: t.isNotNull())
    early = F.slice(data, 1, 5)
    labels = F.size(F.filter(early, label))
    blank = F.trim(F.coalesce(F.get(F.get(rows, F.lit(0)), F.lit(0))["text"], F.lit(""))) == ""
    return (F.size(rows) >= 3) & blank & (F.size(data) >= 2) & ((F.size(data) > 2 * F.size(F.get(rows, F.lit(0)))) | (2 * labels >= F.size(early)))


def unlabelled(row: Column) -> Column:
    """For each cell of a row whether it is a data cell and no sub-label."""
    return F.transform(row, lambda c: ~(c["head"] | is_sub_label(c["text"])))


def aligned(row: Column, data: Column, column: Column, records: Column) -> Column:
    """A record's text in a row of texts, ``data`` being its ``unlabelled`` cells: the column-th of these, if there are as many as records, else the one as many places after the labels that begin the row. Null if the row is too short."""
    texts = F.filter(row, lambda c, i: F.get(data, i))
    begin = F.array_position(data, True)
    start = F.when(begin > 0, begin - 1).otherwise(F.size(row)).cast("int")
    return F.when(F.size(F.filter(data, lambda d: d)) == records, F.get(texts, column)).otherwise(F.get(row, start + column))


def label_kind(low: Column) -> Column:
    """Kind of a row's label, which is in lower case."""
    out = F.lit(None).cast("string")
    for kind, ways in reversed(LABEL_KINDS):
        hit = F.lit(False)
        for words in ways:
            each = F.lit(True)
            for w in words:
                each = each & low.contains(w)
            hit = hit | each
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def upright_texts(tables: DataFrame, key: str, vendor: Column) -> DataFrame:
    """(key, table_no, place, vendor, name, model, heading, n, kind, text) of tables whose records are rows: a row for each cell of a detected column.

    Columns are counted over data cells. A record's name is what its section's heading says for
    vendors whose tables have none, else its first data cell or the heading.
    """
    kinds = F.transform(F.get("rows", F.lit(0)), lambda c: detect_column(F.lower(F.trim(c["text"]))))
    # Behind barriers, so that a table's kinds and a cell's text are made once, not for each row or each of its uses.
    heads = barrier(tables.select(key, "table_no", "heading", vendor.alias("vendor"), kinds.alias("kinds"), "rows"))
    rows = heads.select(key, "table_no", "heading", "vendor", "kinds", F.posexplode("rows").alias("place", "row")).where("place > 0")
    rows = rows.select(key, "table_no", "place", "heading", "vendor", "kinds", F.filter("row", lambda c: ~c["head"]).alias("row")).where("size(row) >= 2").withColumn("first", F.col("row")[0]["text"])
    named = barrier(rows.withColumn("cell", F.coalesce(tidy(F.col("first")), F.lit(""))))
    name = F.coalesce(heading_name(F.col("vendor"), F.col("heading")), record_name(F.col("cell"), F.coalesce("heading", F.lit("")), NAME_PREFIXES))
    named = barrier(named.withColumn("name", name)).where(valid_name(F.col("name")))
    named = barrier(named.withColumn("row", F.transform("row", lambda c: tidy(c["text"]))))
    cells = F.filter(F.zip_with("kinds", "row", lambda k, c: F.struct(k.alias("kind"), cell_text(c).alias("text"))), lambda x: x["kind"].isNotNull() & x["text"].isNotNull())
    return named.select(key, "table_no", "place", "vendor", "name", extract_model(F.col("first")).alias("model"), "heading", F.posexplode_outer(cells).alias("n", "c")).select("*", "c.kind", "c.text").drop("c")


def turned_texts(tables: DataFrame, key: str, vendor: Column) -> DataFrame:
    """The same of tables whose records are columns: each header cell but the first is a record, row labels choose the kinds.

    Short or doubtful names go with the vendor's before them; of equal names the first column counts.
    """
    t = tables.select(key, "table_no", "heading", vendor.alias("vendor"), "rows", F.transform(F.slice(F.get("rows", F.lit(0)), 2, 1 << 20), lambda c: clean(c["text"])).alias("given"))
    doubtful = lambda n: ~valid_name(n) | (F.length(n) <= 4) | n.rlike(r"^G\d|^[A-Z]\d\s*\(")
    t = barrier(t.withColumn("named", F.transform("given", lambda n: F.when(doubtful(n), F.concat_ws(" ", "vendor", n)).otherwise(n))))
    t = barrier(t.withColumn("fit", F.transform("named", lambda n: F.coalesce(valid_name(n), F.lit(False)))))
    t = t.withColumn("records", F.size(F.filter("fit", lambda f: f)))
    ones = F.transform(F.arrays_zip("named", "fit"), lambda x, i: F.struct(i.alias("place"), x["named"].alias("name"), x["fit"].alias("fit"), (F.array_position("given", F.get("given", i)) - 1).cast("int").alias("column")))
    t = barrier(t.withColumn("ones", F.filter(ones, lambda x: x["fit"])))
    # A row's label and data cells are looked up once, behind a barrier, and not for each record.
    rows = t.select(key, "table_no", "heading", "vendor", "records", "ones", F.posexplode("rows").alias("n", "row")).where("n > 0 and records > 0")
    rows = barrier(rows.select(key, "table_no", "heading", "vendor", "records", "ones", "n", F.lower(tidy(F.col("row")[0]["text"])).alias("label"), unlabelled(F.col("row")).alias("data"), F.col("row.text").alias("texts")))
    rows = barrier(rows.withColumn("kind", label_kind(F.col("label"))))
    each = rows.select("*", F.explode("ones").alias("x")).withColumn("cell", aligned(F.col("texts"), F.col("data"), F.col("x.column"), F.col("records")))
    return each.select(key, "table_no", F.col("x.place").alias("place"), "vendor", F.col("x.name").alias("name"), F.lit(None).cast("string").alias("model"), "heading", "n", "kind", tidy(F.col("cell")).alias("text"))


def with_years(records: DataFrame, group: list[str], place: str) -> DataFrame:
    """Fills ``year`` from the first of name, model and heading with a year from 2007 on; digits of a longer number are no year.

    One of 2000 to 2006 takes the year of the record before it in the table
    instead, if there are two or more before and that one has a year.
    """
    found = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"(?<!\d)(20[0-2]\d)(?!\d)", 1).try_cast("int")
    ys = F.filter(F.array(found(F.col("name")), found(F.col("model")), found(F.col("heading"))), lambda y: y.isNotNull())
    fit = F.get(F.filter("ys", lambda y: y >= 2007), F.lit(0))
    order = Window.partitionBy(*group).orderBy(place)
    rows = barrier(records.withColumn("ys", ys)).withColumn("fit", fit).withColumn("nth", F.row_number().over(order))
    # A record waits for the one before it if an early year comes first.
    rows = rows.withColumn("waits", F.col("year").isNull() & (F.get("ys", F.lit(0)) < 2007) & (F.col("nth") > 2)).withColumn("own", F.coalesce("year", "fit")).withColumn("waits", F.coalesce("waits", F.lit(False)))
    rows = rows.withColumn("run", F.sum((~F.col("waits")).cast("int")).over(order))
    inside = Window.partitionBy(*group, "run").orderBy(place)
    head = F.first(F.when(~F.col("waits"), F.struct("own"))).over(inside)["own"]
    later = F.first(F.when(F.col("waits"), F.col("fit")), ignorenulls=True).over(inside)
    return rows.withColumn("year", F.when(F.col("waits"), F.coalesce(head, later)).otherwise(F.col("own"))).drop("ys", "fit", "nth", "waits", "own", "run")


def page_records(tables: DataFrame, key: str, vendor: Column) -> DataFrame:
    """Typed records of pages' tables: id, name, vendor, model, codename and the fields of TYPED, the first record of each (vendor, id).

    Tables of skipped sections give none. Of an upright table's columns of one field the first
    with content counts for each value; where records are columns a later row's content replaces an
    earlier one's, but the first year stands. Given cores and
    architecture stand in upright tables. Where records are columns, a
    label of a year's kind is no other's.
    """
    low = F.lower(F.coalesce("heading", F.lit("")))
    skipped = F.exists(F.array(*[F.lit(s) for s in SKIPPED_SECTIONS]), lambda s: low.contains(s))
    # Written, so that both layouts read the tables of one pass over the pages.
    t = written(tables.where(~skipped).withColumn("turned", is_turned(F.col("rows"))))
    texts = upright_texts(t.where("not turned and size(rows) >= 2"), key, vendor).withColumn("turned", F.lit(False)).unionByName(turned_texts(t.where("turned"), key, vendor).withColumn("turned", F.lit(True)))
    texts = barrier(texts)
    # An empty text says nothing to a parser, but replaces a text that is taken as it is.
    of = lambda k: F.when(F.col("kind") == k, F.col("text") if k in ("codename", "npu", "charging", "storage") else F.nullif("text", F.lit("")))
    values = typed(of)
    plausible = F.regexp_extract(of("year"), r"(20\d{2})", 1).try_cast("int")
    values["year"] = F.when(F.col("turned"), F.when(plausible.between(2007, 2030), plausible)).otherwise(values["year"])
    number = F.nullif(F.regexp_extract(of("model"), r"([A-Z0-9]{3,}(?:\([A-Z0-9]+\))?)", 1), F.lit(""))
    said = F.when(F.col("turned"), number).otherwise(F.left(F.trim(of("model")), F.lit(120)))
    place = [key, "table_no", "place"]
    parsed = barrier(texts.select(*place, "vendor", "name", "heading", "turned", "n", "model", said.alias("_said"), of("codename").alias("codename"), *[v.alias(k) for k, v in values.items()]))
    order = F.when(F.col("turned"), -F.col("n")).otherwise(F.col("n"))
    first = lambda c, by: F.min_by(c, F.when(F.col(c).isNotNull(), by)).alias(c)
    records = parsed.groupBy(*place).agg(*[F.first(c).alias(c) for c in ("vendor", "name", "heading", "turned", "model")], first("_said", order), first("codename", order), *[first(k, F.col("n") if k == "year" else order) for k in values])
    records = records.withColumn("model", F.coalesce("model", "_said")).withColumn("id", slug(F.col("name")))
    records = first_wins(records, [key, "table_no", "id"], ["place"])
    records = with_years(records, [key, "table_no"], "place")
    for k, default in (("cores", DEFAULT_CORES), ("architecture", DEFAULT_ARCHITECTURE)):
        records = records.withColumn(k, F.coalesce(F.when(F.col("turned"), F.col(k)), F.lit(default)))
    texts_of = ("codename", "npu", "charging", "storage_type", "navigation")
    out = records.select(key, "table_no", "place", "id", "name", "vendor", "model", *[F.nullif(k, F.lit("")).alias(k) if k in texts_of else F.col(k) for k in ("codename", *TYPED)])
    return first_wins(out, ["vendor", "id"], [key, "table_no", "place"]).drop("place")
