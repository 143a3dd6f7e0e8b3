"""Faceted filters, projection, sorting and pages."""

from __future__ import annotations

import base64
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import begins
from ..schema import HEAVY_FIELDS


def equals_ci(c: Column, value: str) -> Column:
    return F.lower(c) == value.lower()


def contains_ci(c: Column, value: str) -> Column:
    """The value as it stands, in either case; ``%`` and ``_`` are no wildcards."""
    return F.lower(c).contains(value.lower())


def at_least(c: Column, value) -> Column:
    """A null counts as 0."""
    return F.coalesce(c, F.lit(0)) >= value


def from_source(c: Column, source: str) -> Column:
    """Whether any value of a provenance map is the source, in either case."""
    return F.coalesce(F.exists(F.map_values(c), lambda s: F.lower(s) == source.lower()), F.lit(False))


# Facets of a catalogue: argument to (column, predicate).
FACETS = {
    "vendor": ("vendor", equals_ci),
    "arch": ("architecture", contains_ci),
    "gpu": ("gpu", contains_ci),
    "year": ("year", lambda c, v: c == v),
    "min_cores": ("cores", at_least),
    "min_ghz": ("clock_max", lambda c, v: at_least(c, int(v * 1000))),
    "min_completeness": ("completeness", at_least),
    "source": ("provenance", from_source),
}


def facet_filter(df: DataFrame, facets=FACETS, **wanted) -> DataFrame:
    """Rows that meet every facet that is given; one that is falsy is off."""
    conditions = [facets[k][1](F.col(facets[k][0]), v) for k, v in wanted.items() if v]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def sort_rows(df: DataFrame, by: str | None = None, descending: bool = False, ties=("vendor", "name", "id")) -> DataFrame:
    """By a column, nulls first upward and last downward, with tie-breakers; an unknown column is an error."""
    ties = [c for c in ties if c in df.columns and c != by]
    if by is None:
        return df.orderBy(*ties) if ties else df
    if by not in df.columns:
        raise ValueError(f"unknown column: {by}")
    return df.orderBy(F.col(by).desc() if descending else F.col(by).asc(), *ties)


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """``limit`` rows from ``offset`` on of a sorted frame; a limit of 0 gives none, without one all are given."""
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def encode_cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(str(offset).encode()).decode()


def decode_cursor(cursor: str) -> int:
    try:
        offset = int(base64.urlsafe_b64decode(cursor.encode()).decode())
    except Exception as e:
        raise ValueError("invalid cursor") from e
    if offset < 0:
        raise ValueError("invalid cursor")
    return offset


def cursor_page(df: DataFrame, total: int, cursor: str | None = None, limit: int = 100, offset: int = 0) -> tuple[DataFrame, str | None]:
    """(page, next cursor or None) of a sorted frame; a cursor goes before an offset."""
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be 1 to 10000")
    offset = decode_cursor(cursor) if cursor else offset
    return page(df, limit, offset), encode_cursor(offset + limit) if offset + limit < total else None


def keyset_page(df: DataFrame, key: str, after=None, limit: int = 100) -> DataFrame:
    """The next rows in order of a unique key; unlike an offset it costs no more far in."""
    return (df.where(F.col(key) > after) if after is not None else df).orderBy(key).limit(limit)


def project(df: DataFrame, fields: list[str] | None = None, heavy=HEAVY_FIELDS) -> DataFrame:
    """The wanted fields that there are, or all but the heavy ones."""
    return df.select(*[c for c in fields if c in df.columns]) if fields else df.drop(*heavy)


def filter_records(df: DataFrame, search=None, sort: str | None = None, descending: bool = False, limit: int | None = None, offset: int = 0, **wanted) -> tuple[DataFrame, int]:
    """(page, total) of facets, a search and a sort together; ``search`` gives a frame of the ids that match."""
    out = facet_filter(df, **wanted)
    if search is not None:
        out = out.join(search.select("id"), "id", "left_semi")
    return page(sort_rows(out, sort, descending), limit, offset), out.count()


# Texts in place of a name, words that name no record, and beginnings of names that need no digit.
NO_NAME = ("", "?", "-", "—", "TBC", "TBD")
NON_NAMES = (
    "armv7", "armv8", "armv9", "android", "linux", "windows", "unknown", "n/a", "samsung", "intel", "nvidia", "apple", "bluetooth", "wifi", "wi-fi", "ethernet", "usb", "pcie",
    "lpddr3", "lpddr4", "lpddr4x", "lpddr5", "lpddr5x", "ddr3", "ddr4", "ddr5", "ufs", "nvme", "emmc", "gps", "gnss", "nfc", "isp", "dsp", "npu", "gpu", "cpu", "tbd", "tbc",
    "announced", "released", "launch", "october", "november", "december", "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "pixel", "device", "devices", "feature", "features",
)
NAME_PREFIXES = (
    "Snapdragon", "Qualcomm", "Microsoft", "Dimensity", "Helio", "Kompanio", "Pentonic", "Exynos", "Kirin", "Tensor", "Apple", "RK", "RV", "MR", "Allwinner", "OMAP", "AM", "DM",
    "Atom", "Celeron", "Pentium", "Xeon", "Jz", "JZ", "i.MX", "IMX", "MCIMX", "SC", "SL", "SP",
)
# How texts begin that are numbers, architectures, sizes and rates, and words of one capital.
NAME_REJECTED = r"^\d+[\s.]|^\d+\s*nm|^\d+x\d+|^[\d.]+\s*(?:mhz|ghz|mb/s|gb/s|gflops|tops)|^armv\d"
ONE_WORD = r"^[A-Z][a-z]{4,}$"


def valid_name(c: Column) -> Column:
    """Whether a text can be a record's name.

    It has a letter and two characters at least, is no listed word, number, size
    or single capitalised word, and has a digit or a known beginning.
    """
    low = F.lower(c)
    bad = c.isin(*NO_NAME) | low.isin(*NON_NAMES) | (F.length(c) < 2) | ~c.rlike("[a-zA-Z]") | low.rlike(NAME_REJECTED) | c.rlike(ONE_WORD)
    return F.coalesce(~bad & (c.rlike(r"\d") | begins(c, NAME_PREFIXES)), F.lit(False))
