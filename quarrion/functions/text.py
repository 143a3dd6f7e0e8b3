"""Text scalars as Column expressions: cleaning, slugs, identifiers, similarity."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .rules import first_pattern

# Words that a slug leaves out.
SLUG_STOP = tuple(("with", "and", "the", "for", "integrated", "support", "using", "based", "cores", "ghz", "mhz", "kryo", "cortex"))
# Model number patterns in the order in which they are tried.
MODEL_PATTERNS = (
    r"(?i)\b(SM\d{3,}|SDM\d{3,}|MSM\d{3,}|APQ\d{3,}|SC\d{4}|QCS\d{3})\b",
    r"(?i)\b(MT\d{4,})\b",
    r"(?i)\b(Exynos\s*\d{4,})\b",
    r"(?i)\b(Kirin\s*\d{3,})\b",
    r"(?i)\b(GS\d{3})\b",
    r"(?i)\b(RK\d{3,})\b",
    r"(?i)\b(OMAP\d{4,})\b",
    r"(?i)\b(AM\d{3,}|DM\d{3,})\b",
    r"(?i)\b(APL\w+|T\d{4})\b",
)
#: Fixed value: the DNS namespace of name-based identifiers, in hex.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def tidy(text: Column) -> Column:
    """Without tags, bracketed words and a ``(now ...)`` note, with single spaces."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    out = F.regexp_replace(out, r"\[\w+\]", "")
    return strip_now(F.trim(F.regexp_replace(out, r"\s+", " ")))


def clean(text: Column) -> Column:
    """A text that is tidied; null if nothing is left."""
    return F.nullif(tidy(text), F.lit(""))


def begins(text: Column, prefixes: Sequence[str]) -> Column:
    """Whether a text, taken once, starts with one of the prefixes."""
    return text.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")")


def strip_now(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\(now\s+[^)]*?\)", ""))


def slug(name: Column, model: Column | None = None) -> Column:
    """Identifier of a name, its first six words that count, with the model if it isn't in there."""
    s = F.replace(F.replace(F.replace(F.lower(name), F.lit("+"), F.lit("p")), F.lit("®"), F.lit("")), F.lit("-"), F.lit("_"))
    words = F.filter(F.split(F.regexp_replace(s, "[^a-z0-9_ ]", ""), " +"), lambda w: (w != "") & ~w.isin(*SLUG_STOP))
    base = F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 6), "_")).otherwise("chip")
    if model is not None:
        m = F.regexp_replace(F.lower(F.coalesce(model, F.lit(""))), "[^a-z0-9]", "")
        base = F.when((m != "") & ~base.contains(m), F.concat(base, F.lit("_"), m)).otherwise(base)
    base = F.trim(F.regexp_replace(base, "_+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(base, F.lit("")), F.lit("unknown"))


def uuid5(key: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Name-based identifier (version 5) as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(key, "utf-8")))
    variant = F.substring(F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), 1, 1)
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def record_uuid(vendor: Column, model: Column) -> Column:
    return uuid5(F.concat(F.lower(F.trim(vendor)), F.lit(":"), F.lower(F.trim(model))))


def canonical_id(vendor: Column, model: Column, name: Column) -> Column:
    """The identifier of vendor and model, or a slug where the model has no letter or digit."""
    return F.when(model.rlike("[a-zA-Z0-9]"), record_uuid(vendor, model)).otherwise(slug(name, model))


def normal_model(model: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(model)), r"[^a-z0-9 \-]", "")


def extract_model(text: Column) -> Column:
    """First model number by the order of the patterns, in upper case."""
    return F.upper(first_pattern(text, MODEL_PATTERNS))


def token_sort(text: Column) -> Column:
    """The words in order, as they are compared."""
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != "")), " ")


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (both lengths): the longest common subsequence by a fold over the letters."""
    n = F.length(b)
    zero = F.array_repeat(F.lit(0), n + 1)
    letters = F.filter(F.split(b, ""), lambda c: c != "")

    def row(prev: Column, x: Column) -> Column:
        grown = F.aggregate(
            F.sequence(F.lit(1), n), F.array(F.lit(0)),
            lambda cur, j: F.concat(cur, F.array(
                F.when(F.get(letters, j - 1) == x, F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.get(cur, j - 1)))
            )),
        )
        return F.when(n > 0, grown).otherwise(zero)

    table = F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), zero, row)
    total = F.length(a) + n
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * F.get(table, n) / total)


@F.pandas_udf(IntegerType())
def common_letters(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two texts, all of the first one's letters in one integer; for many pairs."""
    out = []
    for x, y in zip(a, b):
        where: dict[str, int] = {}
        for k, c in enumerate(x):
            where[c] = where.get(c, 0) | 1 << k
        full = v = (1 << len(x)) - 1
        for c in y:
            u = v & where.get(c, 0)
            v = (v + u | v - u) & full
        out.append(len(x) - v.bit_count())
    return pd.Series(out, dtype="int32")


def letter_counts(text: Column) -> Column:
    """How often each of the letters a to z and the digits stands in a text, in either case, and how many other characters there are."""
    low = F.lower(text)
    n = lambda c: F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))
    known = F.array(*[n(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"])
    return F.concat(known, F.array(F.length(low) - F.aggregate(known, F.lit(0), lambda x, y: x + y)))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(token_sort(a), token_sort(b))
