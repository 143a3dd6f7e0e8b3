"""Full-text search: postings, BM25, AND search, substring search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.stem import stem
from ..scratch import small_batches

#: Words whose stems a task remembers.
REMEMBERED = 200_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def fold(text: Column) -> Column:
    """Without the accents of Latin letters."""
    # Accented letters and what they are folded to, place by place.
    return F.translate(text, "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy")


def _stems(words: pa.Array, memory: dict[str, str]) -> pa.Array:
    """Stems of the words, each distinct one once; the memory is emptied before it grows beyond REMEMBERED words."""
    code = words.dictionary_encode()
    if len(memory) + len(code.dictionary) > REMEMBERED:
        memory.clear()
    found = [memory.get(w) or memory.setdefault(w, stem(w)) for w in code.dictionary.to_pylist()]
    return pa.array(found, pa.string()).take(code.indices)


@F.arrow_udf(StringType())
def stemmed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    memory: dict[str, str] = {}
    for words in batches:
        yield _stems(words, memory)


def postings(df: DataFrame, id_col: str, columns: list[str], stems: bool = False) -> DataFrame:
    """(term, id, tf, doc_len): what the texts of the columns are made of."""
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    if stems:
        text = fold(F.lower(text))
    docs = df.select(F.col(id_col).alias("id"), tokens(text).alias("t"))
    rows = docs.select("id", F.size("t").alias("doc_len"), F.explode("t").alias("term"))
    if stems:
        small_batches(df.sparkSession)
        rows = rows.withColumn("term", stemmed("term"))
    return rows.groupBy("term", "id", "doc_len").agg(F.count("*").alias("tf"))


def bm25(post: DataFrame, docs: int, mean_len: float, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of rows that have every term; only the terms' postings are read."""
    terms = sorted(set(terms))
    hit = post.where(F.col("term").isin(terms))
    df = hit.groupBy("term").agg(F.count("*").alias("n"))  # as many rows as terms
    idf = F.greatest(F.log((F.lit(docs) - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.lit(mean_len)))
    scored = hit.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("_terms"))
    return scored.where(F.col("_terms") == len(terms)).drop("_terms")


@F.arrow_udf(ArrayType(StringType()))
def all_stemmed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    memory: dict[str, str] = {}
    for rows in batches:
        many = rows.value_lengths()
        ends = np.cumsum(np.r_[0, many.fill_null(0).to_numpy()]).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), _stems(rows.flatten(), memory), mask=many.is_null())


def query_parts(query: str) -> list[tuple[str, list[str]]]:
    """What a query asks for: words, phrases and beginnings, each with its words."""
    pieces = query.split('"')
    out = [("phrase", _plain(p)) for p in pieces[1::2]]
    for w in (w for part in pieces[::2] for w in part.split()):
        out.append(("prefix", [w[:-1].lower()]) if w.endswith("*") and len(w) > 1 else ("phrase", _plain(w)))
    found = []
    for kind, words in out:
        if words and (kind, words) not in found:
            found.append((kind, words))
    return found


def _met(t: Column, kind: str, words: list[str]) -> Column:
    """How often a part of a query stands in an array of tokens."""
    if kind == "prefix":
        return F.size(F.filter(t, lambda x: x.startswith(words[0])))
    if len(words) == 1:
        return F.size(F.filter(t, lambda x: x == words[0]))
    here = lambda x, i: reduce(lambda a, b: a & b, [F.coalesce(F.get(t, i + k) == w, F.lit(False)) for k, w in enumerate(words)])
    return F.size(F.filter(t, here))


def search(df: DataFrame, query: str, id_col: str, columns: list[str], limit: int | None = None, stems: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) by rank: all parts of the query must be there; a word with ``*`` is a beginning, a quoted part a phrase.

    Counts, lengths and frequencies are those of all rows. Each row is counted
    where it is, and only the counts of the query's parts go on: one pass for
    the statistics, one for the scores, no exchange of postings. A blank query gives nothing.
    Ties are in order of id. A query with an odd quote is no query of this
    syntax: its words are sought as substrings, with a score of 0.
    """
    if query.count('"') % 2:
        hits = search_like(df, query.replace('"', " "), columns).select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).orderBy("id")
        return hits if limit is None else hits.limit(limit)
    parts = query_parts(query)
    if not parts:
        return df.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    t = tokens(fold(F.lower(text)) if stems else text)
    if stems:
        small_batches(df.sparkSession)
        t, parts = all_stemmed(t), [(kind, words if kind == "prefix" else [stem(w) for w in words]) for kind, words in parts]
    # Through an array of one, so that no filter pulls the tokens into what looks at them one by one.
    rows = df.select(F.col(id_col).alias("id"), F.explode(F.array(t)).alias("_t"))
    rows = rows.select("id", F.size("_t").alias("_len"), *[_met(F.col("_t"), *p).alias(f"_n{k}") for k, p in enumerate(parts)])
    n, mean, *df_of = rows.agg(F.count("*"), F.avg("_len"), *[F.count(F.when(F.col(f"_n{k}") > 0, 1)) for k in range(len(parts))]).first()
    return ranked(rows, n, mean or 1.0, df_of, limit, k1, b)


def ranked(rows: DataFrame, docs: int, mean_len: float, df_of: list[int], limit: int | None, k1: float, b: float) -> DataFrame:
    """(id, score) by rank of rows (id, _len, _n0, _n1, ...) that have every part of a query."""

    def part(k: int) -> Column:
        idf = max(log((docs - df_of[k] + 0.5) / (df_of[k] + 0.5)), 1e-6)
        return F.lit(idf) * F.col(f"_n{k}") * (k1 + 1) / (F.col(f"_n{k}") + k1 * (1 - b + b * F.col("_len") / F.lit(mean_len)))

    out = rows.where(reduce(lambda x, y: x & y, [F.col(f"_n{k}") > 0 for k in range(len(df_of))]))
    out = out.select("id", reduce(lambda x, y: x + y, [part(k) for k in range(len(df_of))]).alias("score")).orderBy(F.col("score").desc(), "id")
    return out if limit is None else out.limit(limit)


def _plain(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def search_like(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows in which every word of the query stands in one of the columns, in either case."""
    words = query.split()
    if not words:
        return df.limit(0)
    each = [reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(w.lower()), F.lit(False)) for c in columns]) for w in words]
    return df.where(reduce(lambda a, b: a & b, each))


def search_serialised(df: DataFrame, query: str) -> DataFrame:
    """Rows whose JSON text, names of fields included, contains the query, in either case."""
    return df.where(F.lower(F.to_json(F.struct("*"))).contains(query.lower()))


def inverted_index(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(token, id): words between blanks of texts and numbers, each once a row."""
    return df.select(F.explode(_blank_tokens(columns)).alias("token"), F.col(id_col).alias("id"))


def _blank_tokens(columns: list[str]) -> Column:
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def tokens_and(df: DataFrame, id_col: str, columns: list[str], query: str) -> DataFrame:
    """(id) of rows that have every token of the query, exactly, without an index: a narrow step."""
    wanted = sorted({w.lower() for w in query.split()})
    return df.where(F.size(F.array_intersect(_blank_tokens(columns), F.array(*[F.lit(w) for w in wanted]).cast("array<string>"))) == len(wanted)).select(F.col(id_col).alias("id"))


def token_and(index: DataFrame, query: str) -> DataFrame:
    """(id) of rows that have every token of the query, exactly."""
    wanted = sorted({w.lower() for w in query.split()})
    if not wanted:
        return index.select("id").distinct()
    hit = index.where(F.col("token").isin(wanted))
    return hit.groupBy("id").agg(F.countDistinct("token").alias("n")).where(F.col("n") == len(wanted)).select("id")
