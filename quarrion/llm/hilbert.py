"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to a few bits, the cell's index on the Hilbert
curve orders the rows, and the order is cut into runs of equal row counts, so
that a shard's files cover a compact region of all dimensions at once and
min/max statistics prune them on any.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with integer coordinates below 2**bits.

    axes has one row for each dimension. The coordinates are turned into the
    curve's transposed index by undoing, from the high bit down, the exchange
    or inversion that each sub-cube applies, then Gray-coded and interleaved.
    """
    x = axes.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        carry ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= carry
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _curve(bits: int):
    @F.pandas_udf("long")
    def curve(point: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(point.to_numpy().T, bits))

    return curve


def category(c: Column, bits: int) -> Column:
    """Cell of a categorical value; null is cell 0."""
    return F.when(c.isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << bits))).cast("int")


def magnitude(c: Column, bits: int) -> Column:
    """Cell of a count or size on a logarithmic scale of half powers of two; null counts as 0."""
    return F.least(F.floor(2 * F.log2(F.coalesce(c, F.lit(0)) + F.lit(1))), F.lit((1 << bits) - 1)).cast("int")


def linear(c: Column, low, high, bits: int) -> Column:
    """Cell of a number between its least and largest value; null is cell 0."""
    width = max(1, (high or 0) - (low or 0))
    return F.coalesce(F.least(F.floor((c - F.lit(low or 0)) * F.lit((1 << bits) / (width + 1))), F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def hilbert_order(rows: DataFrame, cells: list[str], ties: list[str], bits: int) -> DataFrame:
    """Adds ``curve``, the index of the row's cell, and ``rank``, the row's place from 0 on in the order of (curve, ties).

    The sort is one range exchange of what is given, with the ties in its key,
    so that a cell that holds a third of the rows is spread as well; places
    come from the number of rows in each partition, which is all that the
    driver sees.
    """
    kept = [c for c in rows.columns if c not in cells]
    keyed = rows.withColumn("curve", _curve(bits)(F.struct(*cells))).select(*kept, "curve")
    keyed = materialise(keyed, "curve")
    key = ["curve", *ties]
    dealt = keyed.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "curve-order")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in dealt.groupBy(part.alias("p")).count().collect())
    ends = np.cumsum([n for _, n in counts])
    offsets = [(int(p), int(e - n)) for (p, n), e in zip(counts, ends)]
    first = rows.sparkSession.createDataFrame(offsets, "_p long, _first long")
    return dealt.join(F.broadcast(first), part == F.col("_p")).withColumn("rank", F.col("_first") + place).drop("_p", "_first", "_at")


def cut_runs(ordered: DataFrame, shards: int, n: int) -> DataFrame:
    """Adds ``shard`` and ``slot``: of n ranked rows, runs whose counts differ by one at most."""
    ordered = ordered.withColumn("shard", F.expr(f"cast((rank * {shards}) div {max(n, 1)} as int)"))
    return ordered.withColumn("slot", F.expr(f"rank - (cast(shard as long) * {n} + {shards - 1}) div {shards}"))


def shard_documents(docs: DataFrame, shards: int = 40, bits: int = 6, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Put every row into a shard: id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null), curve.

    Dimensions: the categorical columns, the size, the id. A null text has size
    16 and CRC 0 like an empty one; null categories and ids share cell 0. Ties
    are ordered by id, CRC and size; rows equal in all of these may change
    places. An empty table gives no rows; further columns are not read. Only
    the narrow row of keys is shuffled, never the text.
    """
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    n = docs.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + F.lit(16)).cast("long")
    dims = [category(F.col(c), bits) for c in categories] + [magnitude(size, bits), linear(F.col(id_col), low, high, bits)]
    cells = [f"_cell{i}" for i in range(len(dims))]
    rows = docs.select(id_col, size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[d.alias(c) for d, c in zip(dims, cells)])
    ordered = hilbert_order(rows, cells, [id_col, "text_crc32", "size"], bits)
    return cut_runs(ordered, shards, n).select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents' rows into one folder for each shard, in the order of the slots; ids must be unique."""
    rows = docs.join(placed.select(id_col, "shard", "slot"), id_col)
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
