"""Context-triggered piecewise hashing.

A rolling hash over seven bytes triggers the end of a piece where it meets the
block size; each piece gives one character, for the block size and for its
double. Fingerprints are compared by edit distance at block sizes that are
equal or one doubling apart.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import expand, materialise, slices, squeeze

WINDOW, LEAST_BLOCK, PIECES = 7, 3, 64
#: Likeness that two unrelated signatures have on average; it counts as 0.
CHANCE = 0.2
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_FACTOR = np.uint32(0x01000193)


def _rolling(data: np.ndarray) -> np.ndarray:
    """For each byte, a mixed hash of it and the six before."""
    x = data.astype(np.uint32) + np.uint32(1)
    h, k = x.copy(), _FACTOR
    for j in range(1, min(WINDOW, len(x))):
        h[j:] += x[:-j] * k
        k = np.uint32(int(k) * int(_FACTOR) & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _pieces(data: bytes, ends: np.ndarray) -> str:
    """One letter for each piece; the last takes all that is left, so the whole text counts."""
    cuts = [0, *(ends[: PIECES - 1] + 1).tolist(), len(data)]
    return "".join([_LETTERS[zlib.crc32(data[a:b]) & 63] for a, b in zip(cuts, cuts[1:]) if b > a])


def fingerprint(text: str) -> str:
    """``block:signature:signature at twice the block``; of an empty text ``3::``."""
    data = text.encode()
    block = LEAST_BLOCK
    while block * PIECES < len(data):
        block *= 2
    if not data:
        return f"{block}::"
    h = _rolling(np.frombuffer(data, np.uint8))
    at = np.flatnonzero(h % np.uint32(block) == block - 1)
    twice = at[h[at] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_pieces(data, at)}:{_pieces(data, twice)}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints: edit distance over the longer signature, what chance gives taken off."""
    x, y = F.split(a, ":"), F.split(b, ":")
    p, q = x[0].cast("long"), y[0].cast("long")

    def near(s: Column, t: Column) -> Column:
        longest = F.greatest(F.length(s), F.length(t))
        share = 1 - F.levenshtein(s, t) / F.greatest(longest, F.lit(1))
        return F.greatest(F.lit(0.0), (share - F.lit(CHANCE)) / F.lit(1 - CHANCE))

    return (
        F.when(a == b, F.lit(1.0))
        .when(p == q, F.greatest(near(x[1], y[1]), near(x[2], y[2])))
        .when(p == 2 * q, near(x[1], y[2]))
        .when(2 * p == q, near(x[2], y[1]))
        .otherwise(F.lit(0.0))
    )


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the text that follows."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likeness to the edited text and to the next one's.

    The next document is the one with the next smaller id, after the last the
    first; rows of one id are in order of a hash of their texts. A null text counts as empty. A table of one row is its own
    next; an empty table gives none; other columns are not read.

    The packed texts cross one range exchange on the id. Each partition runs
    through its rows in order; only its first and last row need another
    partition, and these, two for each partition, are matched by a join.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            data = pa.array([squeeze(t or "") for t in part.column(text_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(id_col), data], [id_col, "data"])

    schema = f"`{id_col}` {key}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, place int, data binary"

    def row(i, text: str, mark: str, following: str, after: str) -> tuple:
        other = edited(text, following)
        return (i, len(text), hashlib.sha256(other.encode()).hexdigest(), mark, fingerprint(other), after, None, None)

    def frame(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary()]
        names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "place", "data"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, kind = None, [], None
        for batch in batches:
            kind = batch.column(id_col).type
            for i, data in zip(batch.column(id_col).to_pylist(), batch.column("data")):
                data = data.as_py()
                text = expand(data)
                mark = fingerprint(text)
                if held is None:
                    out.append((i, None, None, mark, None, None, 0, data))
                else:
                    out.append(row(*held[:3], text, mark))
                held = (i, text, mark, data)
                if len(out) >= 500:
                    yield frame(out, kind)
                    out = []
        if held is not None:
            out.append((held[0], None, None, held[2], None, None, 1, held[3]))
            yield frame(out, kind)

    packed = docs.select(id_col, text_col).mapInArrow(pack, f"`{id_col}` {key}, data binary")
    # The exchange samples its keys on the driver: they are narrow.
    order = [F.col(id_col).desc_nulls_last(), F.xxhash64("data")]
    through = packed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
    through = materialise(through.withColumn("part", F.spark_partition_id()), "pieces")

    # Partitions in the order of the range exchange; empty ones have no rows.
    parts = sorted(r[0] for r in through.where("place = 0").select("part").collect())
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    tails = through.where("place = 1").select("part", id_col, "fingerprint", "data").join(F.broadcast(after), "part")
    heads = through.where("place = 0").select(F.col("part").alias("next_part"), F.col("fingerprint").alias("_mark"), F.col("data").alias("_data"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(id_col).type
            rows = [row(i, expand(d), m, expand(e), n) for i, m, d, n, e in zip(*(batch.column(c).to_pylist() for c in (id_col, "fingerprint", "data", "_mark", "_data")))]
            if rows:
                yield frame(rows, kind)

    met = tails.join(heads, "next_part").select(id_col, "fingerprint", "data", "_mark", "_data").mapInArrow(meet, schema)
    whole = through.where("place is null").drop("part").unionByName(met)
    return whole.select(
        id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
