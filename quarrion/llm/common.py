"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of characters other than ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters of text that one slice of an Arrow batch holds at most (a longer text is a slice of its own).
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(spark: SparkSession) -> None:
    """Let Arrow batches hold 4 MB at most: texts differ in length, and each batch stands in the JVM and in Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode, if that is unset, one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarrion.scratch", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quarrion-")
        spark.conf.set("quarrion.scratch", where)
    return where


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what
    stands before, and every later reader sees the very same rows.
    """
    spark = df.sparkSession
    lean(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about SLICE_CHARS bytes of the text column."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = total = 0
        for i, length in enumerate(lengths):
            if total and total + length > SLICE_CHARS:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += length
        yield batch.slice(start)


def pack_bytes(data: bytes, _c=zstandard.ZstdCompressor(level=1)) -> bytes:
    """Bytes as they go through a shuffle: of texts, about 0.4 of their size."""
    return _c.compress(data)


def unpack_bytes(data, _d=zstandard.ZstdDecompressor()) -> bytes:
    return _d.decompress(data)


def squeeze(text: str) -> bytes:
    return pack_bytes(text.encode())


def expand(data: bytes | None) -> str:
    return unpack_bytes(data).decode() if data else ""
