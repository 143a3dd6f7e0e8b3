"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its bytes; rows that
share an id are versions of one path. The ledger is a folder to which each run
adds the (blob, rule version) pairs that it has scanned, with their findings; a
run scans only pairs that the ledger lacks, each once however many paths share
the blob, and joins findings back to all paths.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import expand, materialise, shared_dir, slices, squeeze

RULE_VERSION = 1

#: The base kinds in the order of their names in a list of spans, with the least length of what counts.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a greedy run has 16 or more where it has any
#: What the method adds: private key blocks, signed web tokens, and long mixed strings of high entropy.
_ADDED = {
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "entropy": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}"),
}
ENTROPY_BITS = 4.5


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values())


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each (kind, start, end) in code points by start, then kind."""
    base = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    base += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [("hex", *m.span()) for m in _HEX.finditer(text)]
    more = [("pem", *m.span()) for m in _ADDED["pem"].finditer(text)] if "-----BEGIN" in text else []
    more += [("jwt", *m.span()) for m in _ADDED["jwt"].finditer(text)] if "eyJ" in text else []
    for m in _ADDED["entropy"].finditer(text):
        s = m[0]
        if entropy(s) >= ENTROPY_BITS and any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s) and not any(a < m.end() and m.start() < b for _, a, b in base + more):
            more.append(("entropy", *m.span()))
    order = {k: i for i, k in enumerate((*KINDS, *_ADDED))}
    by = lambda x: (x[1], order[x[0]])
    return sorted(base, key=by), sorted(base + more, key=by)


_LEDGER = "blob string, rule_version int, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(blob, id, data): every row's address; the packed text goes along once for each blob and slice of a task."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for part in slices(batches, text_col):
            seen, blobs, data = set(), [], []
            for text in part.column(text_col).to_pylist():
                blob = hashlib.sha256((text or "").encode()).hexdigest()
                blobs.append(blob)
                data.append(None if blob in seen else squeeze(text or ""))
                seen.add(blob)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(blobs, pa.string()), pa.array(data, pa.binary())], [id_col, "blob", "data"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, blob string, data binary")


def scan_blobs(blobs: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
    """Findings of distinct packed blobs (blob, data), as rows of a ledger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for blob, data in zip(batch.column("blob").to_pylist(), batch.column("data")):
                base, spans = scan(expand(data.as_py()))
                n = Counter(k for k, _, _ in base)
                rows.append((blob, rule_version, n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [c.split()[0] for c in _LEDGER.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return blobs.select("blob", "data").mapInArrow(run, _LEDGER)


def ledger_path(spark: SparkSession) -> str:
    """The folder of the ledger: the setting ``quarrion.ledger``, by which runs share what they have scanned, or a new one for this run."""
    return spark.conf.get("quarrion.ledger", None) or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, path: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """The ledger's rows of a rule version, one for each blob, though runs at the same time may have scanned it twice; none if there is no ledger yet."""
    try:
        rows = spark.read.schema(_LEDGER).parquet(f"{path}/run-*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)
    return rows.where(F.col("rule_version") == rule_version).dropDuplicates(["blob"])


def update_ledger(docs: DataFrame, path: str, rule_version: int = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan the blobs that the ledger lacks and add them as a run of their own; returns the new rows.

    The text crosses one exchange, packed, once for each blob and map slice; a
    blob that a third of the rows hold is one row after its partial
    aggregation.
    """
    spark = docs.sparkSession
    at = versions(docs, id_col, text_col)
    fresh = at.where(F.col("data").isNotNull()).select("blob", "data")
    fresh = fresh.join(read_ledger(spark, path, rule_version).select("blob"), "blob", "left_anti")
    run = f"{path}/run-{uuid.uuid4().hex}"
    scan_blobs(fresh.dropDuplicates(["blob"]), rule_version).write.option("compression", "zstd").parquet(run)
    return spark.read.schema(_LEDGER).parquet(run)


def _blob(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def scan_documents(docs: DataFrame, path: str, rule_version: int = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every row: id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text is the empty blob. Repeated rows and versions that share a blob
    each get its findings, whatever pairs the ledger holds twice; an empty table gives none; other columns are
    not read. The join back to paths is on narrow rows, which adaptive
    execution can split.
    """
    update_ledger(docs, path, rule_version, id_col, text_col)
    paths = docs.select(id_col, _blob(text_col).alias("blob"))
    return paths.join(read_ledger(docs.sparkSession, path, rule_version).drop("rule_version"), "blob").drop("blob")


def redact(docs: DataFrame, path: str, mask: str = "[secret]", rule_version: int = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span that the ledger has for their blobs replaced by the mask, overlapping ones by one mask.

    Blobs that the ledger lacks are scanned first. Rows without a span stay as
    they are, null texts too; repeated rows all stay; an empty table gives none.
    """
    update_ledger(docs, path, rule_version, id_col, text_col)
    blob, own = (n + "_" * (1 + max(map(len, docs.columns))) for n in ("blob", "spans"))  # names that no column has
    found = read_ledger(docs.sparkSession, path, rule_version).where("spans <> ''").select(F.col("blob").alias(blob), F.col("spans").alias(own))
    found = materialise(found, "secret-spans")
    fields, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = fields.index(text_col), []
            for text, spans in zip(batch.column(at), batch.column(len(fields))):
                text = text.as_py()
                if spans.is_valid:
                    text = cover(text, [tuple(map(int, s.split(":")[1:])) for s in spans.as_py().split(",")], mask)
                texts.append(text)
            plain = pa.RecordBatch.from_arrays(batch.columns[: len(fields)], fields)
            yield plain.set_column(at, plain.schema.field(at), pa.array(texts, plain.schema.field(at).type))

    return docs.join(found, _blob(text_col) == F.col(blob), "left").select(*(f"`{c}`" for c in fields), own).mapInArrow(run, schema)


def cover(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])
