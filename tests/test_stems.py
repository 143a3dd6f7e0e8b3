"""Stems of arrays of words, in bounded memory."""

import pyarrow as pa
from pyspark.sql import functions as F

from quarrion.functions.stem import stem
from quarrion.operators import search


def test_stems_of_arrays(spark):
    rows = [["running", "relational", None, "running"], [], None, ["x1", "ponies", ""], ["hopping"] * 50]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, t array<string>").coalesce(1)
    got = [r.t for r in df.select("k", search.all_stemmed("t").alias("t")).orderBy("k").collect()]
    assert got == [None if ws is None else [w if w is None else stem(w) for w in ws] for ws in rows]
    assert [r.t for r in df.select(F.explode("t").alias("t")).select(search.stemmed("t").alias("t")).collect()] == [w if w is None else stem(w) for ws in rows for w in ws or []]


def test_memory_of_stems_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(search, "REMEMBERED", 100)
    memory = {}
    for k in range(50):
        words = [f"running{chr(97 + k % 26)}{chr(97 + i)}s" for i in range(26)] + [f"w{k}"]
        assert search._stems(pa.array(words), memory).to_pylist() == [stem(w) for w in words]
        assert len(memory) <= 100
    search.search(spark.createDataFrame([(1, "these words")], "id int, t string"), "word", "id", ["t"], stems=True)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"  # a batch has no 10,000 long texts
