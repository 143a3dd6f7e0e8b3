"""Stored tables and index, merges into vendors' partitions."""

import pytest
from pyspark.sql import functions as F

from quarrion.operators import resolve, search
from quarrion.sources import sinks, store

DOCS = [("a", "The red Chip, the blue chip"), ("b", "red chips and greens"), ("c", None), ("d", "blue the chip red"), ("e", "the the the"), ("f", "chip the blue")]
QUERIES = ["the", "chip the", '"the blue"', "re*", 'the "blue chip" c*', "nosuch the", "", '"the the"', '"odd']


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


def same(spark, index, rows, stems=False, queries=('the "blue chip" c*', "the")):
    for q in queries:
        got = [(r.id, round(r.score, 9)) for r in index.search(q).collect()]
        want = [(r.id, round(r.score, 9)) for r in search.search(docs(spark, rows), q, "id", ["text"], stems=stems).collect()]
        assert got == ([] if q == '"odd' else want), q


@pytest.mark.parametrize("stems", [False, True])
def test_index_in_batches_is_the_search(spark, tmp_path, stems):
    index = store.TextIndex(spark, f"file://{tmp_path}/i", columns=("text",), buckets=4, stems=stems).create()
    assert index.search("the").collect() == [] and index.state() == (0, 1, 0, 0)
    old = [("a", "the old words of a"), ("b", DOCS[1][1]), ("x", "red chip the blue"), ("c", "no longer null")]
    index.merge(docs(spark, old))
    same(spark, index, old, stems)
    index.merge(docs(spark, [d for d in DOCS if d[0] != "b"]), docs(spark, [("x", ""), ("nobody", "")]))
    same(spark, index, DOCS, stems, QUERIES)
    assert index.state()[2] == len(DOCS) and sorted(r.id for r in index.having_all(["THE", "red"]).collect()) == ["a", "d"]
    assert {r.id for r in index.having_all([]).collect()} == {d[0] for d in DOCS}
    # Another session finds what is there; a batch that was not finished counts for nothing.
    again = store.TextIndex(spark, f"file://{tmp_path}/i", columns=("text",), buckets=4, stems=stems)
    for part in again.PARTS:
        spark.sql(f"DROP TABLE {again._name(part)}")
    again.create()
    rows = again._tokens(docs(spark, [("a", "half done")]))
    again._insert("documents", 3, rows.select("id", F.size("t").alias("doc_len")))
    same(spark, again, DOCS, stems)
    again.merge(None, docs(spark, [("e", "")]))
    same(spark, again, [d for d in DOCS if d[0] != "e"], stems)
    again.rebuild(docs(spark, DOCS))
    same(spark, again, DOCS, stems)
    assert len(list((tmp_path / "i" / "postings").glob("batch=*"))) == 1
    again.drop()
    again.drop()
    assert not (tmp_path / "i" / "postings").exists()


def test_searches_read_their_buckets(spark, tmp_path):
    index = store.TextIndex(spark, f"file://{tmp_path}/i", columns=("text",), buckets=16).create()
    index.merge(docs(spark, DOCS))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else files are pruned as well, but the plan doesn't say so
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 16" in plan(index.postings(F.col("term") == "the"))
    assert "SelectedBucketsCount: 2 out of 16" in plan(index.postings(F.col("term").isin("the", "red")))
    assert "batch" in plan(index.having_all(["the"])).split("PartitionFilters")[1].split("]")[0]
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_records_table(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    df = spark.createDataFrame([("a", "x", 2020, "V"), ("b", "y", None, "W")], "id string, gpu string, year int, vendor string")
    name = store.create_records(spark, path, df.schema)
    assert store.create_records(spark, path, df.schema) == name and spark.table(name).count() == 0
    sinks.write_vendors(df.withColumn("name", F.col("id")), path)
    spark.sql(f"DROP TABLE {name}")
    assert spark.table(store.create_records(spark, path, df.schema)).where("vendor = 'V'").first().id == "a"
    store.drop_records(spark, path)
    store.drop_records(spark, path)
    assert not (tmp_path / "r").exists()
    with pytest.raises(PermissionError):
        store.create_records(spark, "file:///docs/x", df.schema)


SCHEMA = "id string, name string, vendor string, model string, cores int, gpu string, tags array<string>, completeness double, uuid string, _pos int"


def test_merge_into(spark):
    old = [
        ("one", "Old One", "V", "SM1000", None, "", [], 0.9, None, 1), ("two", "Old Two", "V", "SM2000", 2, "G", ["t"], 0.9, "u2", 2), ("three_sm2000", "Else", "V", "SM3000", 4, None, None, 0.9, "u3", 3),
        ("w", "Other maker", "W", "SM1000", 1, None, None, 0.9, "uw", 4), ("gone", "To be replaced", "V", "XX1", 1, "kept?", None, 0.9, "ug", 5), ("four", "Four", "V", "SM4000", None, None, None, 0.9, "u4", 6), ("five", "Five", "V", "SM5000", None, None, None, 0.9, "u5", 7),
    ]
    new = [
        ("n1", "First", "V", " sm1000", 8, None, ["a"], None, None, 1), ("n2", "One", "V", "SM1000", 9, "G1", ["b"], None, None, 2),  # one record: the last name, the first content
        ("n3", "Three", "V", "sm2000", 7, "H", None, None, None, 3),  # wants the id of another row
        ("gone", "Quite new", "V", "ZZ9", 3, None, None, None, None, 4),  # added in place of a row of its id
        ("n5", "Lone", "X", "SM1000", 5, None, None, None, None, 5),  # another vendor: no match
        ("n6", "Same", "V", "SM4000", 1, None, None, None, None, 6), ("n7", "Same", "V", "SM5000", 1, None, None, None, None, 7),
    ]
    out = {r.id: r for r in resolve.merge_into(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)).collect()}
    assert {k: r["_merge"] for k, r in out.items()} == {"one_sm1000": "renamed", "two": "updated", "three_sm2000": "kept", "w": "kept", "gone": "added", "n5": "added", "same_sm4000": "renamed", "same_sm5000": "renamed"}
    one, two = out["one_sm1000"], out["two"]
    assert (one.name, one.model, one.cores, one.gpu, one.tags) == ("One", "SM1000", 8, "G1", ["a"])
    assert (two.name, two.model, two.cores, two.gpu, two.tags, two.uuid) == ("Three", "sm2000", 2, "G", ["t"], "u2")
    assert out["gone"].gpu is None and out["gone"].uuid and one.uuid == out["n5"].uuid.__class__(one.uuid) and out["same_sm4000"].uuid != "u4"
    assert len({r.uuid for r in out.values()}) == len(out)


def test_only_one_row_gets_an_id(spark):
    old = [(k, k, "V", m, 1, None, None, 0.9, None, 1) for k, m in (("b", "SM1000"), ("a", "SM2000"))]
    new = [("n1", "The Same SM1000 SM2000", "V", "SM1000", 1, None, None, None, None, 1), ("n2", "The Same SM1000 SM2000", "V", "SM2000", 1, None, None, None, None, 2)]
    out = {r.id: r["_merge"] for r in resolve.merge_into(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)).collect()}
    assert out == {"same_sm1000_sm2000": "renamed", "b": "updated"}


def test_merge_vendors(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    cols = "id string, name string, vendor string, model string, year int, completeness double"
    first = spark.createDataFrame([("a", "Alpha", "V", "SM1000", 2021, 0.9), ("p", "Poor", "V", "SM9000", None, 0.1), ("w", "Whole", "W", "SM1000", 2020, 0.1)], cols)
    assert sinks.merge_vendors(spark, path, first) == {"added": 3, "updated": 0, "renamed": 0, "pruned": 0}
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "vendor=W").iterdir()}
    again = spark.createDataFrame([("x", "Alpha", "V", "sm1000", None, 0.5), ("y", "Beta", "V", "SM2000", 2019, 0.5)], cols)
    assert sinks.merge_vendors(spark, path, again) == {"added": 1, "updated": 0, "renamed": 1, "pruned": 1}
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["alpha_sm1000", "w", "y"]
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "vendor=W").iterdir()} == before  # other vendors' files are not touched


def test_match_by_id_and_scope(spark):
    new = spark.createDataFrame([("a", None, "V", "SM1000"), ("n", "unlike all", "V", "SM1000"), ("z", "zz", "X", "SM1000")], "id string, name string, vendor string, model string")
    old = spark.createDataFrame([("a", "any", "W", None), ("b", "some", "W", "SM1000"), ("c", "none", "V", "SM1000")], "id string, name string, vendor string, model string")
    got = lambda **kw: {r.id: (r.match_id, r.strategy) for r in resolve.match(new, old, **kw).collect()}
    assert got() == {"a": ("b", "exact_model"), "n": ("b", "exact_model"), "z": ("b", "exact_model")}
    assert got(by_id=True)["a"] == ("a", "id")
    assert got(within="vendor") == {"a": ("c", "exact_model"), "n": ("c", "exact_model"), "z": (None, "no_match")}
    aliases = spark.createDataFrame([("al 1", "Some Long Name"), ("al 2", "ny")], "model string, alias string")
    asked = spark.createDataFrame([("p", "q", "V", "AL 1"), ("r", "s", "V", "al 2!"), ("t", "u", "V", "al 3")], "id string, name string, vendor string, model string")
    assert {r.id: (r.match_id, r.strategy) for r in resolve.match(asked, old, aliases).collect()} == {"p": ("b", "alias"), "r": ("a", "alias"), "t": (None, "no_match")}


def test_postings_go_packed_to_tasks_by_their_words(spark, tmp_path, monkeypatch):
    """What is packed holds all postings, and a larger batch has more tasks than buckets."""
    monkeypatch.setattr(store, "SPREAD", 40)
    rows = [(f"d{k}", None if k == 3 else "" if k == 4 else f"the word{k % 7} the own{k}") for k in range(60)]
    index = store.TextIndex(spark, f"file://{tmp_path}/i", columns=("text",), buckets=2).create()
    got = store.inverted(index._tokens(docs(spark, rows)).coalesce(1), 6, 6)
    want = {}
    for d, text in rows:
        words = (text or "").split()
        for place, w in enumerate(words):
            want.setdefault((w, d, len(words)), []).append(place)
    assert sorted((r.term, r.id, r.doc_len, tuple(r.places)) for r in got.collect()) == sorted((*k, tuple(v)) for k, v in want.items())
    assert got.rdd.getNumPartitions() == 6
    index.merge(docs(spark, rows).repartition(12))
    assert len({f.name.split("-")[1] for f in (tmp_path / "i" / "postings").glob("*/*.parquet")}) > 2
    same(spark, index, rows, queries=("the word1", "the"))
