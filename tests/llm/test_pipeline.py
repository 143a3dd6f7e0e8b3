"""The corpus pipeline: every stage on its own input, and the SQL-free queries' columns."""

import zlib

import corpus_pipeline

from quarrion.llm import bpe, queries, secret_ledger, simhash
from quarrion.llm.common import materialise, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    bench = [t for (t,) in table(spark, sf, "benchmark").select("text").collect()]
    labels = dict(tuple(r) for r in table(spark, sf, "labels").select("doc_id", "toxic").collect())
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, sf), name)
        a, b = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()}
        assert set(b) <= set(a)
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        gone = set(a) - set(b)
        if name == "toxicity":
            trained = {i for i in gone if i in labels and zlib.crc32(str(i).encode()) % 3 != 1}
            assert all(labels[i] for i in trained) and len(gone) < 0.3 * len(a)
        elif name == "simhash_near_dedup":
            own = {i: simhash.sketch(r.text) for i, r in a.items()}
            masks, most = [int(m) for m in simhash.masks(6)], simhash.most_apart(0.8)
            apart = lambda i, j: sum((x ^ y).bit_count() for x, y in zip(own[i][1], own[j][1]))
            near = lambda i, j: apart(i, j) <= most and any((own[i][0] ^ own[j][0]) & m == 0 for m in masks)
            assert gone and not any(near(i, j) for i in b for j in b if i < j)
            assert all(any(near(i, j) for j in a if j != i) for i in gone)
        elif name == "benchmark_decontamination":
            flat = {i: " ".join(r.text.split()) for i, r in a.items()}
            assert {i for i, t in flat.items() if any(" ".join(x.split()) in t for x in bench)} <= gone
        elif name == "secret_scan":
            assert not gone
            for i, r in b.items():
                assert r.text == secret_ledger.cover(a[i].text, [s[1:] for s in secret_ledger.scan(a[i].text)[1]], "[secret]") and r.n_chars == len(r.text)
        else:
            assert not gone and all(r.n_tokens == len(r.ids) == len(bpe.bpe(bpe.default_vocabulary()).encode(a[i].text)) for i, r in b.items())


def test_stages_on_nulls_and_empty_tables(spark, sf):
    schema = table(spark, sf, "documents").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text", None, None, 9), (3, "some text", "en", None, 9)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).collect()


def test_contract_columns(spark, sf):
    want = {
        1: "doc_id size text_crc32 law shard slot grown_shard", 2: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", 3: "doc_id n_tokens ids_sha256 decoded_sha256",
        4: "doc_id held_out score predicted", 5: "doc_id held_out lang_pred score", 6: "doc_id n_words n_removed kept_sha256", 7: "doc_id fingerprint component_id", 8: "doc_id item_id",
        9: "page_id host path rule verdict", 10: "doc_id n_assign n_access n_hex base_sha256 spans",
    }
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    for name, query in queries.QUERIES.items():
        k = int(name[2:].split("_")[0])
        out = query(spark, sf)
        assert set(want[k].split()) <= set(out.columns)
        n = out.count()
        assert n == (250 if k == 9 else 200) or k == 8 or n == table(spark, sf, "pages" if k == 9 else "documents").count()
