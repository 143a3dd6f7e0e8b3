"""Articles, bindings, lookups and expectations on odd inputs."""


from quarrion.operators import articles, bindings, expectations, lookups, tables


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page int, html string")


def test_articles(spark):
    html = """<div class="Card outer">Snapdragon 8 Gen 2, sm8550; 4 nm; Adreno 740; QC 5; of 2022; up to 3.2 GHz 8-core <br>
    <section class=item>Snapdragon 7, fast charge, 12 MP ARMv9<p class="kryo x">6 cores</p></section></div><div class=other>Snapdragon 6</div><article class=tile></article>"""
    got = articles.phone_records(pages(spark, html, None, "<p>none"), "page", articles.QUALCOMM, "Qualcomm").orderBy("place").collect()
    outer, inner = got
    # The outer article has the section of the inner one in it.
    assert (outer.name, outer.model, outer.id) == ("Snapdragon 8 Gen 2", "SM8550", "snapdragon_8_gen_2_sm8550") and outer.page == 0
    assert {k: outer.fields.get(k) for k in ("process_nm", "gpu", "charging", "year", "cores", "clock_max", "architecture")} == {"process_nm": "4", "gpu": "Adreno 740", "charging": "QC 5", "year": "2022", "cores": "6", "clock_max": None, "architecture": "ARMv9-A"}
    assert inner.model == inner.name == "Snapdragon 7" and inner.fields["charging"].startswith("Snapdragon 7, fast charge") and inner.fields["camera_max"] == "12 MP"
    mtk = '<li class=chip>Helio G 999; MT6789; DL up to 2.5 Gbps; 5G modem; <strong>NPU</strong><b>x</b><span>the NPU, 3 TOPS</span><h3>CPU <i>y</i></h3><p>no</p> 8 cores</li>'
    r = articles.phone_records(pages(spark, mtk), "page", articles.MEDIATEK, "MediaTek").first()
    assert (r.name, r.model, r.fields["npu"], r.fields["ai_ops"], r.fields["cores"], r.fields["modem_dl"], r.fields["modem"]) == ("Helio G 999", "MT6789", "the NPU, 3 TOPS", "3 TOPS", "8", "2500", "5G modem")
    typed = articles.typed_fields(articles.first_records(articles.phone_records(pages(spark, mtk, mtk), "page", articles.MEDIATEK, "MediaTek"), "page"), {"cores": "int", "npu": "int"}).collect()
    assert [(r.cores, r.npu) for r in typed] == [(8, None)]


def test_processor_tables(spark):
    rows = [("Year", "2019"), ("Cores", "—"), ("Model", "AMD EPYC 7742"), ("Cores / Threads", "64 / 128"), ("Product", "AMD EPYC 7763"), ("L3 cache", "256 MB")]
    html = "<table>" + "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in rows) + "</table><table><tr><td>Cores</td><td>4</td></tr></table><div class=processor>AMD Ryzen 9 7950X 16 cores / 32</div>"
    p = pages(spark, html)
    got = {r.name: (r.vendor, r.model, r.fields) for r in articles.processor_records(p, tables.page_tables(p, "page"), "page").collect()}
    assert set(got) == {"AMD EPYC 7763", "AMD Ryzen 9 7950"} and got["AMD EPYC 7763"][:2] == ("AMD", "7763")
    assert got["AMD EPYC 7763"][2] == {"threads": "64", "l3_cache": "256 MB"} and got["AMD Ryzen 9 7950"][2]["cores"] == "16"


def _bindings(spark, rows):
    schema = "vendor string, kind string, pos int, binding map<string, struct<type: string, value: string>>"
    return spark.createDataFrame([(v, k, i, {n: ("literal", x) for n, x in b.items()}) for i, (v, k, b) in enumerate(rows)], schema)


def test_facts_and_versions(spark, tmp_path):
    node = lambda label, nm: ("V", "process_map", {"itemLabel": label, "processNode": nm})
    rows = [node("Chip (SM8550)", "5"), node("SM8550 again", "4"), node("Plain Name ", " 7"), node("x", "7.5"), node("", "3"), ("V", "process_map", {"itemLabel": "no value"}), ("V", "architecture", {"architectureLabel": ""}), ("V", "architecture", {"architectureLabel": "first"}), ("V", "architecture", {"architectureLabel": "second"}), ("W", "gpu_map", {"itemLabel": "a", "gpuLabel": "G"})]
    b = _bindings(spark, rows)
    want = {("V", "process_map", "sm8550", "4"), ("V", "process_map", "plain name", "7"), ("V", "architecture", "", "first"), ("W", "gpu_map", "a", "G")}
    assert {tuple(r) for r in bindings.facts(b).collect()} == want
    path = f"file://{tmp_path}/layer"
    base = spark.createDataFrame([("V", "process_map", "sm8550", "6"), ("V", "architecture", "", "old")], "vendor string, kind string, key string, value string")
    known = lambda **kw: {tuple(r) for r in bindings.knowledge(spark, base, path, **kw).collect()}
    assert known() == {tuple(r) for r in base.collect()}
    assert {tuple(r) for r in bindings.refresh(spark, path, b, dry_run=True).collect()} == want and bindings.versions(spark, path) == []
    bindings.refresh(spark, path, b.where("vendor = 'W'"))
    bindings.refresh(spark, path, b.where("vendor = 'X'"))
    bindings.refresh(spark, path, b)
    assert bindings.versions(spark, path) == [1, 2] and ("V", "architecture", "", "old") in known(version=1)
    assert known() == {("V", "process_map", "sm8550", "6"), ("V", "process_map", "plain name", "7"), ("V", "architecture", "", "first"), ("W", "gpu_map", "a", "G")}


def test_binding_records(spark):
    rows = [{"itemLabel": "A1", "item": "e/Q1", "cores": "x", "processNode": "16 nm class", "publicationDate": "1979", "maxFreq": "800"}, {"itemLabel": "Again", "item": "e/Q1"}, {"itemLabel": "List of things"}, {"itemLabel": "The A Family"}, {"item": "e/Q2"}, {"itemLabel": "☃"}, {"itemLabel": "No item", "arch": "e/Q627843"}, {"itemLabel": "No item"}]
    got = [(r.id, r.cores, r.architecture, r.process, r.year, r.max_freq) for r in bindings.records(_bindings(spark, [("V", "x", b) for b in rows])).collect()]
    assert sorted(got) == [("a1", 8, "ARMv8.2-A", "16 nm", None, "800 MHz"), ("chip", 8, "ARMv8.2-A", None, None, None), ("no_item", 8, "ARMv8-A", None, None, None), ("no_item", 8, "ARMv8.2-A", None, None, None)]


def test_key_forms(spark):
    cells = spark.createDataFrame([(1, 0, i, a, b) for i, (a, b) in enumerate([("a", "b"), ("a", "x"), ("x", "b"), ("x", "y"), ("a", "b")])], "page int, table_no int, place int, first string, second string")
    info = lambda k: (k, f"N {k}", "", 2020, "5 nm", "", "G")
    catalogue = spark.createDataFrame([info(k) for k in ("a_b", "a", "b")], "key string, name string, model string, year int, process string, cpu string, gpu string")
    got = lookups.described(lookups.matched(cells, "page", catalogue)).collect()
    assert sorted((r.id, r.model, r.process_nm, r.architecture) for r in got) == [("n_a", "N a", 5, lookups.ARCHITECTURE), ("n_a_b", "N a_b", 5, lookups.ARCHITECTURE), ("n_b", "N b", 5, lookups.ARCHITECTURE)]


def test_expectations(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    frame = lambda *rows: spark.createDataFrame(list(rows), "source string, expected array<string>")
    assert expectations.current(spark, path).count() == 0
    ten = [f"f{k}" for k in range(10)]
    assert [(r.ratio, r.changed, r.added) for r in expectations.register(spark, path, frame(("a", ten), ("b", ["x", "x"]))).collect()] == [(0.0, False, [])] * 2
    got = {r.source: (r.added, r.removed, r.ratio, r.changed) for r in expectations.register(spark, path, frame(("a", ten[1:]), ("c", []))).collect()}
    assert got == {"a": ([], ["f0"], 0.1, False), "c": ([], [], 0.0, False)}
    assert {r.source: (r.added, r.changed) for r in expectations.register(spark, path, frame(("b", ["y"]), ("c", ["z"]))).collect()} == {"b": (["y"], True), "c": (["z"], True)}
    assert {r.source: r.expected for r in expectations.current(spark, path).collect()} == {"a": sorted(ten[1:]), "b": ["y"], "c": ["z"]}
    assert {r.source for r in expectations.current(spark, path, 1).collect()} == {"a", "b"}
