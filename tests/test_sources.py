"""Sources, sinks, extraction and streams on small files."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from quarrion import cli
from quarrion.operators import devicetree, enrich, extract, tables
from quarrion.sources import catalog, sinks
from quarrion.streaming import batches, limits


@pytest.fixture()
def data(tmp_path):
    (tmp_path / "data").mkdir()
    a = [{"id": "a1", "name": "Alpha", "vendor": "A", "cores": 8, "socket": "S1", "aliases": ["x"], "provenance": {"cores": "web"}, "completeness": 0.5}, {"id": "a2", "name": "Beta", "vendor": "A", "cores": "8 cores", "year": 2020}]
    (tmp_path / "data/a.json").write_text(json.dumps(a))
    (tmp_path / "data/b.json").write_text(json.dumps([{"id": "b1", "name": "Gamma 5", "vendor": "B", "model": "SM8550", "cache": {"l1": "1 MB"}}]))
    (tmp_path / "data/overrides.json").write_text("{}")
    (tmp_path / "data/index.json").write_text(json.dumps([{"id": "no"}]))
    (tmp_path / "data/_notes.json").write_text(json.dumps([{"id": "no"}]))
    return tmp_path


def test_json(spark, data):
    df = catalog.read_json(spark, str(data / "data"))
    got = {r.id: r for r in df.collect()}
    assert set(got) == {"a1", "a2", "b1"}
    assert got["a1"].cores == 8 and got["a1"]._extra == {"socket": "S1"} and got["a1"].aliases == ["x"] and got["a1"].provenance == {"cores": "web"}
    assert got["a2"].cores is None and got["b1"].cache.l1 == "1 MB"
    index = {r._file: (r.vendor, r["count"], r.avg_completeness) for r in sinks.build_index(df).collect()}
    assert index == {"a.json": ("A", 2, 0.25), "b.json": ("B", 1, 0.0)}
    table = catalog.read_catalogue(spark, str(data / "data"), str(data / "table"))
    assert table.count() == 3 and catalog.by_id(table, "b1").count() == 1
    with pytest.raises(ValueError):
        catalog.read_catalogue(spark, "x", "y", "z")


def test_cache(spark):
    now, loads = [0.0], []
    scan = catalog.CachedScan(lambda: loads.append(1) or spark.range(3), 10, lambda: now[0])
    assert scan.get() is scan.get() and len(loads) == 1
    now[0] = 11
    scan.get()
    assert len(loads) == 2
    scan.clear()
    broken = lambda: spark.read.parquet("/nowhere/at/all")
    assert catalog.CachedScan(broken, fallback=lambda: spark.range(4)).get().count() == 4
    with pytest.raises(AnalysisException):
        catalog.CachedScan(broken).get()


def test_missing_table_is_built_and_other_failures_are_seen(spark, data, tmp_path):
    table = str(tmp_path / "t")
    assert catalog.read_catalogue(spark, str(data / "data"), table).count() == 3
    before = sorted(p.name for p in (tmp_path / "t").rglob("*.parquet"))
    for p in (tmp_path / "t").rglob("*.parquet"):
        p.write_bytes(b"no table")
    with pytest.raises((PySparkException, Py4JJavaError)):
        catalog.read_catalogue(spark, str(data / "data"), table).collect()
    assert sorted(p.name for p in (tmp_path / "t").rglob("*.parquet")) == before


def test_sinks(spark, data):
    df = catalog.read_json(spark, str(data / "data")).withColumn("_pos", F.col("_pos").cast("string")).drop("_file")
    path = str(data / "loaded")
    assert sinks.load(df.unionByName(df.limit(1)), path)["total"] == 4 and spark.read.parquet(path).count() == 3
    assert sinks.load(df, path)["skipped"] is True
    for fmt in ("json", "json.gz", "csv"):
        sinks.export(df, f"{data}/out-{fmt}", fmt)
    assert spark.read.json(f"{data}/out-json.gz").count() == 3
    with pytest.raises(ValueError):
        sinks.export(df, f"{data}/x", "xml")
    with pytest.raises(PermissionError):
        sinks.export(df, f"{data}/docs/x", "csv")
    assert 'vendor="A"} 2' in sinks.prometheus(sinks.vendor_metrics(df))


def test_cli(spark, data, capsys):
    run = lambda *a: (cli.main(["--data", str(data / "data"), *a], spark), capsys.readouterr().out)[1]
    assert "A" in run("list") and json.loads(run("show", "a1"))[0]["name"] == "Alpha"
    assert cli.main(["--data", str(data / "data"), "show", "zz"], spark) == 1
    capsys.readouterr()
    assert run("query", "--vendor", "a", "--format", "csv", "--fields", "id,name").splitlines() == ["id,name", "a1,Alpha", "a2,Beta"]
    assert "b1" in run("query", "--search", "gamma") and json.loads(run("stats"))[0]["total"] == 3
    assert "# Data quality" in run("quality-report")
    run("enrich", "--out", str(data / "enriched"))
    assert spark.read.parquet(str(data / "enriched")).where("id = 'b1'").first().year == 2023


HTML = """<h2>Chips</h2><table><tr><th>Model</th><th>GPU</th><th>Odd</th></tr><tr><td>SM1<td>Adreno &amp; co<td>x</tr><tr><td>SM2</td><td>—</td></tr></table>
<table><tr><th></th><th>One</th><th>Two</th></tr><tr><th>GPU</th><td>G1</td><td>G2</td></tr><tr><th>Memory</th><td>8 GB</td><td>n/a</td></tr></table>"""


def test_tables(spark):
    cells = extract.table_cells(spark.createDataFrame([(1, HTML), (2, None), (3, "<p>x")], "k int, html string"), "k")
    assert cells.where("table_no = 0").first().heading == "Chips"
    got = {(r.table_no, r.row_no): r.fields for r in extract.standard_records(cells.where("table_no = 0"), "k").collect()}
    assert got == {(0, 1): {"model": "SM1", "gpu": "Adreno & co"}, (0, 2): {"model": "SM2"}}
    found = tables.page_tables(spark.createDataFrame([(1, HTML), (2, None), (3, "<p>x")], "k int, html string"), "k")
    assert {r.table_no: r.turned for r in found.select("table_no", tables.is_turned(F.col("rows")).alias("turned")).collect()} == {0: False, 1: True}
    assert extract.key_value_records(cells.where("table_no = 1"), "k").first().fields["gpu"] == "G1"


def test_jsonld(spark):
    html = '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"name":"A","description":"Single-Core 1,234 multi-core: 5678"}},{"name":"B","singleCoreScore":"9"}]}</script><script type="application/ld+json">not json</script>'
    got = sorted(tuple(r)[2:] for r in extract.jsonld_records(extract.jsonld(spark.createDataFrame([(1, html)], "k int, html string"), "k"), "k").collect())
    assert got == [("A", 1234, 5678), ("B", 9, None)]


TREE = "arch/arm64/boot/dts/qcom/sm8550.dtsi arch/arm64/boot/dts/qcom/sm8550-mtp.dts arch/arm/boot/dts/broadcom/bcm2711.dtsi arch/arm64/boot/dts/broadcom/bcm2711-rpi-4-b.dts arch/arm64/boot/dts/nope/x.dts README".split()
DTS = "/ { cpus { cpu@0 { compatible = \"arm,cortex-a53\"; }; cpu@100 { compatible = \"arm,cortex-a78\"; }; cpu@0 { x; }; }; };"


def test_device_tree(spark):
    vendors = spark.createDataFrame([("qcom", "Qualcomm"), ("broadcom", "Broadcom")], "dir string, vendor string")
    tree = spark.createDataFrame(list(enumerate(TREE)), "pos int, path string")
    got = {r.model: (r.id, r.name, r.vendor) for r in devicetree.records(tree, vendors).collect()}
    # A .dtsi file leaves an i where the pattern takes it.
    assert got == {"SM8550I": ("sm8550i", "Snapdragon SM8550I", "Qualcomm"), "SM8550": ("sm8550", "Snapdragon SM8550", "Qualcomm"), "BCM2711": ("bcm2711", "BCM2711", "Broadcom")}
    texts = [(DTS, "x"), ("none", "x"), ("/ { cpus { cpu@0 { a; }; ", "x"), ("cpus { cpu@1 { x { y; }; }; }; cpu@2 { };", "arch/arm64/a"), ("cpus { };", "arch/arm64/b"), (None, "arch/arm64/c")]
    got = spark.createDataFrame(texts, "t string, p string").select(devicetree.cpu_nodes("t").alias("n"), "p").select(devicetree.processors(F.col("n"), F.col("p")).alias("c")).collect()
    assert [tuple(r.c) for r in got] == [(2, "ARMv8.2-A", "compatible"), (None, None, None), (None, None, None), (1, "ARMv8-A", "fallback"), (None, "ARMv8-A", "fallback"), (None, None, None)]
    paths = [("../b/x.dtsi", "a/c"), ("./y", "a/"), ("z.dts", "a/b"), ("../../../q.dtsi", "a")]
    got = spark.createDataFrame(paths, "t string, f string").select(devicetree.include_path(F.col("t"), F.col("f")).alias("p")).collect()
    assert [r.p for r in got] == ["a/b/x.dtsi", "a/y.dtsi", "a/b/z.dts", "q.dtsi"]
    files = spark.createDataFrame([(TREE[0], '#include "inc/cpu.dtsi"' + " " * 200), ("arch/arm64/boot/dts/qcom/inc/cpu.dtsi", DTS + " " * 200)], "path string, content string")
    assert {r.path: r.cores for r in devicetree.cpu_info(files).collect()} == {TREE[0]: 2, "arch/arm64/boot/dts/qcom/inc/cpu.dtsi": 2}
    chips = spark.createDataFrame([("c", "Qualcomm", "SM8550", None, "old"), ("f", "Qualcomm", "QCOM", None, None)], "id string, vendor string, model string, cores int, architecture string")
    got = {r.id: (r.cores, r.architecture) for r in devicetree.enrich_from_files(chips, files, vendors).collect()}
    assert got == {"c": (2, "ARMv8.2-A"), "f": (None, None)}


def test_includes_in_the_order_of_the_text(spark):
    cpus = lambda core, more="": f'cpus {{ cpu@0 {{ {core} }} ; l2 {{ compatible = "arm,cortex-a78-l2"; }}; {more} }};' + " " * 200
    named = lambda core: f'compatible = "arm,{core}";'
    inc = lambda *names: "".join(f'#include "{n}.dtsi"\n' for n in names)
    texts = {
        "z.dtsi": cpus(named("cortex-a78"), "cpu@1 { };"), "a.dtsi": cpus(named("cortex-a53")), "s.dtsi": "cpus { cpu@0 { }; };", "none.dtsi": cpus("reg;"), "hub.dtsi": inc("z", "a") + " " * 200,
        "b1.dts": inc("z", "a"), "b2.dts": inc("s", "missing", "hub", "a"), "b3.dts": inc("a", "z"), "flat.dtsi": "cpus { };" + " " * 200, "dry.dtsi": " " * 200, "b4.dts": inc("flat", "dry"), "b5.dts": inc("dry", "flat"), "loop.dtsi": inc("loop") + " " * 200, "deep.dts": inc("d1"), "d1.dtsi": inc("d2") + " " * 200, "d2.dtsi": inc("d3") + " " * 200, "d3.dtsi": cpus(named("cortex-x4")),
    }
    files = spark.createDataFrame([(f"arch/arm64/boot/{k}", v) for k, v in texts.items()], "path string, content string")
    got = {r.path.split("/")[-1]: (r.cores, r.architecture, r.arch_source) for r in devicetree.cpu_info(files).collect()}
    z, a = (2, "ARMv8.2-A", "compatible"), (1, "ARMv8-A", "compatible")
    flat = (None, "ARMv8-A", "fallback")
    assert got == {"z.dtsi": z, "a.dtsi": a, "s.dtsi": (1, "ARMv8-A", "fallback"), "none.dtsi": (1, "ARMv8-A", "fallback"), "hub.dtsi": z, "b1.dts": z, "b2.dts": z, "b3.dts": a, "flat.dtsi": flat, "b5.dts": flat, "d3.dtsi": (1, "ARMv9-A", "compatible"), "d2.dtsi": (1, "ARMv9-A", "compatible"), "d1.dtsi": (1, "ARMv9-A", "compatible")}


def test_batches_resume(spark, tmp_path):
    src, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    one = lambda k: spark.createDataFrame([(i, 2020 + i % 5) for i in range(k, k + 10)], "id int, year int").coalesce(1).write.mode("append").parquet(src)
    one(0)
    one(10)
    run = lambda: batches.run_batches(spark, src, spark.read.parquet(src).schema, enrich.infer_wifi, out, state)
    assert run() == 20 and run() == 0
    one(20)
    assert run() == 10 and spark.read.parquet(out).count() == 30
    batches.clear_checkpoint(spark, state)


def test_limit_stream_is_limit_batch(spark, tmp_path, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 5").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    want = limits.limit_batch(e, "user_id", "ts", "event_id", 3, 86400.0)
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = limits.limit_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "user_id", "ts", 3, 86400.0)
    q = stream.writeStream.format("memory").queryName("lim").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).start()
    q.awaitTermination()
    count = lambda df: sorted(tuple(r) for r in df.groupBy("user_id", "allowed").count().collect())
    assert count(spark.table("lim")) == count(want)


def test_pages_and_unions(spark):
    pages = spark.createDataFrame([("u1", "u2"), ("u2", "u3"), ("u3", "u1")], "url string, next_url string")
    assert [r.url for r in catalog.follow_pages(pages, "u1").orderBy("page_no").collect()] == ["u1", "u2", "u3"]
    chain = spark.createDataFrame([(f"u{k}", f"u{k + 1}") for k in range(150)] + [("u150", None), ("u900", "u3")], "url string, next_url string")
    got = catalog.follow_pages(chain, "u0").collect()
    assert [r.url for r in got] == [f"u{k}" for k in range(151)] and [r.page_no for r in got] == list(range(151))
    assert catalog.follow_pages(chain, "none").count() == 0
    triples = spark.createDataFrame([("q1", "instance_of", "soc"), ("q1", "manufacturer", "v"), ("q1", "node", "7"), ("q2", "node", "5")], "s string, p string, o string")
    assert [tuple(r) for r in catalog.triple_query(triples, "v", ["soc"], "node").collect()] == [("q1", "7")]
    r = catalog.Registry()
    r.register("a")(len)
    assert r.get("a") is len and list(r.all()) == ["a"]
    with pytest.raises(ValueError):
        r.register("a")(len)


ROWS = """<table><tr><th>Other</th></tr><tr><td>x</td></tr></table><table><tr><th>Processor</th><th>Cinebench R23</th><th>Cores</th></tr><tr><td>Ryzen 9</td><td>1,234</td><td>16</td></tr></table>"""
CPU = "<table><tr>" + "<th>h</th>" * 9 + "</tr><tr><td>AMD Ryzen 7950X</td><td>16 / 32</td><td>4.5 GHz to 5.7 GHz</td><td>5 nm</td><td>170 W</td><td>DDR5 128 GB</td><td>L3 64 MB</td><td>Radeon Graphics</td><td>Socket AM5</td></tr></table>"


def test_benchmark_and_positional_rows(spark):
    cells = extract.table_cells(spark.createDataFrame([(1, ROWS)], "k int, html string"), "k")
    one = extract.largest_or_named(cells, "k", ("processor", "cinebench"))
    r = extract.benchmark_records(one, "k", {"cinebench_r23": "(?i)cinebench r23"}).first()
    assert (r.table_no, r.name, r.fields) == (1, "Ryzen 9", {"cinebench_r23": 1234.0, "cores": 16.0})
    r = extract.positional_records(extract.table_cells(spark.createDataFrame([(1, CPU)], "k int, html string"), "k"), "k").first()
    assert (r.name, r.model, r.cores, r.threads, r.clock, r.boost, r.process_nm, r.tdp) == ("AMD Ryzen 7950X", "Ryzen 7950X", 16, 32, 4.5, 5.7, 5, 170)
    assert (r.memory_type, r.memory_max, r.l3_cache, r.gpu, r.socket) == ("DDR5", "128 GB", "64 MB", "Radeon Graphics", "Socket AM5")


def test_spec_pairs(spark):
    pairs = [(1, 0, "CPU Cores", "8"), (1, 1, "Max frequency", "3.2 GHz"), (1, 2, "Lithography", "Intel 7"), (1, 3, "L2 cache", "12 mb"), (1, 4, "GPU", "—"), (1, 5, "Launch", "Q1 2023"), (1, 6, "Memory", "LPDDR5 16 GB")]
    r = extract.spec_records(spark.createDataFrame(pairs, "k int, place int, k2 string, v string").withColumnRenamed("k", "page").withColumnRenamed("k2", "k"), "page").first()
    assert r.specs == {"cores": "8", "threads": "8", "clock": "3.2", "process_nm": "10", "l2_cache": "12 MB", "memory_type": "LPDDR5", "memory_max": "16 GB"}


def _table(*rows):
    """A table of rows of cells; a cell that begins with ! is a header."""
    return "<table>" + "".join("<tr>" + "".join(f"<th>{c[1:]}</th>" if c.startswith("!") else f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</table>"


def _page_records(spark, html, vendor="V"):
    t = tables.page_tables(spark.createDataFrame([(1, html)], "k int, html string"), "k")
    return {r.name: r for r in tables.page_records(t, "k", F.lit(vendor)).collect()}


def test_records_that_are_columns(spark):
    html = "<h2>Chips</h2>" + _table(
        ["!", "!SM8550", "!SM8650", "!A5", "!SM8550"], ["!CPU", "4 cores", "6 cores", "2 cores", "9 cores"], ["!CPU config", "8 cores", "", "", ""], ["!Memory", "Type", "LPDDR4", "LPDDR5", "DDR3", "DDR4"], ["!Memory size", "8 GB"],
        ["!AI engine", "one", "two", "three", "four"], ["!NPU", "", "late", "", ""], ["!Launched", "2021", "2022", "", ""], ["!Date of sale", "2025", "2026", "2027", "2028"], ["Model number", "AB1", "AB2", "ab", "AB4"], ["!Codename", "x", "y", "z", "w"],
    )
    got = _page_records(spark, html)
    values = {n: (r.cores, r.memory_type, r.memory_max, r.npu, r.year, r.model, r.codename) for n, r in got.items()}
    assert values == {"SM8550": (8, "LPDDR4", 8, None, 2021, "AB1", "x"), "SM8650": (6, "LPDDR5", None, "late", 2022, "AB2", "y"), "V A5": (2, "DDR3", None, None, 2027, None, "z")}


def test_records_that_are_rows(spark):
    html = "<h2>Chips</h2>" + _table(["!Model", "!Memory", "!RAM", "!Released"], ["SM8550", "LPDDR5", "16 GB LPDDR4", "2019"], ["SM8551", "-", "4 GB", "2020"], ["SM2003x", "", "", ""], ["SM2004x", "", "", ""], ["SM2015x", "", "", ""], ["SM8550", "DDR3", "", ""], ["only"])
    values = {n: (r.memory_type, r.memory_max, r.year, r.cores) for n, r in _page_records(spark, html).items()}
    assert values == {"SM8550": ("LPDDR5", 16, 2019, 8), "SM8551": (None, 4, 2020, 8), "SM2003x": (None, None, 2020, 8), "SM2004x": (None, None, 2020, 8), "SM2015x": (None, None, 2015, 8)}
    early = "<h2>Of 2011</h2>" + _table(["!Model", "!GPU"], ["SM2001x", "a"], ["SM2002x", "b"], ["SM2003x", "c"])
    assert {n: r.year for n, r in _page_records(spark, early).items()} == {"SM2001x": 2011, "SM2002x": 2011, "SM2003x": 2011}
    assert _page_records(spark, "<h2>Acronyms</h2>" + html.split("</h2>")[1]) == {} and _page_records(spark, "") == {}


def test_core_names_are_looked_up_once(spark):
    """A file of many processors is as fast as their distinct names; the lookup stands nowhere inside the search for the newest one."""
    files = spark.createDataFrame([("arch/arm64/boot/dts/v/a.dtsi", "cpus { " + "".join(f'cpu@{k:x} {{ compatible = "arm,cortex-{"a53" if k % 2 else "a76"}"; }}; ' for k in range(64)) + "};")], "path string, content string")
    got = devicetree.cpu_info(files).collect()
    assert [tuple(r) for r in got] == [("arch/arm64/boot/dts/v/a.dtsi", 64, "ARMv8.2-A", "compatible")]
    assert "cortex-a520" not in str(devicetree.processors(F.col("n"), F.col("path"), F.col("named")))
