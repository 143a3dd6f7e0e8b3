"""Rules and scalars against values worked out by hand and against plain Python models."""

import uuid
from datetime import date

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrion.functions import scalars, text
from quarrion.functions.stem import stem
from quarrion.operators import enrich, filters, provenance, quality, resolve, search
from quarrion.schema import is_filled, record_schema, violations
from quarrion.streaming.limits import WindowLog

YEARS = [
    ("MT6765", "", "", 2016), ("MT9950", "", "", 2025), ("", "Dimensity 9300", "", 2024), ("", "Helio G85", "", None), ("", "Kirin 990", "", 2019), ("SM8550", "", "", 2023), ("SDM845", "", "", 2011), ("MSM8998", "", "", 2025),
    ("", "Exynos 2400", "", 2024), ("", "Exynos 990", "", 2020), ("", "Snapdragon X Elite", "", 2024), ("", "Snapdragon 8 Gen 2", "", 2023), ("", "Snapdragon 7 Gen 3", "", 2023), ("RK3588", "", "", 2015),
    ("", "Apple A17 Pro", "", 2024), ("", "Apple M3", "", 2023), ("", "M0 core", "", None), ("tegra264", "", "", 2272), ("T124", "", "", 2020), ("", "Snapdragon 855", "", 2019), ("OMAP4430", "", "", 2012), ("S905", "", "Amlogic", 2016),
    ("T962", "", "Amlogic", 2016), ("", "Kompanio 1300", "", 2022), ("JZ4780", "", "", 2009), ("K3V2E", "", "", 2013), ("", "Kirin T91", "", 2024), ("", "Kirin T70", "", None), ("UMS9230", "", "", 2019), ("H616", "", "", 2023), ("A64", "", "Allwinner", 2025), ("A523x", "", "Allwinner", 2056), ("x5 chip", "", "", 2015), ("plain", "nothing", "", None),
]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_years(spark):
    df = spark.createDataFrame([(i, m, n, v) for i, (m, n, v, _) in enumerate(YEARS)], "i int, model string, name string, vendor string").withColumn("year", F.lit(None).cast("int"))
    got = {r.i: r.year for r in enrich.validate_year(df).collect()}
    assert [got[i] for i in range(len(YEARS))] == [y for *_, y in YEARS]


def test_text(spark):
    t = F.col("t")
    assert one(spark, text.clean(t), t="<b>Big</b>  [note] chip (now small)") == "Big chip"
    assert one(spark, text.clean(t), t="<i></i>") is None
    assert one(spark, text.slug(t, F.lit("SM8550-AC")), t="Snapdragon® 8+ Gen 2 with the Kryo") == "snapdragon_8p_gen_2_sm8550ac"
    assert one(spark, text.slug(t), t="☃") == "chip"
    assert one(spark, text.extract_model(t), t="the exynos 9810 and SM8550") == "SM8550"
    for v, m in (("Qualcomm ", "SM8550"), ("é", " x")):
        assert one(spark, text.record_uuid(F.col("v"), F.col("m")), v=v, m=m) == uuid.uuid5(uuid.NAMESPACE_DNS, f"{v.strip().lower()}:{m.strip().lower()}").hex


def test_similarity(spark):
    assert one(spark, text.token_sort_ratio(F.col("a"), F.col("b")), a="gen 8 snapdragon", b="snapdragon 8 gen") == 100.0
    assert one(spark, text.indel_ratio(F.col("a"), F.col("b")), a="abcd", b="bcde") == 75.0
    assert one(spark, text.indel_ratio(F.col("a"), F.col("b")), a="", b="abc") == 0.0


def test_cpu(spark):
    got = one(spark, scalars.parse_cpu(F.col("t")), t="1x Cortex-X3 @ 3.2 GHz, 4x A715 2.8 GHz, 3x A510 2.0 GHz")
    assert (got.architecture, got.cores, got.cluster_config, got.clock_min, got.clock_mid, got.clock_max, got.max_freq) == ("ARMv8.2-A", 8, "1+4+3", 2000, 2800, 3200, "3.20 GHz")
    assert one(spark, scalars.parse_cpu(F.col("t")), t="8 cores ARMv9").cores == 8
    assert one(spark, scalars.parse_cpu(F.col("t")), t="800 MHz").max_freq == "800 MHz"


def test_cells(spark):
    t = F.col("t")
    assert tuple(one(spark, scalars.parse_modem(t), t="X70 10 Gbps download 3.5 Gbps upload")) == ("X70 10 Gbps download 3.5 Gbps upload", 10000, 3500)
    assert tuple(one(spark, scalars.parse_connectivity(t), t="Wi-Fi 7, Bluetooth 5.3 NFC")) == ("Wi-Fi 7", "5.3", "NFC")
    assert one(spark, scalars.parse_display(t), t="3840×2160 @ 60Hz") == "3840×2160 @ 60Hz"
    assert one(spark, scalars.parse_year(t), t="2045 or 2020") is None and one(spark, scalars.detect_year(t), t="2045 or 2020") == 2020
    assert one(spark, scalars.detect_column(t), t="isps") == "camera" and one(spark, scalars.detect_column(t), t="main") is None
    assert one(spark, scalars.parse_process_node(t), t="Intel 7") == 10 and one(spark, scalars.parse_score(t), t="2,345.9") == 2345


def test_stem():
    pairs = "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor conflated:conflat hopping:hop falling:fall filing:file happy:happi relational:relat triplicate:triplic hopeful:hope revival:reviv adjustable:adjust controll:control sky:sky"
    for p in pairs.split():
        word, want = p.split(":")
        assert stem(word) == want


def chip(spark, *rows):
    return spark.createDataFrame([dict(r) for r in rows], "id string, name string, vendor string, model string, year int, cores int, provenance map<string,string>, wikidata_id string, completeness double")


# One frame is many examples; without shrinking, as each run is a Spark job.
@settings(max_examples=2, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.fixed_dictionaries({"name": st.text("Az 9", max_size=12), "vendor": st.sampled_from(["Apple", "Samsung", "Unknown", ""]), "model": st.text("SM81", max_size=6), "year": st.one_of(st.none(), st.integers(1990, 2040))}), min_size=150, max_size=200))
def test_enrichment_holds(spark, rows):
    given_years = {str(k): r["year"] for k, r in enumerate(rows)}
    out = enrich.enrich(chip(spark, *({"id": str(k), **r} for k, r in enumerate(rows))), on=date(2026, 1, 1)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.vendor not in ("Apple", "Samsung") or r.architecture == "ARMv8"
        # Memory is filled from the year that was given before that year is corrected.
        first = given_years[r.id] or r.year
        assert r.memory_type.startswith("LPDDR5") == (first >= 2021) if first else True
        assert 0 <= r.completeness <= 1 and r.uuid and r.model


def test_knowledge_comes_first(spark):
    from quarrion.knowledge import GRAPHICS, PROCESS_NM, knowledge

    rows = [{"id": f"{v}{k}", "name": "n", "vendor": v, "model": m.upper(), "year": 2020} for v, known in PROCESS_NM.items() for k, m in enumerate(known)]
    out = {r.id: r for r in enrich.enrich(chip(spark, *rows)).collect()}
    for r in rows:
        first = lambda table: next((x for k, x in table.get(r["vendor"], {}).items() if k.upper() in r["model"]), None)  # noqa: B023, E731
        assert out[r["id"]].process_nm == first(PROCESS_NM) and out[r["id"]].gpu == (first(GRAPHICS) or enrich.VENDOR_GPU[r["vendor"]])
    assert knowledge({"Qualcomm": {"process_map": {"sm8750": 2}}, "X": {"architecture": "A"}})["Qualcomm"]["process_map"]["sm8750"] == 2


def test_valid_names(spark):
    good = "Snapdragon X|Exynos 990|SM8550|Kirin X|i.MX 8|MT6797|Apple silicon|A15 Bionic|Tegra X1"
    bad = "Generic|Snapdragon|Kirin|Overview|4x12 foo|7 nm|3 cores|armv8|LPDDR4|TBD|?|x|2.4 GHz|--|Tegra|Feature|october|ARMv8-A"
    for t in good.split("|"):
        assert one(spark, filters.valid_name(F.col("t")), t=t) is True, t
    for t in bad.split("|"):
        assert one(spark, filters.valid_name(F.col("t")), t=t) is False, t
    assert one(spark, filters.valid_name(F.nullif(F.col("t"), F.lit("x"))), t="x") is False
    label = scalars.is_spec_label(F.col("t"))
    assert all(one(spark, label, t=t) for t in ("12 34", "", "up to 3 GHz max", "60 fps", "LPDDR5 memory")) and not one(spark, label, t="Alpha 12")


def test_enrich_values(spark):
    r = enrich.enrich(chip(spark, {"id": "a", "name": "Snapdragon 8 Gen 2 (now old)", "vendor": "Qualcomm", "model": "SM8550"}), {"Qualcomm": {"process_map": {"SM8550": 4}, "gpu_map": {"SM855": "Adreno 740"}}}).first()
    assert (r.name, r.year, r.process_nm, r.process_name, r.gpu, r.memory_type, r.memory_clock, r.memory_bus) == ("Snapdragon 8 Gen 2", 2023, 4, "4nm", "Adreno 740", "LPDDR5X", 4266, 64)
    assert (r.modem, r.npu, r.wifi, r.bluetooth, r.storage_type, r.aliases) == ("Snapdragon X70 5G", "Hexagon NPU", "Wi-Fi 7", "5.3", "UFS 3.1", ["Kalama", "Snapdragon 8 Gen 2 (SM8550)"])


def test_emptiness(spark):
    df = spark.createDataFrame([("", 0, False, [], {}), ("x", 1, True, ["a"], {"a": "b"})], "s string, i int, b boolean, a array<string>, m map<string,string>")
    got = [tuple(r) for r in df.select(*[is_filled(df, c).alias(c) for c in df.columns]).collect()]
    assert got == [(False, False, False, False, True), (True,) * 5]


def test_violations(spark):
    df = spark.createDataFrame([("ok_1", "n", "v", 4), ("Bad Id", "", "v", 999)], "id string, name string, vendor string, cores int")
    assert [r._violations for r in violations(df).collect()] == [[], ["missing_name", "range_cores", "pattern_id"]]


def test_match_order(spark):
    old = chip(spark, {"id": "e1", "name": "Alpha One", "vendor": "V", "model": "M1"}, {"id": "e2", "name": "Beta Two", "vendor": "V", "model": "SM8550", "wikidata_id": "Q7"}, {"id": "e3", "name": "gamma", "vendor": "W", "model": "z"})
    new = chip(
        spark, {"id": "n1", "name": "x", "vendor": "q", "model": " m1 "}, {"id": "n2", "name": "chip SM8550", "vendor": "q", "model": ""}, {"id": "n3", "name": "y", "vendor": "q", "model": "", "wikidata_id": "Q7"},
        {"id": "n4", "name": "One Alpha", "vendor": "v", "model": ""}, {"id": "n5", "name": "GAMMA", "vendor": "other", "model": ""}, {"id": "n6", "name": "none", "vendor": "none", "model": ""}, {"id": "n7", "name": "p", "vendor": "q", "model": "ALI"},
    )
    aliases = spark.createDataFrame([("ali", "beta two")], "model string, alias string")
    got = {r.id: (r.match_id, r.strategy) for r in resolve.match(new, old, aliases).collect()}
    assert got == {"n1": ("e1", "exact_model"), "n2": ("e2", "regex"), "n3": ("e2", "wikidata_qid"), "n4": ("e1", "fuzzy"), "n5": ("e3", "name"), "n6": (None, "no_match"), "n7": ("e2", "alias")}
    merged = {r.id: (r.name, r.model) for r in resolve.upsert(old, new, aliases).collect()}
    assert len(merged) >= 4 and merged["e1"][0] in ("x", "One Alpha")
    assert resolve.deduplicate(new, old, only_new=True, aliases=aliases).count() == 1


def test_provenance(spark):
    df = chip(spark, {"id": "a", "name": "n", "vendor": "v", "model": "", "cores": 4, "provenance": {"name": "old"}})
    got = df.select(provenance.track(df, "new").alias("p"), provenance.track(df, "new", force=True).alias("f"), provenance.record_field(F.col("provenance"), "name", "z").alias("z")).first()
    assert got.p == {"name": "old", "vendor": "new", "cores": "new"} and got.f["name"] == "new" and got.z == {"name": "z"}
    assert provenance.reapply(df, "old").first().provenance == {"name": "enrichment", "vendor": "enrichment", "cores": "enrichment"}
    lit = F.lit
    pick = lambda *a: spark.range(1).select(provenance.resolve(*[lit(x) for x in a], ["a", "b"]).alias("x")).first().x
    assert [pick("1", "2", "b", "a"), pick("1", "2", "a", "b"), pick("1", "2", "x", "b"), pick("1", "2", "x", "y"), pick("", "2", "a", "b"), pick("1", "", "b", "a")] == ["2", "1", "2", "1", "2", "1"]


def test_fuzzy_is_complete(spark):
    import random

    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "Pro", "X1", "20", "é"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(60)]

    def ratio(a, b):
        a, b = (" ".join(sorted(x.split())) for x in (a, b))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return 200.0 * row[-1] / (len(a) + len(b))

    rows = [(str(k), n, "v" if k % 3 else "W") for k, n in enumerate(names)]
    side = lambda p: spark.createDataFrame(rows, f"{p}id string, {p}name string, {p}vendor string")
    for least in (80.0, 92.0):
        got = {(r.n_id, r.e_id): r.score for r in resolve.fuzzy_candidates(side("n_"), side("e_"), least).collect()}
        want = {(a[0], b[0]): ratio(a[1], b[1]) for a in rows for b in rows if a[2] == b[2] and ratio(a[1], b[1]) >= least}
        assert got == pytest.approx(want)


def test_drift(spark):
    keys = spark.createDataFrame([("s", "a"), ("s", "x"), ("t", "a")], "source string, key string")
    want = spark.createDataFrame([("s", ["a", "b"]), ("u", ["a"])], "source string, expected array<string>")
    got = {r.source: (r.coverage, r.missing, r.unexpected, r.drift) for r in quality.drift(keys, want).collect()}
    assert got == {"s": (0.5, ["b"], ["x"], True), "t": (1.0, [], [], False), "u": (0.0, ["a"], [], True)}


def test_report(spark):
    df = chip(spark, {"id": "1", "name": "a", "vendor": "V", "cores": 4, "provenance": {"name": "s1", "cores": "s2"}}, {"id": "2", "name": "", "vendor": "V", "provenance": {"name": "s2"}}, {"id": "3", "name": "c", "vendor": None})
    r = quality.QualityReport(df)
    assert {(x["field"], x["fill_rate"]) for x in r.by_vendor if x["vendor"] == "V"} == {("name", 0.5), ("cores", 0.5)}
    assert r.conflicts == [{"vendor": "V", "conflicts": 1, "fields": 2, "conflict_rate": 0.5}]
    assert "# Data quality" in r.markdown() and r.to_dict()["total"] == 3


def test_search(spark):
    df = spark.createDataFrame([("1", "Running the quick chips"), ("2", "a chip runs"), ("3", "quick Adreno GPU"), ("4", "quickly adreno")], "id string, name string")
    ids = lambda q, **kw: [r.id for r in search.search(df, q, "id", ["name"], **kw).collect()]
    assert set(ids("quick")) == {"1", "3"} and ids("") == [] and set(ids("quick*")) == {"1", "3", "4"} and ids('"adreno gpu"') == ["3"]
    assert set(ids("chips run", stems=True)) == {"1", "2"} and ids('"quick chips" run*') == ["1"] and ids('"running the quick"', stems=True) == ["1"]
    assert set(ids('adreno "gpu')) == {"3"}  # an odd quote


def test_search_statistics_are_those_of_all_rows(spark):
    from math import log

    texts = ["alpha beta", "alpha betta gamma", "gamma", "delta delta delta", "alpha beta beta x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    split = [t.split() for t in texts]
    mean = sum(map(len, split)) / len(split)

    def plain(*parts):
        out = {}
        n = [[sum(fits(w, k) for k in range(len(w))) for w in split] for fits in parts]
        for i, w in enumerate(split):
            if all(c[i] for c in n):
                out[i] = sum(max(log((len(split) - sum(x > 0 for x in c) + 0.5) / (sum(x > 0 for x in c) + 0.5)), 1e-6) * c[i] * 2.2 / (c[i] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for c in n)
        return out

    word = lambda x: lambda w, k: w[k] == x
    begins = lambda x: lambda w, k: w[k].startswith(x)
    phrase = lambda *x: lambda w, k: tuple(w[k : k + len(x)]) == x
    for q, parts in (("alpha", [word("alpha")]), ("alpha be*", [word("alpha"), begins("be")]), ("be*", [begins("be")]), ('"alpha beta"', [phrase("alpha", "beta")]), ('gamma "alpha betta"', [word("gamma"), phrase("alpha", "betta")])):
        got = {r.id: r.score for r in search.search(df, q, "id", ["t"]).collect()}
        assert got == pytest.approx(plain(*parts)), q


def test_layers(spark):
    fact = "vendor string, kind string, key string, value string"
    base = spark.createDataFrame([("V", "architecture", "", "A1"), ("V", "process_map", "m1", "4"), ("W", "architecture", "", "B1"), ("V", "gpu_map", "m1", "G")], fact)
    live = spark.createDataFrame([("V", "architecture", "", "A2"), ("V", "process_map", "m1", "9"), ("V", "process_map", "m2", "5"), ("W", "architecture", "", ""), ("N", "gpu_map", "x", "H")], fact)
    fixes = spark.createDataFrame([("V", "gpu_map", "m1", "F"), ("N", "architecture", "", "C"), ("W", "architecture", "", None)], fact)
    got = {tuple(r) for r in resolve.merge_layers(base, live, fixes).collect()}
    assert got == {("V", "architecture", "", "A2"), ("V", "process_map", "m1", "4"), ("V", "process_map", "m2", "5"), ("W", "architecture", "", "B1"), ("V", "gpu_map", "m1", "F"), ("N", "gpu_map", "x", "H"), ("N", "architecture", "", "C")}


def test_requests_without_a_key_share_a_log(spark):
    from quarrion.streaming.limits import limit_batch

    e = spark.createDataFrame([(None, k, k) for k in range(4)] + [(7, k, 10 + k) for k in range(2)], "u long, s long, id long").selectExpr("u", "timestamp_seconds(s) AS ts", "id")
    got = {r.id: r.allowed for r in limit_batch(e, "u", "ts", "id", 1, 100.0).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 10: True, 11: False}


def test_cursor():
    assert filters.decode_cursor(filters.encode_cursor(120)) == 120
    for bad in ("x", filters.encode_cursor(-1)):
        with pytest.raises(ValueError):
            filters.decode_cursor(bad)


def test_window_log():
    a, b = WindowLog(2, 10.0), WindowLog(2, 10.0, inclusive=True)
    assert [a.check(t)[0] for t in (0, 0, 5, 10, 10.5)] == [True, True, False, False, True]
    assert [b.check(t)[0] for t in (0, 0, 5, 10, 10.5)] == [True, True, True, True, False]


def test_schema():
    assert len(record_schema()) > 95 and record_schema()["_extra"].dataType.simpleString() == "map<string,string>"


def test_names(spark):
    t = F.col("t")
    assert one(spark, scalars.trailing_model(t), t="Core i7-13700K") == "13700K" and one(spark, scalars.trailing_model(t), t="Xeon E5530 server") == "E5530"
    assert one(spark, scalars.processor_name(t), t="the new AMD Ryzen 9 7950X is") == "AMD Ryzen 9 7950" and one(spark, scalars.processor_name(t), t="none") is None
    assert [one(spark, scalars.apple_chip(t), t=x) for x in ("Apple M3 Max chip", "A17 Pro", "A18", "B2")] == ["M3 Max", "A17 Pro", "A18", None]
    assert one(spark, scalars.heading_name(F.col("v"), t), v="NXP i.MX", t="The i.MX-8M family") == "i.MX 8M"
    assert one(spark, scalars.record_name(t, F.lit("Tegra 4 series"), ("Snapdragon",)), t="Snapdragon 8 [note] x") == "Snapdragon 8 x"
    assert one(spark, scalars.is_spec_label(t), t="LPDDR5 memory") and not one(spark, scalars.is_spec_label(t), t="Snapdragon") and one(spark, scalars.is_sub_label(t), t=" Type ")
