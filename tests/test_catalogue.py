"""Every catalogue query against DuckDB on the same tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from quarrion.plans import catalogue

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    result = db.execute(catalogue.ORACLE_SQL[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    want = plain(tuple(r[found.index(c)] for c in columns) for r in result.fetchall())
    assert plain(tuple(r) for r in df.select(*columns).collect()) == want and want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Queries whose parts' numbers have more than five digits somewhere, and years' digits.
LONG_KEYS = ["article_records", "catalogue_lookup", "file_candidates", "merge_into_vendors", "page_records", "layout_records", "match_strategies"]


@pytest.fixture(scope="module")
def long_keys(sf, tmp_path_factory):
    """Parts about the keys at which numbers get a further digit, and those that look like years."""
    path = tmp_path_factory.mktemp("long")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT (b + i)::BIGINT AS p_partkey, 'Brand#1' || (i % 4 + 1) AS p_brand, p.* EXCLUDE (p_partkey, p_brand) FROM (VALUES (1992), (9996), (99996), (999996)) v(b), range(24) r(i)
    JOIN '{sf}/part.parquet' p ON p.p_partkey = 1 + (i * 7) % 100) TO '{path}/part.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{path}/part.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", LONG_KEYS)
def test_long_keys(spark, long_keys, name):
    test_query(spark, *long_keys, name)


def test_pieces_lose_no_pair(spark):
    """Names of 20 to 34 letters with up to six changed, put in or left out, against every pair."""
    import random

    from quarrion.functions.text import common_letters
    from quarrion.operators import resolve

    draw = random.Random(5)

    def edited(s):
        s = list(s)
        for _ in range(draw.randrange(7)):
            k = draw.randrange(len(s))
            s[k : k + 1] = draw.choice([[], [draw.choice("abcdef")], [s[k], draw.choice("abcdef")]])
        return "".join(s)

    old = ["".join(draw.choice("abcdef") for _ in range(draw.randrange(20, 35))) for _ in range(60)]
    new = [edited(draw.choice(old)) for _ in range(120)]
    n = spark.createDataFrame([(k, s, "v") for k, s in enumerate(new)], "n_id int, n_name string, n_vendor string")
    e = spark.createDataFrame([(k, s, "V") for k, s in enumerate(old)], "e_id int, e_name string, e_vendor string")
    lcs = common_letters.func
    import pandas as pd

    want = {(i, j) for i, a in enumerate(new) for j, b in enumerate(old) if 200.0 * int(lcs(pd.Series([a]), pd.Series([b]))[0]) / (len(a) + len(b)) >= 85}
    assert {(r.n_id, r.e_id) for r in resolve.fuzzy_candidates(n, e, 85.0).collect()} == want and want
    assert any(len(resolve._pieces(len(a), len(b), 85.0)) > 1 for a in new for b in old)
    assert int(lcs(pd.Series(["kitten"]), pd.Series(["sitting"]))[0]) == 4
