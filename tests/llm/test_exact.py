"""Distance keys, induced suffixes and exact whitening against brute force, on odd rows and on empty tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarrion.llm import negatives, sais, simhash, suffixes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, v string, n string, row string, anchor string, key string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows, schema=SCHEMA):
    """Rows with further columns whose names the operators use inside."""
    width = len(schema.split(", "))
    rows = [tuple([None if c is None else float(c) for c in x] if isinstance(x, list) else x for x in r) for r in rows]
    return spark.createDataFrame([(*r, *["?"] * (width - len(r))) for r in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)], rng.randrange(3)) for k in range(240)]
    same = [0.5, -0.25, 0.125, 1.0, 0.0, -1.0]
    rows += [(240 + k, same, k % 2) for k in range(120)]
    rows += [(400, None, 1), (401, [0.1, None, 0, 0, 0, 0], 1), (402, [NAN, 0, 0, 0, 0, 0], 1), (403, [INF, 0, 0, 0, 0, 0], 1), (404, [1.0, 2.0], 1), (405, [], 1), (500, same, None), (None, same, 1), (700, [3.0, 3, 3, 3, 3, 3], 9), (700, [3.0, 3, 3, 3, 3, 3], 9), (20, [0.0] * 6, 2)]
    return rows


# ---------------------------------------------------------------- hard negatives


def mined(rows, anchors, scale=256):
    fine = sorted({(i, y, tuple(math.floor(scale * float(np.float32(c))) for c in v)) for i, v, y in rows if i is not None and y is not None and v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)})
    out = []
    for i, y, v in fine:
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in fine)
        for s, p, _ in [t for t in scored if t[2] == y and t[1] != i][:5]:
            out += [(i, p, r, j, -s, -t) for r, (t, j, _) in enumerate([t for t in scored if t[2] != y and 80 * -s <= 100 * -t[0] <= 100 * -s][:5], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_negatives_are_the_brute_force_ones(spark, odd_vectors, monkeypatch, small):
    if small:  # many pivots, rings and rounds
        for name, value in {"CELL": 12, "FIRST": 5, "WIDER": 2, "ASKED": 2, "PIVOTS": 4}.items():
            monkeypatch.setattr(negatives, name, value)
    got = negatives.mine(table(spark, odd_vectors), "vec_id % 20 = 0")
    assert sorted(tuple(r) for r in got.collect()) == mined(odd_vectors, lambda i: i % 20 == 0) != []


def test_negatives_of_large_entries_and_empty_tables(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1, 1]) * 10.0 ** rng.randrange(0, 5) for _ in range(6)], k % 2) for k in range(60)]
    assert sorted(tuple(r) for r in negatives.mine(table(spark, rows), "vec_id < 4").collect()) == mined(rows, lambda i: i < 4)
    for some in ([], [(1, None, 1)], [(100, [1.0] * 6, 1)]):
        assert negatives.mine(table(spark, some), "vec_id % 100 = 0").collect() == []


# ---------------------------------------------------------------- suffixes


def test_suffix_arrays(monkeypatch):
    rng = random.Random(1)
    for trial in range(400):
        k = rng.choice([1, 2, 3, 26])
        t = [rng.randrange(1, k + 1) for _ in range(rng.randrange(50))] * rng.randrange(1, 3) + [0]
        monkeypatch.setattr(sais, "WIDE", rng.choice([0.001, 10**6]))
        a = np.array(t, np.int32)
        order = sais.suffix_array(a, k + 1)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        common = sais.permuted_prefixes(a, order)
        for i, j in zip(order[1:].tolist(), order[:-1].tolist()):
            n = next(m for m in range(len(t)) if t[i + m] != t[j + m])
            assert common[i] == n


def without_repeats(texts, width):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and not h for g, h in zip(gone, b"\0" + gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("alpha beta gamma ümlaut ☃ eps zeta".split()) + str(rng.randrange(40)) for _ in range(n))
    p, q = say(120), say(90)
    return [None, "", "short", p, p, say(30) + p + say(30), say(10) + p[50:700] + say(40), q + q, q[:300], "a" * 5000, "a" * 9000 + "b", "ab" * 3000, "x" * 401, "y" * 400, p[:300] + q + p[300:]] + [say(60) for _ in range(9)] + [say(5) + p + say(5) for _ in range(20)]


@pytest.mark.parametrize("hot", [suffixes.HOT, 2_000])
def test_repeated_bytes_are_the_brute_force_ones(spark, repeats, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SHARD", 20_000)
    docs = table(spark, list(enumerate(repeats)), "doc_id long, text string, key string, mark string, own string, row string, data string, size string")
    out = suffixes.remove_repeats(docs, with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == dict(enumerate(without_repeats(repeats, 400)))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


def test_short_windows_equal_ids_and_empty_tables(spark):
    texts = ["abcabcabc", "xabcx", "none here", "none there", "cab", None, ""]
    docs = table(spark, [(k // 2 if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs, width=3).collect())
    assert got == Counter(without_repeats(texts, 3))
    assert suffixes.remove_repeats(docs.limit(0)).collect() == []


def test_a_text_beyond_a_piece(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh") for _ in range(suffixes.PIECE * 2 + 900))
    texts = [long, long[suffixes.PIECE - 500 : suffixes.PIECE + 700], long[suffixes.PIECE * 2 - 200 : suffixes.PIECE * 2 + 199]]
    out = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.remove_repeats(table(spark, list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: (1200, 1), 1: (1200, 1), 2: (0, 0)}


# ---------------------------------------------------------------- whitening


@pytest.mark.parametrize("scale", [64, 10**9])
def test_whitening_is_exact(spark, odd_vectors, scale):
    out = {}
    for r in whitening.whiten(table(spark, odd_vectors), most=4, scale=scale).collect():
        out.setdefault(r.vec_id, []).append(r)
    rows = [(i, [math.floor(scale * float(np.float32(c))) + 1_000_000 for c in v]) for i, v, _ in odd_vectors if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in rows}), object)
    n, total = len(fit), fit.sum(0)
    scatter = n * (fit.T @ fit) - np.outer(total, total)
    values, vectors = np.linalg.eigh(np.array([[int(c) / (n * n) for c in row] for row in scatter]))
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    assert Counter(i for i, _ in rows) == Counter({i: len(rs) for i, rs in out.items()})
    sign = None
    for i, x in rows:
        y = n * np.array(x, object) - total
        z = (y / n).astype(float) @ vectors / np.sqrt(values)
        deviation = int((y * y).sum())
        match = [r for r in out[i] if int(r.deviation_text) == deviation]
        assert match and match[0].n == n and match[0].deviation == (deviation if deviation < 2**63 else None)
        sign = np.sign(z * match[0].whitened) if sign is None else sign
        assert np.allclose(sign * match[0].whitened, z, atol=1e-8) and np.allclose(match[0].explained, values / (np.trace(scatter) / (n * n)).__float__())
        assert match[0].identity_error < 1e-10


def test_exact_sums_of_any_size():
    rng = random.Random(6)
    for bits in (4, 21, 40, 61):
        y = np.array([[rng.randrange(-(2**bits), 2**bits) for _ in range(3)] for _ in range(1200)], np.int64)
        sums, products = whitening.exact_sums(y)
        big = y.astype(object)
        assert (sums == big.sum(0)).all() and (products == big.T @ big).all()
    for x in (0, -1, 5, -(2**150) - 7, 2**170 + 3):
        assert sum(d << k * whitening.DIGIT for k, d in enumerate(whitening.digits(x))) == x


def test_flat_and_empty_whitening(spark):
    line = [(k, [float(k), 2.0 * k, 1.0], 0) for k in range(5)]
    long = whitening.long_form(whitening.whiten(table(spark, line)))
    rows = long.orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in rows] == [(i, c) for i in range(5) for c in (1, 2, 3)]
    assert all((r.whitened is None) == (r.component > 1) for r in rows) and rows[0].identity_error < 1e-10 and abs(rows[0].explained - 1) < 1e-12
    single = whitening.long_form(whitening.whiten(table(spark, [(1, [1.0, 2.0], 0)] * 3))).collect()
    assert len(single) == 6 and all((r.whitened, r.explained, r.deviation, r.n) == (None, None, 0, 1) for r in single)
    for some in ([], [(1, None, 1)]):
        assert whitening.long_form(whitening.whiten(table(spark, some))).collect() == []
    assert whitening.whiten(table(spark, [(1, [1e30, -1e30], 0), (2, [0.0, 1.0], 0)])).where(F.col("deviation").isNull()).count() == 2


# ---------------------------------------------------------------- near duplicates


@pytest.mark.parametrize("n", [1_999, 2_001, 3_000])
def test_links_of_a_bucket_are_those_of_its_texts(n):
    """By check bits, whatever the bucket's size: rows far apart in the fingerprint, and chains of rows that are near, too."""
    rng = np.random.default_rng(n)
    rows = np.zeros(n, simhash.Nearness(6, 16).kind)
    rows["fp"] = rng.permutation(np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    check = rng.integers(0, 2, (n // 5, 128)).repeat(5, 0)
    check = np.concatenate([check, rng.integers(0, 2, (n - len(check), 128))])
    for k in range(n):  # up to 12 of 128 bits each, so some pairs of a group of five are near and some are not
        flip = rng.choice(128, rng.integers(0, 13), replace=False)
        check[k, flip] ^= 1
    order = rng.permutation(n)
    rows["check"] = np.packbits(check[order].astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    near = simhash.Nearness(6, 16)

    def groups(links):
        root = list(range(n))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in links:
            root[find(x)] = find(y)
        return [find(x) for x in range(n)]

    bits = check[order].astype(np.int16)
    apart = bits @ (1 - bits.T) + (1 - bits) @ bits.T
    x, y = np.nonzero(np.triu(apart <= 16, 1))
    want = groups(zip(x.tolist(), y.tolist()))
    a, b = simhash.table_links(rows, np.uint64(0), near)
    got = groups(zip(a.tolist(), b.tolist()))
    assert len(set(want)) < n and (apart[a, b] <= 16).all()
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))
