"""SimHash fingerprints linked by covering locality-sensitive hashing.

For radius r every bit position gets a random vector of r + 1 bits. For each
non-zero vector v of r + 1 bits a mask keeps the positions whose vector has
an odd inner product with v. The positions in which two fingerprints differ, r at
most, span no more than r dimensions, so some v is orthogonal to all of them,
and its mask hides every difference: the pair collides in that table, always.

``near_duplicates`` links by the fingerprints alone. ``similar`` takes them for
the search only: each row carries check bits of its shingles through the
tables, and what collides is linked by the similarity that they show.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices
from .components import components, forest, spanning_forest
from .substrings import Stream, _rolled

BITS = 64
#: Fingerprints that one block of a table holds on average.
BLOCK = 30_000
#: Tables whose blocks one task takes together, so that it can leave out links that another table has shown.
TOGETHER = 8
#: Rows that a task holds before it deals them out.
DEALT = 200_000
#: A bucket of more rows is cut again, by parts of the bits that nearness compares; that loses no pair.
LARGE = 2_000
#: Check bits: one of each of so many min-hashes, in longs of 64.
CHECKS = 2
#: Standard errors by which check bits may fall short of the similarity asked for.
SLACK = 1.0
#: Bytes with A to Z in lower case; bytes of other letters stay.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, shingle: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; of a shorter text of the whole sequence; none without a word."""
    data = b" ".join((text or "").encode().translate(_LOWER).split())
    if not data:
        return np.empty(0, np.uint64)
    gap = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
    digest = xxhash.xxh64_intdigest
    if len(gap) < shingle:
        return np.array([digest(data, 42)], np.uint64)
    starts = [0, *(e + 1 for e in gap)]
    ends = [*gap[shingle - 1 :], len(data)]
    return np.array([digest(data[a:b], 42) for a, b in zip(starts, ends)], np.uint64)


def simhash(text: str | None, shingle: int = 4) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; zero without a word."""
    h = shingle_hashes(text, shingle)
    return _majority(h.astype("<u8", copy=False)) if len(h) else 0


def _majority(h: np.ndarray) -> int:
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fingerprints as longs. A narrow step; a null text is like an empty one."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            fps = np.array([simhash(t, shingle) for t in part.column(text_col).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(fps.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, fp long")


def _multipliers(n: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _check_bits(h: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """A bit of the smallest of the hashes under each multiplier, packed into longs."""
    least = np.full(len(multipliers), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h), 1024):
        part = h[at : at + 1024, None] * multipliers
        part ^= part >> np.uint64(32)  # order by all bits
        np.minimum(least, part.min(0), out=least)
    least = _mix(least) * np.uint64(0xBF58476D1CE4E5B9)
    return np.packbits((least >> np.uint64(63)).astype(np.uint8), bitorder="little").view("<u8")


def sketch(text: str | None, shingle: int = 5, multipliers: np.ndarray | None = None) -> tuple[int, list[int]]:
    """(fingerprint, check bits) of a text in lower case: SimHash of its set of words, one-bit min-hashes of its set of shingles.

    A text of fewer words than a shingle is one shingle; without a word everything is zero.
    """
    data = b" ".join((text or "").encode().translate(_LOWER).split())
    multipliers = _multipliers(64 * CHECKS) if multipliers is None else multipliers
    if not data:
        return 0, [0] * (len(multipliers) // 64)
    words = Stream([data]).hash
    grams = np.unique(_rolled(words, min(shingle, len(words))))
    words = _finish(np.unique(words))
    return _majority(words.astype("<u8", copy=False)), _check_bits(grams, multipliers).tolist()


def sketches(docs: DataFrame, keys: list[str], shingle: int = 5, text_col: str = "text") -> DataFrame:
    """(keys, fp, c0, c1, ...) of every whole text, as longs. A narrow step; a null text is like an empty one."""
    names = [f"c{k}" for k in range(CHECKS)]
    kinds = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys), "fp long", *(f"{n} long" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(64 * len(names))
        for batch in batches:
            found = [sketch(t.as_py(), shingle, multipliers) for t in batch.column(text_col)]
            rows = np.array([[fp, *c] for fp, c in found], np.uint64).reshape(-1, 1 + len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(np.ascontiguousarray(x)) for x in rows.T)], [*keys, "fp", *names])

    return docs.select(*keys, text_col).mapInArrow(run, kinds)


def masks(radius: int, seed: int = 7) -> np.ndarray:
    """The 2**(radius + 1) - 1 masks; the vectors of the bit positions are drawn without zero and as evenly as can be."""
    rng = np.random.default_rng(seed)
    m = 1 << (radius + 1)
    vectors = np.concatenate([rng.permutation(np.arange(1, m)) for _ in range(-(-BITS // (m - 1)))])[:BITS]
    vectors = rng.permutation(vectors)
    v = np.arange(1, m)
    odd = np.array([[bin(int(a) & int(b)).count("1") % 2 == 1 for b in vectors] for a in v])
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    return np.array([int(sum(int(w) for w in weights[row])) for row in odd], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _finish(h: np.ndarray) -> np.ndarray:
    """Mixed until every bit depends on every bit, as a majority of bits asks for."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class Nearness:
    """What links two rows that collide: bits of the fingerprint, or check bits, that differ."""

    def __init__(self, radius: int, apart: int | None = None):
        self.radius, self.apart = radius, apart
        self.kind = [("fp", "<u8")] if apart is None else [("fp", "<u8"), ("check", "<u8", (CHECKS,))]

    def __call__(self, rows: np.ndarray, one: np.ndarray) -> np.ndarray:
        if self.apart is None:
            return np.bitwise_count(rows["fp"] ^ one["fp"]) <= self.radius
        return np.bitwise_count(rows["check"] ^ one["check"]).sum(1, dtype=np.int16) <= self.apart

    def parts(self, rows: np.ndarray, mask: np.uint64) -> Iterator[np.ndarray]:
        """Keys of a bucket's rows: near ones have one of them in common."""
        if self.apart is None:
            hidden = [i for i in range(BITS) if not int(mask) >> i & 1]
            for k in range(self.radius + 1):
                yield rows["fp"] & np.uint64(sum(1 << i for i in hidden[k :: self.radius + 1]))
            return
        for k in range(self.apart + 1):
            key = np.zeros(len(rows), np.uint64)
            for c in range(CHECKS):
                own = sum(1 << i for i in range(64) if (64 * c + i) % (self.apart + 1) == k)
                key = _mix(key) + (rows["check"][:, c] & np.uint64(own))
            yield key

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """A number for each row: the fingerprint, or a hash of fingerprint and check bits (64 bits)."""
        out = rows["fp"].astype(np.uint64)
        if self.apart is not None:
            for k in range(CHECKS):
                out = _mix(_mix(out) * np.uint64(0xBF58476D1CE4E5B9) + rows["check"][:, k].astype(np.uint64))
        return out.view(np.int64)


def links_within(rows: np.ndarray, near: Nearness) -> tuple[list[int], list[int]]:
    """Links (places) among a bucket's rows: enough of the pairs that are near to connect whatever they connect.

    Rows near the pivot are linked to it and leave; each becomes a pivot
    later, so no chain is lost and no pair that is joined already is linked.
    """
    todo = np.arange(len(rows))
    left: list[int] = []
    right: list[int] = []
    queue: list[int] = []
    while len(todo) and (queue or len(todo) > 1):
        if queue:
            p = queue.pop()
        else:
            p, todo = int(todo[0]), todo[1:]
        close = near(rows[todo], rows[p])
        found = todo[close].tolist()
        if found:
            left += [p] * len(found)
            right += found
            queue += found
            todo = todo[~close]
    return left, right


def table_links(rows: np.ndarray, mask: np.uint64, near: Nearness) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) among rows whose fingerprints agree under the mask."""
    order = np.argsort(rows["fp"] & mask, kind="stable")
    own = rows[order]
    key = own["fp"] & mask
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    two = first[size == 2]
    close = near(own[two], own[two + 1])
    left, right = [two[close]], [two[close] + 1]
    for a, k in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        x, y = links_within(own[a : a + k], near) if k <= LARGE else _large(own[a : a + k], mask, near)
        left.append(np.array(x, np.int64) + a)
        right.append(np.array(y, np.int64) + a)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def _large(rows: np.ndarray, mask: np.uint64, near: Nearness) -> tuple[list[int], list[int]]:
    """The same for a large bucket, cut by parts of what nearness compares: of one part more than bits may differ, a near pair agrees in one at least."""
    left: list[int] = []
    right: list[int] = []
    for key in near.parts(rows, mask):
        order = np.argsort(key, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(own) > 1:
                x, y = links_within(rows[own], near)
                left += own[x].tolist()
                right += own[y].tolist()
    return left, right


def covering_links(rows: DataFrame, near: Nearness, count: int, seed: int = 7) -> DataFrame:
    """(src, dst) among distinct rows of fp, and c0, c1, ... if check bits decide: links that connect all that nearness connects.

    Rows are named by ``Nearness.ids``. Tasks deal out packed arrays by (table,
    part of the masked key): only fingerprint and check bits cross the exchange
    for each table, and no block grows with the input, as their number does.
    """
    table_masks = masks(near.radius, seed)
    parts = max(1, -(-count // BLOCK))
    names = ["fp"] if near.apart is None else ["fp", *(f"c{k}" for k in range(CHECKS))]
    kind = near.kind

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            own = np.empty(batch.num_rows, kind)
            columns = [batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names]
            own["fp"] = columns[0]
            if len(columns) > 1:
                own["check"] = np.stack(columns[1:], 1)
            held.append(own)
            if sum(map(len, held)) >= DEALT:
                yield from packed(np.concatenate(held))
                held = []
        if held:
            yield from packed(np.concatenate(held))

    def packed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t, mask in enumerate(table_masks):
            part = (_mix(rows["fp"] & mask) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            out = [(t // TOGETHER * parts + p, t, rows[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["block", "table", "data"])

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        by: dict[int, list[np.ndarray]] = {}
        for t, data in zip(table.column("table").to_pylist(), table.column("data")):
            by.setdefault(t, []).append(np.frombuffer(data.as_py(), kind))
        left, right = [], []
        for t, found in by.items():
            rows = np.concatenate(found)
            ids = near.ids(rows)
            order = np.argsort(ids, kind="stable")
            rows, ids = rows[order], ids[order]
            a, b = table_links(rows, table_masks[t], near)
            left.append(ids[a])
            right.append(ids[b])
        a, b = forest(np.concatenate(left), np.concatenate(right))
        return pa.table({"src": pa.array(a), "dst": pa.array(b)})

    blocks = rows.select(*names).mapInArrow(deal, "block long, table int, data binary")
    return blocks.groupBy("block").applyInArrow(meet, "src long, dst long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): rows connected by links between fingerprints of radius differing bits or fewer.

    component_id is the smallest id of a component. Null, empty and blank texts
    have fingerprint zero and link like any other; repeated rows each give a
    row; rows without an id have the component of rows with the same
    fingerprint, null if there are none; an empty table gives no rows; other
    columns are not read. Ids of any type that has an order will do. Equal
    fingerprints are one row before any link is sought, so a group of copies
    costs no more than one text.
    """
    marks = materialise(fingerprints(docs, shingle, id_col, text_col), "simhash")
    distinct = materialise(marks.groupBy("fp").agg(F.min(id_col).alias("node")), "simhash-distinct")
    links = spanning_forest(covering_links(distinct, Nearness(radius), distinct.count()))
    label = components(links).withColumnRenamed("node", "fp")  # only fingerprints with a link
    named = distinct.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = materialise(named.groupBy("component").agg(F.min("node").alias("component_id")), "simhash-components")
    named = named.join(least, "component").select("fp", "component_id")
    return marks.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def most_apart(similarity: float) -> int:
    """Check bits that may differ: the number expected at a Jaccard similarity, and SLACK standard errors."""
    n, p = 64 * CHECKS, (1 - similarity) / 2
    return round(n * p + SLACK * (n * p * (1 - p)) ** 0.5)


def similar(docs: DataFrame, keys: list[str], similarity: float = 0.8, radius: int = 6, shingle: int = 5, text_col: str = "text") -> DataFrame:
    """(keys, component) of every row: rows connected by links of similar texts; components are numbers without meaning.

    Two texts link if the SimHash fingerprints of their sets of words collide in a covering
    table, as all within the radius do, and if the check bits of their sets of
    shingles differ in no more bits than ``most_apart`` of the similarity. (In a bucket of over LARGE
    rows only pairs within the radius are sure to be seen.) Each distinct
    (fingerprint, check bits) is a row of its own in the search; its name is a
    64-bit hash. Null, empty and blank texts are alike; repeated rows each give
    a row; an empty table gives no rows.
    """
    names = ["fp", *(f"c{k}" for k in range(CHECKS))]
    near = Nearness(radius, most_apart(similarity))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.empty(batch.num_rows, near.kind)
            columns = [batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names]
            rows["fp"], rows["check"] = columns[0], np.stack(columns[1:], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.ids(rows))], [*batch.schema.names, "node"])

    own = sketches(docs, keys, shingle, text_col)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), "node long"])
    marks = materialise(own.mapInArrow(name, kinds), "simhash")
    distinct = materialise(marks.select(*names, "node").distinct(), "simhash-distinct")
    links = spanning_forest(covering_links(distinct, near, distinct.count()))
    label = components(links)
    return marks.join(label, "node", "left").select(*keys, F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates (see ``similar``), that of the smallest id; rows without an id come after all others.

    Of rows that share the id, the one of the smallest hash of the text stays,
    of repeated rows any one. Null, empty and blank texts are one group.
    """
    mark = F.xxhash64(F.col(text_col))
    marked = docs.select(F.col(id_col).alias("_id"), mark.alias("_mark"), F.col(text_col).alias("_text"))
    found = materialise(similar(marked, ["_id", "_mark"], similarity, shingle=shingle, text_col="_text"), "near-duplicates")
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_mark")).alias("best")
    best = materialise(found.groupBy("component").agg(best, F.count("*").alias("n")).select("best._id", "best._mark"), "kept")
    rows = found.join(best, found["_id"].eqNullSafe(best["_id"]) & (found["_mark"] == best["_mark"]), "left_semi")
    again = materialise(rows.groupBy("_id", "_mark").count().where("count > 1").select("_id", "_mark"), "kept-again")
    same = lambda own, other: own[id_col].eqNullSafe(other["_id"]) & (F.xxhash64(own[text_col]) == other["_mark"])
    kept = docs.join(best, same(docs, best), "left_semi")
    if again.isEmpty():
        return kept
    once = kept.join(again, same(kept, again), "left_anti")
    return once.unionByName(kept.join(again, same(kept, again), "left_semi").dropDuplicates([id_col, text_col]))
