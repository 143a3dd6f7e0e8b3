"""Hard negatives by one-dimensional distance keys.

A vector x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared
norm; an anchor q gets 0 there. Then |q - x|^2 = |q|^2 + M - 2 <q, x>, so the
highest inner products are the smallest distances. Each row is keyed by its
nearest pivot and the distance to it, cut into rings along the key, and stored
in cells of a ring, sorted by distance. All rows within r of an anchor have
keys within r of the anchor's own distance to the pivot: an anchor scans the
key intervals of a growing r, each round only the annuli that are new, until the distance that a
better row could still have is below r. Scores are integers and exact; distances only choose what to scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pack_bytes, unpack_bytes
from .vectors import floors, matrix, whole_vectors

#: Rows that a cell holds on average, anchors that meet a cell at once, anchors scored together.
CELL, ASKED, TOGETHER = 8_192, 1_024, 64
#: Pivots at most, rings of all pivots at most, and rows of the sample that pivots are chosen from.
PIVOTS, RINGS, SAMPLE = 64, 16_384, 4_096
#: Rows whose keys the first round covers, and the factor by which each further round widens.
FIRST, WIDER = 20_000, 16
#: No score is as high.
TOP = 1 << 62


def choose_pivots(x: np.ndarray, k: int) -> np.ndarray:
    """k centres of a sample: spread out first, then moved to the means of what is nearest."""
    if len(x) <= 1 or k <= 1:
        return x.mean(0, keepdims=True)
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    centres = x[chosen].copy()
    for _ in range(5):
        near = distances(x, centres).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


class Rings:
    """The directory: pivots, their rings' outer bounds, cells of each ring, and, once cells are stored, keys and rows of each ring."""

    def __init__(self, pivots: np.ndarray, largest: int):
        self.pivots, self.largest = pivots, largest
        self.first = np.zeros(len(pivots) + 1, np.int64)  # of a pivot, its first ring
        self.bounds: list[np.ndarray] = [np.zeros(0)] * len(pivots)
        self.cells = np.ones(len(pivots), np.int64)  # of a ring
        #: Scores and radii are rounded in doubles; radii are widened by this.
        self.slack = 1e-5 * math.sqrt(max(1, largest))

    def cut(self, quantiles: dict[int, list[float]]) -> None:
        self.bounds = [np.unique(quantiles.get(p) or []) for p in range(len(self.pivots))]
        self.first = np.concatenate([[0], np.cumsum([len(b) + 1 for b in self.bounds])])

    def of(self, pivot: np.ndarray, dist: np.ndarray) -> np.ndarray:
        ring = np.zeros(len(pivot), np.int64)
        for p in np.unique(pivot):
            ring[pivot == p] = self.first[p] + np.searchsorted(self.bounds[p], dist[pivot == p])
        return ring

    def fill(self, counts: dict[int, int]) -> None:
        """Cells by the rows of each ring: many equal vectors are one ring of many cells."""
        self.cells = np.array([max(1, -(-counts.get(r, 0) // CELL)) for r in range(self.first[-1])], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.cells)])  # of a ring, its first cell

    def stored(self, rows: list) -> None:
        """ring, lowest and highest key, rows: of the rings that have any."""
        self.ring = np.array([r.ring for r in rows], np.int64)
        self.low, self.high, self.rows = np.array([r.low for r in rows], float), np.array([r.high for r in rows], float), np.array([r.n for r in rows], np.int64)
        self.pivot = np.searchsorted(self.first, self.ring, "right") - 1

    def gaps(self, to_pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For anchors' distances to pivots: the smallest and the largest difference to each ring's keys."""
        d = to_pivot[:, self.pivot]
        return np.maximum(np.maximum(self.low - d, d - self.high), 0), np.maximum(abs(d - self.low), abs(self.high - d))


def aimed(batch: pa.RecordBatch, rings: Rings, k: int) -> list:
    """The next radius of each anchor, null if its rows are certified.

    A better row than the k-th found, or one that still belongs to the band
    above the lowest score, would be nearer than ``need``.
    """
    n2, done = np.array(batch.column("n2"), float), np.array(batch.column("done"))
    low, kth = batch.column("low").to_pylist(), batch.column("kth").to_pylist()
    near, _ = rings.gaps(matrix(batch.column("d"), len(rings.pivots)))
    order = near.argsort(1)
    covered = np.cumsum(rings.rows[order], 1)
    out = []
    for a in range(batch.num_rows):
        worst = min((max(x if x is not None else -TOP, y if y is not None else -TOP) for x, y in zip(low[a], kth[a] or [None] * len(low[a]))), default=TOP)
        need = math.inf if worst == -TOP else math.sqrt(max(0.0, n2[a] + rings.largest - 2 * worst)) + rings.slack
        if done[a] >= need or done[a] == math.inf:
            out.append(None)
            continue
        had = int(rings.rows[near[a] <= done[a]].sum()) if done[a] >= 0 else 0
        at = int(np.searchsorted(covered[a], max(FIRST, had * WIDER)))
        out.append(min(need, float(near[a, order[a, at]]) if at < len(order[a]) else math.inf))
    return out


def best_of(scores: np.ndarray, fine: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, column, place from 1) of the k highest fine scores of each line, ties by the smaller id."""
    if (fine.sum(1) > 4 * k).any():
        held = np.where(fine, scores, scores.dtype.type(-TOP if scores.dtype == np.int64 else -np.inf))
        fine = fine & (scores >= np.partition(held, -k, axis=1)[:, -k][:, None])
    line, column = np.nonzero(fine)
    order = np.lexsort((ids[column], -scores[line, column], line))
    line, column = line[order], column[order]
    place = np.arange(len(line)) - np.searchsorted(line, line) + 1
    return line[place <= k], column[place <= k], place[place <= k]


def index(rows: DataFrame, d: int) -> tuple[DataFrame, Rings]:
    """(cells, their directory) of rows (id, label, v, n2): every row is in one cell.

    Pivots are fitted on the SAMPLE rows of the smallest hashes; rings are
    quantiles of a pivot's distances, RINGS of them at most, and a ring of more
    rows than CELL has several cells, dealt by a hash. So the directory is bounded whatever the rows.
    """
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max("n2").alias("m")).first()
    n, largest = facts.n, facts.m or 0
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v", "n2").collect()
    points = np.array([[*r.v, math.sqrt(largest - r.n2)] for r in sample], float).reshape(-1, d + 1)
    rings = Rings(choose_pivots(points, min(PIVOTS, max(1, math.isqrt(n // CELL)))) if n else np.zeros((1, d + 1)), largest)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"), d)
                last = np.sqrt(np.maximum(largest - np.array(batch.column("n2"), float), 0))
                far = distances(np.hstack([v, last[:, None]]), rings.pivots)
                pivot = far.argmin(1)
                yield batch, v, pivot, far[np.arange(len(v)), pivot]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, pivot, far in keyed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(far)], ["pivot", "dist"])

    parts = max(1, min(RINGS // len(rings.pivots), -(-n // (len(rings.pivots) * CELL))))
    cuts = [k / parts for k in range(1, parts)] or [1.0]
    found = rows.mapInArrow(keys, "pivot int, dist double").groupBy("pivot").agg(F.percentile_approx("dist", cuts, 10 * parts + 100).alias("q")).collect() if parts > 1 else []
    rings.cut({r.pivot: r.q for r in found})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, pivot, far in keyed(batches):
            ring, n = np.unique(rings.of(pivot, far), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ring), pa.array(n)], ["ring", "n"])

    rings.fill({r.ring: r.n for r in rows.mapInArrow(counted, "ring long, n long").groupBy("ring").agg(F.sum("n").alias("n")).collect()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v, pivot, far in keyed(batches):
            ring = rings.of(pivot, far)
            cell = rings.begin[ring] + np.array(batch.column("salt")) % rings.cells[ring]
            v = np.ascontiguousarray(v, np.int32)
            columns = [batch.column("id"), batch.column("label"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(ring), pa.array(cell), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "v", "ring", "cell", "dist"])

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("dist", "ascending"), ("id", "ascending")])
        dist = rows.column("dist").to_numpy()
        data = b"".join([np.array(rows.column(c)).astype("<i8").tobytes() for c in ("id", "label")] + [dist.astype("<f8").tobytes()] + rows.column("v").to_pylist())
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "ring": rows.column("ring")[:1].combine_chunks(), "n": pa.array([len(dist)], pa.int64()), "low": dist[:1], "high": dist[-1:], "data": pa.array([pack_bytes(data)], pa.binary())})

    dealt = rows.withColumn("salt", F.xxhash64("id", "v") % 1_000_003 + 1_000_003).mapInArrow(deal, "id long, label long, v binary, ring long, cell long, dist double")
    cells = materialise(dealt.groupBy("cell").applyInArrow(pack, "cell long, ring long, n long, low double, high double, data binary"), "cells")
    rings.stored(cells.groupBy("ring").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect())
    return cells, rings


def search(anchors: DataFrame, cells: DataFrame, rings: Rings, d: int, k: int, same: bool) -> DataFrame:
    """(anchor, goal, rank, id, score): for each goal of each anchor the first k rows, by falling score and rising id.

    ``anchors`` has anchor (a number of its own), id, label, v, n2, and for each goal
    ``high``, the score that a row may have at most, and ``low``, the least, null if any will do. A
    row takes part if it has the anchor's label (``same``; rows of its id don't)
    or another one.
    """
    state = "anchor long, id long, label long, v array<int>, n2 long, high array<long>, low array<long>, kth array<long>, d array<double>, done double, next double"
    names = [c.split()[0] for c in state.split(", ")]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column("v"), d)
                far = distances(np.hstack([q, np.zeros((len(q), 1))]), rings.pivots)
                at = pa.array(np.arange(len(q) + 1, dtype=np.int32) * len(rings.pivots))
                columns = [batch.column(c) for c in names[:7]] + [pa.nulls(len(q), pa.list_(pa.int64())), pa.ListArray.from_arrays(at, pa.array(far.ravel())), pa.array(np.full(len(q), -1.0))]
                batch = pa.RecordBatch.from_arrays(columns, names[:-1])
                yield pa.RecordBatch.from_arrays([*columns, pa.array(aimed(batch, rings, k), pa.float64())], names)

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(aimed(batch, rings, k), pa.float64())], names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each cell with keys that are new in the interval."""
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                near, far = rings.gaps(matrix(part.column("d"), len(rings.pivots)))
                line, at = np.nonzero((near <= np.array(part.column("next"))[:, None]) & (far > np.array(part.column("done"))[:, None]))
                ring = rings.ring[at]
                many = rings.cells[ring]
                each = np.repeat(np.arange(len(ring)), many)
                cell = rings.begin[ring][each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
                to = matrix(part.column("d"), len(rings.pivots))[line[each], rings.pivot[at[each]]]
                for j in range(0, len(each), 4096):
                    took = part.take(pa.array(line[each[j : j + 4096]]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[j : j + 4096]), *(took.column(c) for c in asks), pa.array(to[j : j + 4096])], ["cell", *asks, "to"])

    asks = ["anchor", "id", "label", "v", "high", "low", "kth", "done", "next"]
    asked = "cell long, anchor long, id long, label long, v array<int>, high array<long>, low array<long>, kth array<long>, done double, next double, to double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, who in zip(batch.column("data"), batch.column("who")):
                data, n = unpack_bytes(data.as_buffer()), 0
                n = len(data) // (24 + 4 * d)
                ids, labels, keys = (np.frombuffer(data, t, n, 8 * n * i) for i, t in enumerate(("<i8", "<i8", "<f8")))
                v = np.frombuffer(data, "<i4", n * d, 24 * n).reshape(n, d)
                kind = np.float32 if rings.largest < 1 << 24 else np.float64 if rings.largest < 1 << 53 else np.int64  # inner products, sums on the way too, are exact
                v = v.astype(kind)
                for i in range(0, len(who), TOGETHER):
                    yield from met(who.values.slice(i, TOGETHER), ids, labels, keys, v, kind)

    def met(who: pa.StructArray, ids: np.ndarray, labels: np.ndarray, keys: np.ndarray, v: np.ndarray, kind: type) -> Iterator[pa.RecordBatch]:
        of = lambda c: np.array(who.field(c))
        to, done, reach = of("to"), of("done"), of("next")
        # Keys are sorted: only the interval that some anchor asks for is scored.
        a, b = np.searchsorted(keys, (to - reach).min() - rings.slack), np.searchsorted(keys, (to + reach).max() + rings.slack, "right")
        if a >= b:
            return
        q = matrix(who.field("v"), d).astype(kind)
        scores, gap = q @ v[a:b].T, abs(keys[a:b] - to[:, None])
        alike = labels[a:b] == of("label")[:, None]
        fine = (gap <= reach[:, None]) & (gap > done[:, None]) & (alike & (ids[a:b] != of("id")[:, None]) if same else ~alike)
        high, low, kth = (who.field(c).to_pylist() for c in ("high", "low", "kth"))
        number = of("anchor")
        for goal in range(max(map(len, high))):
            top = np.array([h[goal] if goal < len(h) else -TOP for h in high])
            least = np.array([max(x[goal] if goal < len(x) and x[goal] is not None else -TOP, y[goal] if y and y[goal] is not None else -TOP) for x, y in zip(low, kth)])
            # A float32 comparison with a bound beyond 2**24 would round; doubles hold both sides.
            wide = scores if kind == np.int64 else scores.astype(float)
            line, column, _ = best_of(wide, fine & (wide <= top[:, None]) & (wide >= least[:, None]), ids[a:b], k)
            if len(line):
                yield pa.RecordBatch.from_arrays([pa.array(number[line]), pa.array(np.full(len(line), goal, np.int32)), pa.array(ids[a:b][column]), pa.array(wide[line, column].astype(np.int64))], ["anchor", "goal", "id", "score"])

    order = Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), "id")
    fields = "anchor long, goal int, id long, score long"
    now = materialise(anchors.mapInArrow(begin, state), "aims")
    many = max(1, -(-now.count() // ASKED))
    best = None
    while not (open_ := now.where("next is not null")).isEmpty():
        who = open_.mapInArrow(spread, asked).groupBy("cell", (F.pmod(F.xxhash64("anchor"), F.lit(many))).alias("block")).agg(F.collect_list(F.struct(*asks, "to")).alias("who"))
        found = cells.select("cell", "data").join(who, "cell").select("data", "who").mapInArrow(scan, fields)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = materialise(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
        last = best.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("goal", "score"))).alias("last"))
        kth = F.transform(F.sequence(F.lit(0), F.size("high") - 1), lambda g: F.col("last")[g.cast("int")])
        after = open_.drop("kth", "done").join(last, "anchor", "left").select(*names[:7], kth.alias("kth"), "d", F.col("next").alias("done"), F.lit(None).cast("double").alias("next"))
        now = materialise(after.mapInArrow(onward, state), "aims")
    if best is None:
        return anchors.sparkSession.createDataFrame([], fields + ", rank int")
    return best


def mine(df: DataFrame, anchor: str, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    Entries become floor(scale * x); a score is an integer inner product.
    Anchors are the rows for which the SQL condition ``anchor`` holds. An
    anchor's positives are its first rows of the same label and another id;
    for each of them the first rows of another label are returned whose score
    is at most the positive's and at least share[0] / share[1] of it. Higher
    scores come first, ties by the smaller id.

    Rows without an id, a label (an integer) or a whole vector (see
    ``whole_vectors``) take no part. Rows alike in id, label and vector are one
    row; rows that share only the id are rows of their own, and as anchors
    each mines for itself. An anchor alone in its label has no positives, one whose
    positives have scores below 0 no negatives; neither gives rows, nor does
    an empty table. Floors are kept within bounds that let any score fit into
    64 bits (2**28 for 64 dimensions). Other columns are not read.
    """
    rows, d = whole_vectors(df.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()), vector_col)
    bound = min(2**31 - 1, math.isqrt((TOP - 1) // max(1, d)))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.transform(floors(vector_col, scale, bound), lambda c: c.cast("int")).alias("v"), F.expr(anchor).alias("asks"))
    rows = rows.groupBy("id", "label", "v").agg(F.max("asks").alias("asks"))
    rows = materialise(rows.withColumn("n2", F.aggregate("v", F.lit(0).cast("long"), lambda acc, c: acc + c.cast("long") * c)), "vectors")
    anchors = materialise(rows.where("asks").drop("asks").withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    cells, rings = index(rows.drop("asks"), d)
    any_score = anchors.withColumn("high", F.array(F.lit(TOP))).withColumn("low", F.array(F.lit(None).cast("long")))
    near = search(any_score, cells, rings, d, positives, True).where("score >= 0")
    # The least score of the band: share of a score that is not negative, rounded up.
    wanted = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), "score", F.expr(f"(cast(score as decimal(20, 0)) * {share[0]} + {share[1] - 1}) div {share[1]}").alias("least")))).alias("p"))
    asking = materialise(anchors.join(wanted, "anchor").withColumn("high", F.col("p.score")).withColumn("low", F.col("p.least")), "positives")
    found = search(asking.drop("p"), cells, rings, d, negatives, False)
    both = found.join(asking.select("anchor", F.col("id").alias("anchor_id"), "p"), "anchor").withColumn("g", F.col("p")[F.col("goal")])
    return both.select("anchor_id", F.col("g.positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("g.score").alias("positive_score"), F.col("score").alias("negative_score"))
