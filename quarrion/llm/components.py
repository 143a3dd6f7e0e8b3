"""Connected components of a graph of links, by rounds of large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Links that one task of spanning_forest reads.
TASK_LINKS = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between long nodes those that connect all that the links connect, without a circle."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    node, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(node)))
    keep = []
    for k, (x, y) in enumerate(zip(code[: len(a)].tolist(), code[len(a) :].tolist())):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def spanning_forest(links: DataFrame) -> DataFrame:
    """Links (src, dst) of long nodes without those that close a circle inside a task's share.

    What is connected stays connected. Shares are of bounded size and merged
    partitions of a written table, so there is no exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("src").to_numpy(), b.column("dst").to_numpy()) for b in batches if b.num_rows]
        if parts:
            a, b = forest(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

    held = materialise(links.select("src", "dst"), "links")
    return held.coalesce(max(1, -(-held.count() // TASK_LINKS))).mapInArrow(run, "src long, dst long")


def components(links: DataFrame) -> DataFrame:
    """(node, component), component being the smallest node, for every node of a link (src, dst).

    Each round links the larger neighbours of a node to its smallest one
    (large-star), then all smaller neighbours and itself (small-star); the
    number of rounds grows with the logarithm of the longest chain. A round is
    written to the shared folder, so its lineage is cut and it survives the
    loss of an executor. Minima are aggregated before the exchange and come
    back by a join that adaptive execution can split, so a hub is no hot spot.
    """
    both = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    edges = materialise(both, "edges")
    before = None
    while True:
        edges = materialise(_small(_large(edges)), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large(edges: DataFrame) -> DataFrame:
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
