"""Whitening of embeddings from an exactly summed scatter matrix.

Entries are integers. A shift is subtracted, each task sums entries and cross
products without rounding (limbs whose products a double holds exactly, added
up as Python integers), Spark adds the tasks' sums as digits in base 2**30,
and n times the cross products less the product of the sums is formed in
integers. Only that is turned into floats and decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import floors, matrix, whole_vectors

#: Bits of a limb, rows of a block: a block's products of limbs stay below 2**53.
LIMB, BLOCK = 21, 512
#: Bits of a digit that Spark sums, and digits of a number: the last one has the sign and all that is left.
DIGIT, DIGITS = 30, 6
#: Floors beyond this bound count as the bound, so that differences fit into 64 bits.
BOUND = 2.0**61
#: A direction has no variance if its eigenvalue is this share of the largest or less.
FLAT = 1e-13


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Matrices of at most LIMB bits whose sum, the k-th shifted by k * LIMB bits, is y."""
    if not y.size or max(int(y.max()), -int(y.min())) < 1 << (LIMB - 1):
        return [y]
    mask = (1 << LIMB) - 1
    return [y & mask, (y >> LIMB) & mask, y >> 2 * LIMB]


def exact_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the columns, cross products of the columns) as Python integers."""
    d = y.shape[1]
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    parts = limbs(y)
    for k, a in enumerate(parts):
        sums += a.sum(0).astype(object) << k * LIMB
        for m, b in enumerate(parts):
            total = np.zeros((d, d), np.int64)
            for i in range(0, len(y), BLOCK):
                total += (a[i : i + BLOCK].astype(float).T @ b[i : i + BLOCK].astype(float)).astype(np.int64)
            products += total.astype(object) << (k + m) * LIMB
    return sums, products


def digits(x: int) -> list[int]:
    return [(x >> k * DIGIT) & ((1 << DIGIT) - 1) for k in range(DIGITS - 1)] + [x >> (DIGITS - 1) * DIGIT]


def scatter(fit: DataFrame, d: int, shift: np.ndarray) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, n * cross products - product of the sums) of column x less the shift, all exact.

    d * (d + 3) / 2 + 1 numbers reach the driver, whatever the rows.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                s, p = exact_sums(matrix(batch.column(0), d) - shift)
                n, sums, products = n + batch.num_rows, sums + s, products + p
        if n:
            cells = [(-1, -1, n)] + [(i, -1, sums[i]) for i in range(d)] + [(i, j, products[i, j]) for i in range(d) for j in range(i + 1)]
            columns = [[c[0] for c in cells], [c[1] for c in cells], *zip(*(digits(int(c[2])) for c in cells))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", *names])

    names = [f"d{k}" for k in range(DIGITS)]
    parts = fit.select("x").mapInArrow(partial, ", ".join(f"{c} long" for c in ["i", "j", *names]))
    found = {(r.i, r.j): sum(int(r[c]) << k * DIGIT for k, c in enumerate(names)) for r in parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names)).collect()}
    n, sums = found.get((-1, -1), 0), [found.get((i, -1), 0) for i in range(d)]
    return n, sums, [[n * found.get((max(i, j), min(i, j)), 0) - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def components(n: int, c: list[list[int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, trace) of the covariance c / n**2."""
    e, w = np.linalg.eigh(np.array([[x / (n * n) for x in row] for row in c]))
    return e[::-1], w[:, ::-1], sum(c[i][i] for i in range(len(c))) / (n * n)


def whiten(df: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(id, n, deviation, deviation_text, whitened, explained, identity_error): one row for each row with a whole vector.

    An entry c becomes the integer floor(scale * c) + offset; the fit list has
    each distinct vector of integers once, n in all. ``whitened`` and
    ``explained`` are arrays over the first ``most`` components (or as many as
    there are dimensions) by falling eigenvalue. ``deviation`` is the exact sum
    of (n * x - S)**2 over dimensions, null where 64 bits don't hold it;
    ``deviation_text`` has it in decimals in any case. ``identity_error`` is
    measured over the fit list.

    Rows without a whole vector (see ``whole_vectors``) are left out; rows
    without an id stay; repeated rows stay and count once in the fit list, so
    a vector that a third of all rows share weighs as one. A direction without
    variance (a single vector, fewer vectors than components) has null in
    ``whitened`` and takes no part in ``identity_error``, which is 0 if there is
    no other; ``explained`` is null if nothing varies. An empty table gives no
    rows. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows, d = whole_vectors(df.select(id_col, vector_col), vector_col)
    rows = rows.select(F.col(f"`{id_col}`"), floors(vector_col, scale, BOUND, offset).alias("x"))
    fit = materialise(rows.select("x").distinct(), "whitening-fit")
    one = fit.first()
    shift = np.array(one.x if one else [0] * d, np.int64)
    n, sums, c = scatter(fit, d, shift)
    k = min(most, d)
    e, w, trace = components(n, c) if n else (np.zeros(d), np.zeros((d, d)), 0.0)
    e, w = e[:k], w[:, :k]
    live = e > FLAT * max(e[0], 0) if k else np.zeros(0, bool)
    rate = w / np.sqrt(np.where(live, e, 1.0))
    explained = (e / trace).tolist() if trace else [None] * k
    largest = max((abs(s) for s in sums), default=0)

    def centred(x: np.ndarray) -> np.ndarray:
        """n * x less the sums, exact."""
        y = x - shift
        wide = len(y) and n * max(abs(int(y.max())), abs(int(y.min()))) + largest >= 1 << 62
        return n * y.astype(object if wide else np.int64) - np.array(sums, object if wide else np.int64)

    def projected(y: np.ndarray) -> np.ndarray:
        return (y / n).astype(float) @ rate

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                z = projected(centred(matrix(batch.column(0), d)))
                total += np.vstack([z.T @ z, z.sum(0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "z"])

    error = 0.0
    if live.any():
        whole = np.zeros((k + 1, k))
        for r in fit.mapInArrow(moments, "i long, j long, z double").groupBy("i", "j").agg(F.sum("z").alias("z")).collect():
            whole[r.i, r.j] = r.z
        mean = whole[k] / n
        error = float(np.abs((whole[:k] / n - np.outer(mean, mean) - np.eye(k))[np.ix_(live, live)]).max())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            y = centred(matrix(batch.column(1), d))
            top = max(abs(int(y.max())), abs(int(y.min())))
            square = (y.astype(object if d * top * top >= 1 << 62 else np.int64) ** 2).sum(1)
            z, at = projected(y), pa.array(np.arange(m + 1, dtype=np.int32) * k)
            white = pa.ListArray.from_arrays(at, pa.array(z.ravel(), mask=np.tile(~live, m)))
            share = pa.ListArray.from_arrays(at, pa.array(explained * m, pa.float64()))
            exact = [int(s) for s in square]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n] * m, pa.int64()), pa.array([s if s < 1 << 63 else None for s in exact], pa.int64()), pa.array([str(s) for s in exact]), white, share, pa.array([error] * m)],
                [id_col, "n", "deviation", "deviation_text", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(finish, f"`{id_col}` {kind}, n long, deviation long, deviation_text string, whitened array<double>, explained array<double>, identity_error double")


def long_form(white: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each row and component, numbered from 1."""
    each = white.select(id_col, "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("component", "c"))
    return each.select(id_col, (F.col("component") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
