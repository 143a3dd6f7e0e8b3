"""Vectors of a table: those that are whole, as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_vectors(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(rows whose vector has an entry everywhere and no NaN or infinity, the number of dimensions).

    The dimensions are those of most of these rows, of two equally frequent
    numbers the greater; a vector of another length counts as one that lacks
    entries. Empty vectors have none; a table without vectors has 0 dimensions.
    """
    x = F.col(f"`{vector}`")
    fine = df.where(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    most = fine.groupBy(F.size(x).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = most.d if most else 0
    return fine.where(F.size(x) == d), d


def floors(vector: str, scale: int, bound: float, shift: int = 0) -> Column:
    """floor(scale * c) + shift of each entry c, taken as double; floors beyond the bound count as the bound."""
    return F.transform(F.col(f"`{vector}`"), lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(bound))), F.lit(-float(bound)))) + F.lit(shift).cast("long"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column of d entries a row as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
