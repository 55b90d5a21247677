"""What the operators on vectors share: which rows take part, and bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of the rows that take part: an id, and a vector without null or non-finite components that isn't zero."""
    v = F.col(vector_col).cast("array<float>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where("id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("vector", lambda x: x != 0))


def lengths(rows: DataFrame) -> list[tuple[int, int]]:
    """The lengths that vectors have, and how many have each."""
    return sorted((r["d"], r["count"]) for r in rows.groupBy(F.size("vector").alias("d")).count().collect())


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors as a matrix, those with the smallest hash of their id."""
    picked = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(most).collect()
    return np.array([r["vector"] for r in picked], np.float64)


def matrix(column, dimension: int) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as a float64 matrix."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
