"""What the vector operators share: which vectors take part, and one row for each distinct one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(rows: DataFrame, column: str) -> int:
    """The commonest length of a vector (the smaller, if tied); 0 where there is none."""
    found = rows.groupBy(F.size(column).alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    return found[0] if found else 0


def usable(column: str, dim: int) -> str:
    """Whether a vector takes part: of length dim, without null or non-finite components, not zero."""
    fine = f"not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    return f"coalesce(size({column}) = {dim}, false) and element_at(transform(array({column}), v -> {fine}), 1)"


def keyed(rows: DataFrame, id_column: str, column: str, dim: int) -> DataFrame:
    """id, k1 and k2 (128 bits of the vector; null if it takes no part), vector."""
    ok = F.col("id").isNotNull() & F.expr(usable("vector", dim))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("vector"))
    return rows.select("id", *[F.when(ok, F.xxhash64("vector", F.lit(seed))).alias(f"k{seed}") for seed in (1, 2)], "vector")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """[row, component] in double precision."""
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [a.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for a in arrays]
    return np.concatenate(flat).reshape(-1, dim) if flat else np.empty((0, dim))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very small or large components are lost
    return x / np.linalg.norm(x, axis=1, keepdims=True)
