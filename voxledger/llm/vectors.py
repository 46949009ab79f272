"""What the vector operators share: which vectors count, their matrices, and the length that most of them have."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(vector: Column) -> Column:
    """Is a vector there, with entries, all of them finite numbers?"""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def common_length(vectors: DataFrame, name: str) -> int | None:
    """The length that most vectors have, of equal ones the greatest; None without vectors."""
    sizes = vectors.groupBy(F.size(name).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max_by("size", F.struct("n", "size"))).first()[0]


def matrix(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """The rows of a list column whose lists have one length and no nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the lists of each length."""
    sizes = np.diff(column.offsets.to_numpy())
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, matrix(column.take(pa.array(rows)))


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def with_fields(schema: T.StructType, keep: list[str], **more: T.DataType) -> T.StructType:
    """A schema of some columns of another and new ones."""
    return T.StructType([schema[c] for c in keep] + [T.StructField(k, v) for k, v in more.items()])
