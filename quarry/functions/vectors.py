"""Functions over embeddings, accumulated in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column: pa.Array, ids: pa.Array | None = None, dimension: int | None = None) -> np.ndarray:
    """An array column as a matrix, without Python objects; a row that is null, holds a null or has another length than ``dimension`` (by default the first row's) raises by its id."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, dimension or 0))
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    dimension = int(lengths[0]) if dimension is None else dimension
    flat = column.flatten()
    if flat.null_count or (lengths != dimension).any() or dimension < 1:
        rows = column.to_pylist()
        at = next((k for k, v in enumerate(rows) if v is None or len(v) != dimension or None in v or not v), 0)
        name = ids[at].as_py() if ids is not None else f"in row {at}"
        raise ValueError(f"vector {name} is not one of {dimension} numbers: {'null' if rows[at] is None else f'{len(rows[at])} entries'}")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; zero vectors stay zero."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))
