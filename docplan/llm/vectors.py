"""Vectors of a table as numpy arrays, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Two columns, `id` in its own type and `vec` as doubles; whatever else the table has is not read."""
    return df.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("vec"))


def id_type(df: DataFrame, vec_id: str) -> str:
    return df.schema[vec_id].dataType.simpleString()


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values of a list column, each row's length (0 for null), and which rows are lists of finite numbers."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    fine = wrong[ends] == wrong[ends - lengths]
    return flat, lengths, fine & column.is_valid().to_numpy(zero_copy_only=False)


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows (as a mask) of `dims` finite components, and their vectors as one matrix."""
    flat, lengths, fine = whole(column)
    fine &= lengths == dims
    return fine, flat[np.repeat(fine, lengths)].reshape(-1, dims)
