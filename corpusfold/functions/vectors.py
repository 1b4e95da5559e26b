"""Vectors as plain columns, and Arrow batches of them as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows are made dense a slice at a time, so a task holds at most about this many bytes of them.
SLICE_BYTES = 32 << 20
# Less than this is not worth a task of its own: each task also makes and ships a set of sums.
TASK_BYTES = 8 << 20


def vector_columns(df: DataFrame, features: str = "features") -> list[Column]:
    """``v_idx array<int>`` (null when dense) and ``v_val array<double>`` of a vector or array column."""
    col = F.col(features)
    if isinstance(df.schema[features].dataType, VectorUDT):
        raw = F.unwrap_udt(col)
        return [raw["indices"].alias("v_idx"), raw["values"].alias("v_val")]
    return [F.lit(None).cast("array<int>").alias("v_idx"), col.cast("array<double>").alias("v_val")]


def vector_size(df: DataFrame, features: str = "features") -> int:
    """Number of dimensions, from the first row."""
    col = F.col(features)
    if isinstance(df.schema[features].dataType, VectorUDT):
        raw = F.unwrap_udt(col)
        col = F.coalesce(raw["size"], F.size(raw["values"]))
    else:
        col = F.size(col)
    return df.filter(F.col(features).isNotNull()).select(col).first()[0]


def pack(points: DataFrame, dim: int) -> DataFrame:
    """Put small tables of vectors into fewer tasks; large ones keep the splits of their files."""
    return points.coalesce(max(1, -(-points.count() * dim * 8 // TASK_BYTES)))


def _dense(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    idx, val = batch.column("v_idx"), batch.column("v_val")
    n, absent = batch.num_rows, idx.null_count
    if absent == n:
        return val.flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
    out = np.zeros((n, dim))
    sparse = pc.is_valid(idx)
    if absent:
        whole = pc.filter(val, pc.invert(sparse))
        out[~sparse.to_numpy(zero_copy_only=False)] = (
            whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        idx, val = pc.filter(idx, sparse), pc.filter(val, sparse)
    rows = np.repeat(np.flatnonzero(sparse.to_numpy(zero_copy_only=False)),
                     pc.list_value_length(val).to_numpy(zero_copy_only=False))
    out[rows, idx.flatten().to_numpy(zero_copy_only=False)] = val.flatten().to_numpy(zero_copy_only=False)
    return out


def dense_slices(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batch cut into slices, each with its rows as a dense matrix."""
    step = max(1, SLICE_BYTES // (8 * dim))
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        yield part, _dense(part, dim)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of every row of ``x`` to every row of ``c``."""
    d = x @ (-2.0 * c.T)
    d += (x * x).sum(1)[:, None]
    d += (c * c).sum(1)
    return np.maximum(d, 0.0, out=d)


def list_array(rows: np.ndarray) -> pa.ListArray:
    """A matrix as an Arrow array with one list per row."""
    n, dim = rows.shape
    ends = np.arange(0, n * dim + 1, max(dim, 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))


def list_matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
