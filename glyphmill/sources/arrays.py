"""Dense and sparse matrices as Arrow columns and files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.network import Sparse


def to_fixed_lists(x: np.ndarray) -> pa.FixedSizeListArray:
    """Rows of a matrix as lists of one size, with the matrix's type."""
    if x.ndim != 2:
        raise ValueError("not a matrix")
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).reshape(-1)), x.shape[1])


def from_lists(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A matrix of lists that have one size, chunked or not. Lists of different sizes are a ``ValueError``."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for c in chunks:
        if c.null_count:
            raise ValueError("a null has no row in a matrix")
        if pa.types.is_fixed_size_list(c.type):
            width = c.type.list_size
        else:
            sizes = np.unique(np.diff(c.offsets.to_numpy()))
            if len(sizes) > 1:
                raise ValueError("lists differ in size")
            width = int(sizes[0]) if len(sizes) else 0
        out.append(c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), width))
    return np.concatenate(out) if out else np.zeros((0, 0))


def sparse_to_batch(x: Sparse) -> pa.RecordBatch:
    """``indices``, ``values`` and the constant ``indices_range``."""
    offsets = pa.array(x.bounds.astype(np.int64))
    lists = lambda v: pa.LargeListArray.from_arrays(offsets, pa.array(v))
    return pa.RecordBatch.from_arrays([lists(x.columns.astype(np.int32)), lists(x.values), pa.array(np.full(x.rows, x.width, np.int32))], names=["indices", "values", "indices_range"])


def sparse_from_batch(batch: pa.RecordBatch) -> Sparse:
    a, b, width = batch.column("indices"), batch.column("values"), batch.column("indices_range").unique()
    if not a.offsets.equals(b.offsets):
        raise ValueError("indices and values differ in length")
    if len(width) != 1:
        raise ValueError("rows don't share one width")
    at = a.offsets.to_numpy().astype(np.int64)
    return Sparse(at - at[0], a.flatten().to_numpy().astype(np.int64), b.flatten().to_numpy(), width[0].as_py())


def save_sparse(path: str, x: Sparse) -> None:
    np.savez_compressed(path, bounds=x.bounds, columns=x.columns, values=x.values, shape=np.array([x.rows, x.width]))


def load_sparse(path: str) -> Sparse:
    """What ``save_sparse`` wrote, or a file in the common layout ``data``, ``indices``, ``indptr``, ``shape``."""
    with np.load(path, allow_pickle=False) as f:
        if "indptr" in f:
            return Sparse(f["indptr"].astype(np.int64), f["indices"].astype(np.int64), f["data"], int(f["shape"][1]))
        return Sparse(f["bounds"], f["columns"], f["values"], int(f["shape"][1]))


def pack_map(mapping: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a map, side by side."""
    return np.fromiter(mapping.keys(), np.int64, len(mapping)), np.fromiter(mapping.values(), np.int64, len(mapping))


def unpack_map(keys: np.ndarray, values: np.ndarray) -> dict[int, int]:
    if len(keys) != len(values):
        raise ValueError("keys and values differ in length")
    return dict(zip(keys.tolist(), values.tolist(), strict=True))


def map_arrays(m: Column) -> tuple[Column, Column]:
    return F.map_keys(m), F.map_values(m)
