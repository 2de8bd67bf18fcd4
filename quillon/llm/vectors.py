"""Vectors of integers: what the operators on embeddings read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Squared lengths stay below this, so that inner products and squared distances fit a long.
LONGEST = 2.0**60


def integer_vectors(rows: DataFrame, length: int | None = None, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): each component x of `embedding` as the integer floor(scale * x), x as a double.

    Vectors take no part that are null, hold a null, NaN or infinite component, are of another length than is asked for, or are longer than any whose products fit a long.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.where(e.isNotNull() & finite & (F.lit(True) if length is None else F.size(e) == length))
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale))
    squares = F.aggregate(whole, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return kept.where(squares < LONGEST).select("vec_id", F.transform(whole, lambda x: x.cast("int")).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """The vectors of an Arrow column as rows of a matrix of longs, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # of no chunks
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(sizes.max(initial=0)), width or 0)
    if len(values) == len(sizes) * width:
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b, over the components that both have."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    size = lambda m: float(np.sqrt(np.square(m.astype(np.float64)).sum(axis=1)).max(initial=0.0))
    if size(a) * size(b) < 2.0**52:  # then no partial sum is too large for a double
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
