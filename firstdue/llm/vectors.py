"""Embeddings as exact whole numbers, and batches of them as matrices."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship these functions with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Components stay below this, so that squared distances of 64 dimensions fit a long.
LIMIT = 2**25


def usable(vector: Column) -> Column:
    """Is the vector there, and are all its entries finite numbers?"""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & finite


def whole_numbers(vector: Column, scale: int) -> Column:
    """``floor(scale * c)`` of every entry, as int.

    Embeddings have entries around one. One of ``LIMIT`` or more after scaling fails with a
    message, because sums of squares would no longer be exact.
    """
    def whole(c: Column) -> Column:
        x = F.floor(c.cast("double") * scale).cast("int")
        message = f"vector entries times {scale} must stay below {LIMIT}"
        return F.when(F.abs(c.cast("double") * scale) < LIMIT, x).otherwise(F.raise_error(F.lit(message)))

    return F.transform(vector, whole)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A batch's list column as rows of ``dims`` numbers; shorter lists end in zeros.

    Whole numbers come as long, for exact products.
    """
    flat = column.flatten().to_numpy()
    if flat.dtype.kind == "i":
        flat = flat.astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def list_column(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))
