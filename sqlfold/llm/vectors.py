"""Vector columns to blocks of doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def blocks(column: pa.Array):
    """Yield (positions, matrix) of the usable rows of a list column, one pair per dimension:
    rows that are null or hold null or non-finite components are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    sizes = np.asarray(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
    values = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    start = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for dim in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == dim)
        m = values[start[at][:, None] + np.arange(dim)[None, :]]
        good = np.isfinite(m).all(axis=1)
        yield at[good], m[good]
