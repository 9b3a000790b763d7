"""Arrow list columns as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrices(ids: pa.Array, vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows as float64) of the usable vectors, one pair for each length that occurs.

    Not usable: without id, null, empty, or with a null or non-finite component.
    """
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    known = ids.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
    starts = np.cumsum(lengths) - lengths
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(lengths[known]):
        at = np.flatnonzero(known & (lengths == n))
        rows = flat[starts[at][:, None] + np.arange(n)]
        good = np.isfinite(rows).all(axis=1)
        if good.any():
            out.append((numbers[at][good].astype(np.int64), rows[good]))
    return out
