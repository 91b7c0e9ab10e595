"""Vectors of array columns as rows of numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) for each length among the usable vectors.

    A vector is usable if it is not null or empty and holds finite values only.
    """
    column = column.cast(pa.large_list(pa.float64()))
    lens = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
    starts = column.offsets.to_numpy()[:-1]
    flat = column.values.to_numpy(zero_copy_only=False)  # null components become NaN
    out = []
    for n in np.unique(lens[lens > 0]).tolist():
        rows = np.flatnonzero(lens == n)
        x = flat[starts[rows][:, None] + np.arange(n)]
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            out.append((rows[fine], x[fine]))
    return out


def to_rows(x: np.ndarray) -> pa.Array:
    """Matrix rows as binary values."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def from_rows(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Binary values of one length as matrix rows."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), -1)
