"""Arrow columns as numpy arrays, for the operators that work on whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, where each value begins and the last one ends) of texts or bytes; null ones are empty."""
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def steps(offsets: np.ndarray, most: int):
    """Ranges of values of about ``most`` bytes together; a longer value is a range of its own."""
    k, n = 0, len(offsets) - 1
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        yield k, end
        k = end


def grouped(values: list[pa.Array], names: list[str], rows: np.ndarray, n: int) -> pa.ListArray:
    """A list of structs for each of ``n`` rows, from values sorted by ``rows``."""
    ends = np.append(0, np.cumsum(np.bincount(rows, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, names))
