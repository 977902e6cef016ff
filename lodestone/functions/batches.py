"""Arrow batches in bounded parts, so that what a task holds does not depend on how many rows a batch has."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_trim: list = []


def runs(sizes: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbours of at most ``most`` in all and ``rows`` in number; one that is larger stands alone."""
    end, lo = np.cumsum(sizes), 0
    while lo < len(end):
        hi = int(np.searchsorted(end, (end[lo - 1] if lo else 0) + most, "right"))
        hi = max(lo + 1, min(hi, lo + rows))
        yield lo, hi
        lo = hi


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of texts, or elements of lists; 0 for null."""
    of = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    return pc.fill_null(of(column), 0).to_numpy().astype(np.int64)


def parts(batch: pa.RecordBatch, column: str, most: int, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices with at most ``most`` bytes or elements in a column; freed memory goes back to the system after them."""
    for lo, hi in runs(lengths(batch.column(column)), most, rows):
        yield batch.slice(lo, hi - lo)
    release()


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if not _trim:
        _trim.append(getattr(ctypes.CDLL(None), "malloc_trim", None))
    if _trim[0] is not None:
        _trim[0](0)
