"""What the operators share: Arrow tasks that hand memory back, batches cut by bytes, names that do not clash."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def release() -> None:
    """Give freed memory back to the system: workers are kept between tasks, side by side."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with ``release`` after its last batch."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def ends_of(column: pa.Array) -> np.ndarray:
    """Where the rows of a binary, string or list column begin and end in its values."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` bytes (or elements) in ``column``; a larger row stands alone."""
    ends, at = ends_of(batch.column(column)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def body_of(column: pa.Array) -> np.ndarray:
    """The bytes of all rows of a binary column, one after the other."""
    ends, body = ends_of(column), column.buffers()[2]
    return np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body else np.zeros(0, np.uint8)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores after it as long as a column of ``taken`` is called so."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name
