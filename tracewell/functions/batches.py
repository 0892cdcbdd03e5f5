"""Arrow columns in small runs, so that what Python holds at once does not follow the size of a batch."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one step works on; a longer value is a step of its own.
STEP = 2 << 20


def runs(column: pa.Array, size: int = STEP) -> Iterator[tuple[int, int]]:
    """Where each run of rows begins and how many it has, of about ``size`` bytes; an empty column is one run."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, total = 0, len(column)
    while True:
        before = ends[at - 1] if at else 0
        stop = min(total, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield at, stop - at
        at = stop
        if at >= total:
            return


def release() -> None:
    """Give freed memory back at the end of a task: the worker lives on and serves others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
