"""Texts of an Arrow batch as one byte buffer, and what numpy can say about its words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

U64 = np.uint64
#: Bytes of text that one step of a task works on; a longer text is a step of its own.
SLICE = 2 << 20
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: letters, digits and everything outside ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: Bytes outside [\x20\x09-\x0D].
SOLID = np.ones(256, dtype=bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins; null reads as the empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts come to about ``size`` bytes."""
    _, offsets = flat(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def release() -> None:
    """Give freed memory back at the end of a task: the worker lives on and serves other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_text(
    docs: DataFrame, function: Callable[[pa.Array], list[pa.Array]], fields: str, keep: list[str] | None = None, column: str = "text", size: int = SLICE,
    done: Callable[[], None] = release,
) -> DataFrame:
    """Columns ``fields``, which ``function`` makes of the texts, beside the columns to keep (all, unless named).

    New columns replace kept ones of the same name. ``done`` is called when a task ends.
    """
    new = StructType.fromDDL(fields).fields
    names = [f.name for f in new]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = StructType([*[StructField(c, docs.schema[c].dataType, True) for c in keep], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, size):
                made = function(part.column(column))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *made], [*keep, *names])
        done()

    return docs.select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes of a ``kind`` begin and end; none crosses from one text into the next."""
    solid = kind[data]
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(solid) + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) & ~cut[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~cut[1:]
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(_CHUNK, base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(_INVERSE)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of every span; spans are sorted by both ends."""
    power, inverse = _powers()
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + _CHUNK, "right"))
        if j <= i:  # one span longer than a chunk
            total = 0
            for k in range(a, int(ends[i]), _CHUNK):
                part = data[k : min(k + _CHUNK, int(ends[i]))].astype(U64) + U64(1)
                total += int((part * power[: len(part)]).sum()) * pow(_BASE, k - a, 1 << 64)
            out[i] = total & ((1 << 64) - 1)
            i += 1
            continue
        b = int(ends[j - 1])
        sums = np.zeros(b - a + 1, U64)
        np.cumsum((data[a:b].astype(U64) + U64(1)) * power[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        # The inverse power moves each span to the origin.
        out[i:j] = (sums[e] - sums[s]) * inverse[np.minimum(s, _CHUNK - 1)]
        i = j
    return mix(out)


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one text, and the place of the first word of each.

    ``counts``: words of each text.
    """
    total = len(hashes) - size + 1
    if total <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    # A window stays in its text if it begins at least ``size`` words before the text's end.
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))
    first = np.flatnonzero(left >= size)
    out = np.zeros(len(first), U64)
    for k in range(size):
        out += hashes[first + k] * U64(pow(_BASE, 3 * k + 2, 1 << 64))
    return mix(out + U64(size)), first


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of all runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
