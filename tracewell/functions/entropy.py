"""Byte entropy of payload columns. Histograms are counted by NumPy inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.batches import release, runs

BLOCK = 1024
MIN_BLOCKS = 8
UNIFORM_STDEV_MAX = 0.08
UNIFORM_MEAN_MIN = 7.6

PROFILE = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("stdev", T.DoubleType())])

#: Bytes histogrammed at once, which bounds the scratch memory for a large payload.
_STEP_BLOCKS = 4096


def _entropies(counts: np.ndarray) -> np.ndarray:
    """Shannon entropy of each row of a count matrix."""
    total = counts.sum(axis=1, keepdims=True)
    share = counts / np.maximum(total, 1)
    return -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=1) + 0.0


def _entropy(data: bytes | None) -> float | None:
    if data is None:
        return None
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    return float(_entropies(counts[None, :])[0])


def _block_entropies(data: bytes) -> np.ndarray:
    whole = len(data) // BLOCK
    view = np.frombuffer(data, dtype=np.uint8, count=whole * BLOCK).reshape(whole, BLOCK)
    parts = []
    for at in range(0, whole, _STEP_BLOCKS):
        piece = view[at : at + _STEP_BLOCKS].astype(np.int64)
        piece += np.arange(len(piece), dtype=np.int64)[:, None] * 256
        parts.append(_entropies(np.bincount(piece.ravel(), minlength=len(piece) * 256).reshape(-1, 256)))
    return np.concatenate(parts)


@F.pandas_udf(T.DoubleType())
def shannon_entropy(payload: pd.Series) -> pd.Series:
    """Bits per byte, 0.0 for an empty payload."""
    return payload.map(_entropy, na_action="ignore").astype("Float64")


@F.pandas_udf(PROFILE)
def block_entropy_profile(payload: pd.Series) -> pd.DataFrame:
    """Mean and population deviation over the full 1 KiB blocks; null below eight blocks."""
    means, spreads = [], []
    for data in payload:
        if data is None or len(data) < BLOCK * MIN_BLOCKS:
            means.append(None)
            spreads.append(None)
            continue
        each = _block_entropies(data)
        means.append(float(each.mean()))
        spreads.append(float(each.std()))
    return pd.DataFrame({"mean": pd.array(means, dtype="Float64"), "stdev": pd.array(spreads, dtype="Float64")})


@F.arrow_udf(T.DoubleType())
def _mean_entropy(samples: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Mean entropy of the equal parts, as many as the second column says, that a value consists of."""
    for column, parts in samples:
        for at, n in runs(column):
            found = []
            for data, count in zip(column.slice(at, n).to_pylist(), parts.slice(at, n).to_pylist()):
                if data is None:
                    found.append(None)
                    continue
                size = len(data) // count
                found.append(sum(_entropy(data[i * size : (i + 1) * size]) for i in range(count)) / count)
            yield pa.array(found, pa.float64())
    release()


def sample_entropy(payload: Column) -> Column:
    """Whole-payload entropy up to 8 KiB, else the mean over 2 KiB at the start, middle and end.

    The samples are cut in the JVM, so at most 8 KiB of a payload crosses to Python, as one value of one column.
    """
    size = F.octet_length(payload)
    start = F.substring(payload, 1, 2048)
    middle = F.substring(payload, F.shiftright(size, 1) + 1, F.lit(2048))
    end = F.substring(payload, size - 2047, F.lit(2048))
    return _mean_entropy(F.when(size <= 8192, payload).when(size > 8192, F.concat(start, middle, end)), F.when(size > 8192, 3).otherwise(1))


def uniform_random_complaint(profile: Column) -> Column:
    """Why a profile looks like random bytes; null when it does not or is too small to judge."""
    mean, stdev = profile["mean"], profile["stdev"]
    text = F.format_string(
        "every %d-byte block sits at maximum entropy (mean %.3f, spread %.3f): this is random data, not a file",
        F.lit(BLOCK), mean, stdev,
    )
    return F.when((stdev < UNIFORM_STDEV_MAX) & (mean > UNIFORM_MEAN_MIN), text)


def entropy_band(entropy: Column) -> Column:
    return (
        F.when(entropy < 0.5, F.lit("constant"))
        .when(entropy < 3.0, F.lit("low"))
        .when(entropy < 6.0, F.lit("medium"))
        .otherwise(F.lit("high"))
    )
