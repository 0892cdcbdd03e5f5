"""Sampled verification of a medium: offsets, verdicts, and what the sample is worth."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.entropy import shannon_entropy

METHOD = "one-sided Clopper-Pearson exact upper bound"
CLOSED_FORM = METHOD + ", k=0 closed form"

_TINY = 1e-300


def _lower_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, all rows at once."""
    # The fraction converges fast below the mean; above it, the mirrored one does.
    mirrored = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(mirrored, b, a), np.where(mirrored, a, b), np.where(mirrored, 1 - x, x)
    log_gamma = np.frompyfunc(math.lgamma, 1, 1)
    scale = (log_gamma(a + b) - log_gamma(a) - log_gamma(b)).astype(float)
    front = np.exp(scale + p * np.log(np.maximum(y, _TINY)) + q * np.log1p(-np.minimum(y, 1 - 1e-16))) / p

    def solid(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < _TINY, _TINY, v)

    upper = np.ones_like(y)
    lower = 1 / solid(1 - (p + q) * y / (p + 1))
    value, m, moving = lower.copy(), 0, True
    while moving:
        m += 1
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        before = value
        for term in (even, odd):
            lower = 1 / solid(1 + term * lower)
            upper = solid(1 + term / upper)
            value = value * lower * upper
        moving = bool((np.abs(value - before) > 1e-15 * np.abs(value)).any())
    tail = front * value
    return np.where(mirrored, 1 - tail, tail)


def exact_upper_bound(k: np.ndarray, n: np.ndarray, confidence: float) -> np.ndarray:
    """The share at which ``k`` or fewer of ``n`` are as rare as ``1 - confidence``, by bisection."""
    a, b = np.asarray(k, dtype=float) + 1, np.asarray(n, dtype=float) - k
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(54):
        middle = (low + high) / 2
        under = _lower_tail(a, b, middle) < confidence
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def _exact_bound(k: pd.Series, n: pd.Series, confidence: pd.Series) -> pd.Series:
    bound = pd.Series(np.nan, index=k.index)
    asked = k.notna() & n.notna() & (k > 0) & (k < n)
    if asked.any():
        # Few counts differ, so each is worked out once a batch.
        pairs, place = np.unique(np.stack([k[asked].to_numpy(np.int64), n[asked].to_numpy(np.int64)]), axis=1, return_inverse=True)
        bound[asked] = exact_upper_bound(pairs[0], pairs[1], float(confidence.iloc[0]))[place.ravel()]
    return bound


def residual_bound(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """One-sided exact upper bound on the fraction still matching, 1 without a sample or where all match."""
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence must be in (0, 1)")
    return (
        F.when((n <= 0) | (k >= n), F.lit(1.0))
        .when(k == 0, F.lit(1.0) - F.pow(F.lit(1.0 - confidence), F.lit(1.0) / n.cast("double")))
        .otherwise(_exact_bound(k.cast("long"), n.cast("long"), F.lit(confidence)))
    )


def bound_method(k: Column) -> Column:
    return F.when(k == 0, F.lit(CLOSED_FORM)).otherwise(F.lit(METHOD))


def bound_ppm(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """The bound in integer parts per million, rounded half to even like the signed document."""
    return F.bround(residual_bound(k, n, confidence) * 1_000_000, 0).cast("long")


def required_sample_size(confidence: Column, fraction: Column) -> Column:
    """Samples a clean read-back needs to bound the residue at ``fraction``."""
    return F.ceil(F.log(1 - confidence) / F.log(1 - fraction)).cast("long")


def _mixed(value: np.ndarray, key: np.ndarray, turn: int) -> np.ndarray:
    """A keyed 64-bit mixer by two multiplications with odd constants."""
    z = value * np.uint64(0x9E3779B97F4A7C15) + key + np.uint64(turn)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, turns: int = 6) -> np.ndarray:
    """A keyed permutation of ``0 .. size-1``: a balanced Feistel network on the next even number of bits.

    An image outside the range is sent through again until it lies inside, which keeps the map one to one.
    """
    bits = np.frompyfunc(lambda n: (max(int(n) - 1, 1).bit_length() + 1) // 2, 1, 1)(size).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    size, key = size.astype(np.uint64), key.astype(np.int64).view(np.uint64)
    image, out = index.astype(np.uint64), np.ones(len(index), dtype=bool)
    while out.any():
        left, right, k = image[out] >> bits[out], image[out] & mask[out], key[out]
        for turn in range(turns):
            left, right = right, left ^ (_mixed(right, k, turn) & mask[out])
        image[out] = (left << bits[out]) | right
        out = image >= size
    return image.astype(np.int64)


@F.pandas_udf(T.LongType())
def _permuted(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()))


def sample_offsets(
    media: DataFrame, count: int, seed: int = 0, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """``count`` distinct sector-aligned offsets per medium ``(keys, capacity, sector_size)``, seeded; all, if it has no more.

    The first images of a keyed permutation of the medium's sectors are taken, at any size, so none is drawn twice.
    A medium shorter than one sector is sampled at 0; one without a positive capacity and sector size is left out.
    """
    keys = list(keys)
    sized = media.where((F.col("capacity") > 0) & (F.col("sector_size") > 0)).select(
        *keys, "sector_size", F.greatest(F.lit(1), F.expr("capacity div sector_size")).cast("long").alias("__total")
    ).distinct()
    key = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    drawn = sized.withColumn("__i", F.explode(F.expr(f"sequence(0L, least({int(count)}L, __total) - 1)"))) if count > 0 else sized.limit(0).withColumn("__i", F.lit(0).cast("long"))
    return drawn.select(*keys, (_permuted(F.col("__i"), F.col("__total"), key) * F.col("sector_size")).alias("offset"))


def diff_samples(samples: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Share of offsets readable on both sides whose bytes changed; 90 % passes, none readable passes."""
    both = F.col("pre").isNotNull() & F.col("post").isNotNull()
    changed = F.count_if(both & (F.col("pre") != F.col("post")))
    pairs = F.count_if(both)
    share = F.when(pairs > 0, changed / pairs).otherwise(F.lit(1.0))
    return samples.groupBy(*keys).agg(
        pairs.alias("pairs"), changed.alias("changed"), share.alias("changed_share"), (share >= 0.90).alias("passed")
    )


def _filled(data: Column, byte: str) -> Column:
    """Whether every byte of a payload equals one hex byte."""
    return F.hex(data) == F.repeat(F.lit(byte), F.octet_length(data))


def verify_samples(samples: DataFrame, keys: Sequence[str] = ("image_id",), sample_bytes: int = 4096) -> DataFrame:
    """Verdict per medium over ``(keys, pattern, capacity, sector_size, pre, post, error)`` samples.

    Any read error or an empty read-back fails. The residual bound is taken over the samples that do
    not match, so a failing medium is bounded by what was actually seen.
    """
    keys = list(keys)
    readable = F.col("post").isNotNull() & F.col("error").isNull()
    zero, ones = _filled(F.col("post"), "00"), _filled(F.col("post"), "FF")
    measured = samples.select(
        *keys, "pattern", "capacity", "sector_size", readable.alias("ok"), F.col("error").isNotNull().alias("failed"),
        F.col("pre").isNotNull().alias("has_pre"), (F.col("pre") != F.col("post")).alias("changed"),
        (readable & zero).alias("zero"), (readable & ones).alias("ones"),
        shannon_entropy(F.when(readable & (F.col("pattern") == "random") & (F.octet_length("post") > 0), F.col("post"))).alias("entropy"),
    )
    ok = F.col("ok")
    agg = measured.groupBy(*keys, "pattern").agg(
        F.max("capacity").alias("capacity"),
        F.max("sector_size").alias("sector_size"),
        F.count_if(ok).alias("samples_checked"),
        F.count_if("failed").alias("samples_failed"),
        F.count_if("zero").alias("n_zero"),
        F.count_if("ones").alias("n_ones"),
        F.count_if(F.col("has_pre")).alias("n_pre"),
        F.count_if(ok & F.col("has_pre")).alias("n_pairs"),
        F.count_if(ok & F.col("has_pre") & F.col("changed")).alias("n_changed"),
        F.avg("entropy").alias("average_entropy"),
    )
    n = F.col("samples_checked")
    expected = min(7.0, math.log2(sample_bytes) * 0.85 if sample_bytes > 1 else 0.0)
    non_zero = 1 - F.col("n_zero") / n
    pairs_share = F.when(F.col("n_pairs") > 0, F.col("n_changed") / F.col("n_pairs")).otherwise(F.lit(1.0))
    matched = (
        F.when(F.col("pattern") == "zero", F.col("n_zero") == n)
        .when(F.col("n_pre") > 0, pairs_share >= 0.90)
        .when(F.col("pattern").isin("firmware", "key_destruction"), (F.col("n_zero") == n) | (F.col("n_ones") == n))
        .otherwise((non_zero >= 0.90) & (F.coalesce("average_entropy", F.lit(0.0)) >= expected))
    )
    verdict = (n > 0) & (F.col("samples_failed") == 0) & matched
    misses = (
        F.when(verdict, F.lit(0))
        .when(F.col("pattern") == "zero", F.greatest(F.lit(1), n - F.col("n_zero")))
        .when(F.col("n_pre") > 0, F.greatest(F.lit(1), F.col("n_pairs") - F.col("n_changed")))
        .when(F.col("pattern").isin("firmware", "key_destruction"), F.greatest(F.lit(1), n - F.greatest("n_zero", "n_ones")))
        .otherwise(F.greatest(F.lit(1), F.col("n_zero")))
    )
    population = F.greatest(n, F.expr("capacity div greatest(1, sector_size)"))
    return agg.select(
        *keys,
        "pattern",
        "samples_checked",
        "samples_failed",
        F.when((F.col("pattern") == "random") & (F.col("n_pre") == 0), F.round("average_entropy", 3)).alias("average_entropy"),
        verdict.alias("all_samples_match"),
        population.cast("long").alias("population_blocks"),
        bound_ppm(misses.cast("long"), n).alias("residual_ppm"),
        bound_method(misses).alias("bound_method"),
    )


def bad_sector_rollup(bad: DataFrame, keys: Sequence[str] = ("image_id",), sector: int = 512) -> DataFrame:
    """Unreadable bytes, sectors and ranges per image, overlaps counted once."""
    from tracewell.operators.extents import HALF_OPEN, merge_extents

    spans = bad.select(*keys, F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"))
    merged = merge_extents(spans, keys, HALF_OPEN)
    size = F.sum(F.col("end") - F.col("start"))
    return merged.groupBy(*keys).agg(
        F.count("*").alias("bad_ranges"), size.alias("bad_bytes"), F.ceil(size / sector).cast("long").alias("bad_sectors")
    )




def verify_medium(
    images: DataFrame, pattern: str, count: int = 64, sample_bytes: int = 4096, seed: int = 0, pre: DataFrame | None = None
) -> DataFrame:
    """Sample, read back and judge media ``(image_id, path, size, sector_size)`` erased with one pattern.

    ``pre`` holds samples ``(image_id, offset, pre)`` taken before; their offsets are then read again.
    """
    from tracewell.sources.images import read_ranges

    media = images.withColumn("capacity", F.col("size"))
    offsets = sample_offsets(media, count, seed) if pre is None else pre.select("image_id", "offset")
    ranges = offsets.join(media, "image_id").withColumn(
        "length", F.least(F.lit(sample_bytes).cast("long"), F.col("capacity") - F.col("offset"))
    )
    read = read_ranges(ranges, "post", error="error").withColumn("pattern", F.lit(pattern))
    if pre is None:
        read = read.withColumn("pre", F.lit(None).cast("binary"))
    else:
        read = read.join(pre, ["image_id", "offset"], "left")
    return verify_samples(read, sample_bytes=sample_bytes)
