"""Byte-extent algebra: merge, complement, containment and overlap over many images at once.

Recovered extents are inclusive and merge when they touch; free ranges are half-open. Every operator
works on ``(key columns, start, end)`` tables and spreads one image over position buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.asof import latest_at_or_before
from tracewell.plans.prefix import Running, bucket_of, running, union_all

#: Position bucket for the ordered scans. Sector-aligned starts put at most two million rows in one.
BUCKET_BYTES = 1 << 30

INCLUSIVE = "inclusive"
HALF_OPEN = "half_open"


def _distinct_starts(df: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    """Drop inverted or empty extents and keep the longest extent per start (combined map-side)."""
    valid = F.col("end") >= F.col("start") if mode == INCLUSIVE else F.col("end") > F.col("start")
    return (
        df.where(valid)
        .groupBy(*keys, F.col("start").cast("long").alias("start"))
        .agg(F.max(F.col("end").cast("long")).alias("end"))
    )


def merge_extents(
    df: DataFrame, keys: Sequence[str] = ("image_id",), mode: str = INCLUSIVE, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Merge overlapping or touching extents into maximal disjoint ones."""
    keys = list(keys)
    slack = 1 if mode == INCLUSIVE else 0
    rows = _distinct_starts(df, keys, mode)
    reach = running(
        rows, keys, bucket_of("start", bucket_bytes), ["start"], [Running("__reach", "max", F.col("end"))]
    )
    opens = F.col("__reach").isNull() | (F.col("start") > F.col("__reach") + slack)
    islands = running(
        reach.withColumn("__open", F.when(opens, F.col("start"))).drop("__reach"),
        keys,
        bucket_of("start", bucket_bytes),
        ["start"],
        [Running("__island", "last", F.col("__open"))],
        inclusive=True,
    )
    return (
        islands.groupBy(*keys, F.col("__island").alias("start"))
        .agg(F.max("end").alias("end"))
        .select(*keys, "start", "end")
    )


def complement(
    df: DataFrame,
    bounds: DataFrame,
    keys: Sequence[str] = ("image_id",),
    mode: str = INCLUSIVE,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Parts of each ``bounds`` row ``(keys, lo, hi)`` that no extent covers.

    There is one bounds row per key. Keys of ``bounds`` without extents come back whole. An extent without a start or an
    end covers nothing; clipping it as it is would stretch it to the bounds.
    """
    keys = list(keys)
    one = 1 if mode == INCLUSIVE else 0
    nonempty = F.col("hi") >= F.col("lo") if mode == INCLUSIVE else F.col("hi") > F.col("lo")
    limits = bounds.select(*keys, F.col("lo").cast("long"), F.col("hi").cast("long")).where(nonempty)
    placed = df.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    clipped = placed.join(limits, keys).select(
        *keys, F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"), "lo"
    )
    # A closing sentinel just past the range turns "gap before each extent" into the whole answer.
    past = F.col("hi") + one
    closing = limits.select(*keys, past.alias("start"), (past + 1 - one).alias("end"), "lo")
    kept = F.col("end") >= F.col("start") if mode == INCLUSIVE else F.col("end") > F.col("start")
    rows = (
        clipped.where(kept)
        .unionByName(closing)
        .groupBy(*keys, "start")
        .agg(F.max("end").alias("end"), F.max("lo").alias("lo"))
    )
    scanned = running(
        rows, keys, bucket_of("start", bucket_bytes), ["start"], [Running("__reach", "max", F.col("end"))]
    )
    gap_start = F.coalesce(F.col("__reach") + one, F.col("lo"))
    gap_end = F.col("start") - one
    real = gap_start <= gap_end if mode == INCLUSIVE else gap_start < gap_end
    return scanned.where(real).select(*keys, gap_start.alias("start"), gap_end.alias("end"))


def subtract_extents(
    df: DataFrame, minus: DataFrame, keys: Sequence[str] = ("image_id",), mode: str = INCLUSIVE, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """The parts of ``df`` that no extent of ``minus`` covers, as maximal disjoint extents.

    One sweep: every place where an extent begins or ends changes how many extents of either side lie over what follows.
    Running counts say where parts begin and end. Both sides may overlap themselves; keys of ``minus`` alone give nothing.
    """
    keys = list(keys)
    one = 1 if mode == INCLUSIVE else 0

    def edges(side: DataFrame, own: str, other: str) -> DataFrame:
        whole = side.select(*keys, F.col("start").cast("long"), (F.col("end") + one).cast("long").alias("end")).where("end > start")
        each = F.explode(F.array(*[F.struct(F.col(c).alias("start"), F.lit(d).cast("long").alias(own)) for c, d in (("start", 1), ("end", -1))]))
        return whole.select(*keys, each.alias("e")).select(*keys, "e.*").withColumn(other, F.lit(0).cast("long"))

    both = edges(df, "a", "b").unionByName(edges(minus, "b", "a"))
    steps = both.groupBy(*keys, "start").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a <> 0 OR b <> 0")
    sums = [Running("__a", "sum", F.col("a")), Running("__b", "sum", F.col("b"))]
    swept = running(steps, keys, bucket_of("start", bucket_bytes), ["start"], sums)
    left = lambda a, b: (a > 0) & (b <= 0)
    before = left(F.col("__a"), F.col("__b"))
    after = left(F.col("__a") + F.col("a"), F.col("__b") + F.col("b"))
    turns = swept.select(*keys, "start", F.when(after, F.col("start")).alias("__opens"), before.alias("__was"), after.alias("__is")).where("__was <> __is")
    paired = running(turns, keys, bucket_of("start", bucket_bytes), ["start"], [Running("__begin", "last", F.col("__opens"))])
    return paired.where("NOT __is").select(*keys, F.col("__begin").alias("start"), (F.col("start") - one).alias("end"))


def total_length(df: DataFrame, keys: Sequence[str] = ("image_id",), mode: str = INCLUSIVE) -> DataFrame:
    """Bytes covered per key, counting overlaps once."""
    size = F.col("end") - F.col("start") + (1 if mode == INCLUSIVE else 0)
    return merge_extents(df, keys, mode).groupBy(*keys).agg(F.sum(size).alias("total_bytes"))


def drop_contained(
    files: DataFrame,
    keys: Sequence[str] = ("image_id",),
    start: str = "offset",
    size: str = "size_bytes",
    bucket_bytes: int = BUCKET_BYTES,
    flag: str | None = None,
) -> DataFrame:
    """Drop files strictly smaller than, and wholly inside, another file of the same key.

    Files with equal extents both survive, and so do rows without a position or bytes. With ``flag``
    the rows are kept and the named boolean column tells which ones lie inside another.
    """
    keys = list(keys)
    stop = F.col(start) + F.col(size)
    placed = F.col(start).isNotNull() & (F.col(size) > 0)
    widest = (
        files.where(placed)
        .groupBy(*keys, F.col(start).alias("__s"))
        .agg(F.max(stop).alias("__e"))
    )
    reach = running(widest, keys, bucket_of("__s", bucket_bytes), ["__s"], [Running("__reach", "max", F.col("__e"))])
    probe = files.withColumn("__s", F.when(placed, F.col(start)))
    joined = probe.join(reach, [*keys, "__s"], "left")
    inside = F.coalesce(
        F.col("__s").isNotNull() & ((F.coalesce(F.col("__reach") >= stop, F.lit(False))) | (F.col("__e") > stop)),
        F.lit(False),
    )
    if flag:
        return joined.withColumn(flag, inside).select(*files.columns, flag)
    return joined.where(~inside).select(*files.columns)


def restrict_to_free(
    candidates: DataFrame,
    free: DataFrame,
    keys: Sequence[str] = ("image_id",),
    at: str = "offset",
    flag: str | None = None,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Keep candidates whose first byte lies in a half-open free range (or flag them)."""
    marked = latest_at_or_before(
        candidates, free, keys, F.col(at), "start", F.col("end"), "__free_to", width=bucket_bytes, kind="max"
    )
    inside = F.coalesce(F.col("__free_to") > F.col(at), F.lit(False))
    if flag:
        return marked.withColumn(flag, inside).drop("__free_to")
    return marked.where(inside).drop("__free_to")


def prune_blocks(
    blocks: DataFrame,
    free: DataFrame,
    keys: Sequence[str] = ("image_id",),
    offset: str = "offset",
    length: str = "length",
    flag: str | None = None,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Keep windows ``[offset, offset+length)`` that touch a half-open free range (or flag them).

    Among free ranges starting before the window's end, the furthest end decides.
    """
    stop = F.col(offset) + F.col(length)
    valid = free.where(F.col("end") > F.col("start"))
    marked = latest_at_or_before(
        blocks, valid, keys, stop, "start", F.col("end"), "__free_to", width=bucket_bytes, kind="max", strict=True
    )
    touches = F.coalesce((F.col("__free_to") > F.col(offset)) & (F.col(length) > 0), F.lit(False))
    if flag:
        return marked.withColumn(flag, touches).drop("__free_to")
    return marked.where(touches).drop("__free_to")


def skipped_bytes(blocks_flagged: DataFrame, keys: Sequence[str] = ("image_id",), flag: str = "touches_free") -> DataFrame:
    """Bytes of windows the search left out, per key."""
    return blocks_flagged.groupBy(*keys).agg(
        F.sum(F.when(F.col(flag), F.lit(0)).otherwise(F.col("length")).cast("long")).alias("allocated_bytes_skipped")
    )


def coverage(
    recovered: DataFrame, scanned: DataFrame, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """Recovered extents and the gaps left in the searched range ``scanned(keys, lo, hi)``."""
    merged = merge_extents(recovered, keys)
    gaps = complement(recovered, scanned, keys)
    return union_all(
        [merged.withColumn("kind", F.lit("recovered")), gaps.withColumn("kind", F.lit("gap"))]
    )


def partition_extents(
    partitions: DataFrame, images: DataFrame, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """Give each ``(start, fs_type)`` its end: the next partition's start, or the image size.

    A partition table holds at most 132 rows per image, so the per-image window stays tiny.
    """
    w = Window.partitionBy(*keys).orderBy("start", "fs_type")
    following = F.lead("start").over(w)
    return (
        partitions.join(images.select(*keys, "size"), list(keys))
        .withColumn("end", F.greatest(F.col("start"), F.coalesce(following, F.col("size"))))
        .withColumn("part_no", (F.row_number().over(w) - 1).cast("int"))
        .drop("size")
    )


def rate_ppm(part: Column, whole: Column) -> Column:
    """Integer parts per million, 0 when the denominator is not positive."""
    exact = part.cast("decimal(38,0)") * F.lit(1_000_000)
    return F.when(whole > 0, F.floor(exact / whole.cast("decimal(38,0)")).cast("long")).otherwise(F.lit(0).cast("long"))
