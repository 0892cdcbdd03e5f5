"""Free space from allocation structures, per partition and combined per image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.extents import HALF_OPEN, merge_extents, rate_ppm

_RANGES = "image_id string, part_no int, start long, end long, source string"


def bitmap_to_ranges(words: DataFrame, source: str = "bitmap") -> DataFrame:
    """Free ranges of allocation bitmaps.

    ``words`` is ``(image_id, part_no, first_unit, n_units, bits, unit_bytes, base)``: a clear bit is a
    free unit, ``base`` is the absolute offset of unit 0. Units beyond the bits are unknown, hence not
    free. Runs are found inside each word, then runs that touch across words are merged.
    """

    def clear_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                used = np.unpackbits(np.frombuffer(bytes(row.bits), dtype=np.uint8), bitorder="little")[: int(row.n_units)]
                edges = np.flatnonzero(np.diff(np.concatenate(([1], used, [1])).astype(np.int8)))
                starts, ends = edges[0::2], edges[1::2]
                place = int(row.base) + int(row.first_unit) * int(row.unit_bytes)
                yield pd.DataFrame({
                    "image_id": row.image_id, "part_no": row.part_no, "start": place + starts * int(row.unit_bytes),
                    "end": place + ends * int(row.unit_bytes), "source": source,
                })

    found = words.select("image_id", "part_no", "first_unit", "n_units", "bits", "unit_bytes", "base").mapInPandas(clear_runs, _RANGES)
    return merge_extents(found, ["image_id", "part_no", "source"], HALF_OPEN)


def units_to_ranges(units: DataFrame, source: str = "table") -> DataFrame:
    """Free ranges of listed free units ``(image_id, part_no, unit, unit_bytes, base)``."""
    start = F.col("base") + F.col("unit") * F.col("unit_bytes")
    rows = units.select("image_id", "part_no", F.lit(source).alias("source"), start.alias("start"), (start + F.col("unit_bytes")).alias("end"))
    return merge_extents(rows, ["image_id", "part_no", "source"], HALF_OPEN)


def fat_free_units(links: DataFrame, structural: DataFrame | None = None) -> DataFrame:
    """Free clusters of a FAT ``(image_id, part_no, cluster, next_cluster, unit_bytes, base)``.

    An entry is free only when it is exactly 0; cluster 2 holds the root directory and never is.
    ``base`` is the offset of cluster 2. Structural clusters are taken out by an anti-join.
    """
    free = links.where((F.col("next_cluster") == 0) & (F.col("cluster") > 2))
    if structural is not None:
        free = free.join(structural, ["image_id", "part_no", "cluster"], "left_anti")
    return free.select("image_id", "part_no", (F.col("cluster") - 2).alias("unit"), "unit_bytes", "base")


def free_summary(ranges: DataFrame, partitions: DataFrame) -> DataFrame:
    """Per partition ``(image_id, part_no, start, end, reliable)``: free bytes, ranges, share and source."""
    sums = ranges.groupBy("image_id", "part_no").agg(
        F.sum(F.col("end") - F.col("start")).alias("free_bytes"), F.count("*").alias("range_count"), F.min("source").alias("source")
    )
    joined = partitions.join(sums, ["image_id", "part_no"], "left")
    free = F.coalesce("free_bytes", F.lit(0)).cast("long")
    return joined.select(
        "image_id", "part_no", "source", free.alias("free_bytes"), F.coalesce("range_count", F.lit(0)).cast("long").alias("range_count"),
        rate_ppm(free, F.col("end") - F.col("start")).alias("coverage_ppm"),
        (F.coalesce("reliable", F.lit(True)) & (free > 0)).alias("reliable"),
    )


def free_space(ranges: DataFrame, partitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(map, notes)``: the combined free ranges of images whose partitions all have a trustworthy map.

    An image with a raw or unreadable partition gets no ranges; its note says that the whole volume is
    to be searched.
    """
    summary = free_summary(ranges, partitions).join(partitions.select("image_id", "part_no", "fs_type"), ["image_id", "part_no"])
    usable = F.col("reliable") & (F.col("fs_type") != "raw")
    verdict = summary.groupBy("image_id").agg(
        F.bool_and(usable).alias("reliable"), F.sum("free_bytes").alias("free_bytes"),
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("source"),
    )
    good = verdict.where("reliable").select("image_id")
    combined = merge_extents(ranges.join(good, "image_id", "left_semi").select("image_id", "start", "end"), mode=HALF_OPEN)
    note = F.when(F.col("reliable"), F.lit("carving restricted to unallocated space")).otherwise(
        F.lit("no trustworthy allocation map for every partition; the whole volume is searched")
    )
    return combined, verdict.withColumn("note", note)
