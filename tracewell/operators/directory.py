"""FAT directory slots: long-name fragments paired with the short entry they belong to."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.bits import has_bits, short_name_checksum, uint

# Slot markers, attribute bits and the verification levels of a long name.
DELETED, LFN_ATTR, VOLUME_LABEL = 0xE5, 0x0F, 0x08
LAST_FLAG = 0x40
MAX_LONG_NAME = 255
LEVEL_CHECKSUM, LEVEL_ADJACENT, LEVEL_FAILED = "checksum", "adjacency-only", "failed"


def live_slots(slots: DataFrame, dir_keys: Sequence[str] = ("image_id", "dir_id")) -> DataFrame:
    """Slots before the first end marker. A directory has at most 65 536 slots, so its window is small."""
    ended = F.max((F.col("first_byte") == 0).cast("int")).over(
        Window.partitionBy(*dir_keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    )
    return slots.withColumn("__ended", ended).where(F.col("__ended") == 0).drop("__ended")


@F.pandas_udf(T.StringType())
def decode_cp437(raw: pd.Series) -> pd.Series:
    """Space-padded code page 437 text; a leading 0x05 stands for 0xE5, trailing dots are dropped."""

    def text(data: bytes) -> str:
        name = data.decode("cp437", "replace").rstrip()
        if name[:1] == "\x05":
            name = "\xe5" + name[1:]
        return name.rstrip(".")

    return raw.map(text, na_action="ignore")


def _utf16(chunk: Column) -> Column:
    return F.decode(chunk, "UTF-16LE")


def decode_slots(slots: DataFrame) -> DataFrame:
    """Decode ``raw`` 32-byte slots: attributes, short name, checksum, and the long-name fragment if it is one."""
    raw = F.col("raw")
    stem = F.when(F.col("first_byte") == DELETED, F.concat(F.encode(F.lit("_"), "UTF-8"), raw.substr(2, 7))).otherwise(
        raw.substr(1, 8)
    )
    suffix = decode_cp437(raw.substr(9, 3))
    short = F.concat(decode_cp437(stem), F.when(suffix != "", F.concat(F.lit("."), suffix)).otherwise(F.lit("")))
    zero5, zero6, zero2 = "00" * 10, "00" * 12, "00" * 4
    c1, c2, c3 = raw.substr(2, 10), raw.substr(15, 12), raw.substr(29, 4)
    stop1, stop2, stop3 = F.hex(c1) == zero5, F.hex(c2) == zero6, F.hex(c3) == zero2
    joined = (
        F.when(stop1, F.lit(""))
        .when(stop2, _utf16(c1))
        .when(stop3, F.concat(_utf16(c1), _utf16(c2)))
        .otherwise(F.concat(_utf16(c1), _utf16(c2), _utf16(c3)))
    )
    characters = F.substring_index(joined, "\u0000", 1)
    sound = (
        (F.col("attributes") == LFN_ATTR)
        & (F.hex(raw.substr(13, 1)) == "00")
        & (F.hex(raw.substr(27, 2)) == "0000")
        & (characters != "")
    )
    based = slots.withColumn("first_byte", uint(raw, 0, 1).cast("int")).withColumn("attributes", uint(raw, 11, 1).cast("int"))
    return based.select(
        *slots.columns,
        "first_byte",
        "attributes",
        short.alias("short_name"),
        F.when(F.col("first_byte") != DELETED, short_name_checksum(raw)).alias("expected_checksum"),
        F.when(
            sound,
            F.struct(
                F.col("first_byte").bitwiseAND(F.lit(0x3F)).alias("sequence"),
                has_bits(F.col("first_byte").cast("long"), LAST_FLAG).alias("is_last"),
                uint(raw, 13, 1).cast("int").alias("checksum"),
                characters.alias("characters"),
            ),
        ).alias("fragment"),
    )


def assemble_long_name(fragments: Column, expected: Column) -> Column:
    """``struct(long_name, level)`` of an array of fragments and the checksum known for the short entry."""
    ordered = F.array_sort(fragments)
    count = F.size(fragments)
    dense = F.transform(ordered, lambda f: f["sequence"]) == F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    one_last = F.size(F.filter(fragments, lambda f: f["is_last"])) == 1
    one_sum = F.size(F.array_distinct(F.transform(fragments, lambda f: f["checksum"]))) == 1
    agrees = expected.isNull() | (F.get(ordered, F.lit(0))["checksum"] == expected)
    joined = F.array_join(F.transform(ordered, lambda f: f["characters"]), "")
    name = F.regexp_replace(F.substring_index(joined, "\u0000", 1), r"(?U)[\s\x1c-\x1f]+$", "")
    good = (count > 0) & dense & one_last & one_sum & agrees & (name != "") & (F.length(name) <= MAX_LONG_NAME)
    level = F.when(~F.coalesce(good, F.lit(False)), F.lit(LEVEL_FAILED)).when(
        expected.isNotNull(), F.lit(LEVEL_CHECKSUM)
    ).otherwise(F.lit(LEVEL_ADJACENT))
    return F.struct(F.when(level != LEVEL_FAILED, name).alias("long_name"), level.alias("level"))


def pair_long_names(
    decoded: DataFrame, dir_keys: Sequence[str] = ("image_id", "dir_id"), include_free: bool = True
) -> DataFrame:
    """Attach to each 8.3 slot the fragments that precede it.

    A malformed fragment clears what was gathered, and so does a free slot when free slots are
    excluded; volume labels change nothing. Gathered runs are islands between such slots.
    """
    dir_keys = list(dir_keys)
    is_lfn = F.col("attributes") == LFN_ATTR
    label = ~is_lfn & has_bits(F.col("attributes").cast("long"), VOLUME_LABEL)
    entry = ~is_lfn & ~label
    broken = is_lfn & F.col("fragment").isNull()
    usable = entry if include_free else entry & (F.col("first_byte") != DELETED)
    before = Window.partitionBy(*dir_keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    # A slot that ends a run still belongs to it, so islands advance on the slot after.
    island = F.coalesce(F.sum((entry | broken).cast("int")).over(before), F.lit(0))
    rows = live_slots(decoded, dir_keys).withColumn("__island", island)
    keep = F.struct("slot", "short_name", "first_byte", "attributes", "expected_checksum", F.col("raw").alias("raw"))
    grouped = rows.groupBy(*dir_keys, "__island").agg(
        F.collect_list("fragment").alias("fragments"),
        F.first(F.when(usable, keep), ignorenulls=True).alias("e"),
    )
    named = grouped.where(F.col("e").isNotNull()).withColumn(
        "n", assemble_long_name(F.col("fragments"), F.col("e.expected_checksum"))
    )
    return named.select(
        *dir_keys,
        "e.slot",
        "e.short_name",
        "n.long_name",
        F.col("n.level").alias("verification"),
        F.coalesce("n.long_name", "e.short_name").alias("name"),
        (F.col("e.first_byte") == DELETED).alias("is_deleted"),
        F.col("e.attributes").alias("attributes"),
        F.col("e.raw").alias("raw"),
    )
