"""Bit fields, little/big-endian integers and NT time values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Change-journal reason bits.
REASONS = {
    0x00000001: "DATA_OVERWRITE",
    0x00000002: "DATA_EXTEND",
    0x00000004: "DATA_TRUNCATION",
    0x00000010: "NAMED_DATA_OVERWRITE",
    0x00000020: "NAMED_DATA_EXTEND",
    0x00000040: "NAMED_DATA_TRUNCATION",
    0x00000100: "FILE_CREATE",
    0x00000200: "FILE_DELETE",
    0x00000400: "EA_CHANGE",
    0x00000800: "SECURITY_CHANGE",
    0x00001000: "RENAME_OLD_NAME",
    0x00002000: "RENAME_NEW_NAME",
    0x00004000: "RENAME_DOS_NAME",
    0x00008000: "FILE_DELETE_CHAMPION",
    0x00010000: "CLOSE_APPLICATION",
    0x00020000: "CLOSE_WRITER",
    0x00040000: "CLOSE_SERVER",
    0x00080000: "DATA_SET_LENGTH",
    0x00100000: "DATA_PROTECTION",
    0x00200000: "DUPLICATE_INCREASE",
    0x00400000: "DUPLICATE_DECREASE",
    0x00800000: "INTEGRITY_OVERWRITE",
    0x02000000: "CLOSE_USER",
    0x04000000: "CLOSE_TRANSMIT",
    0x10000000: "DESIRED_DROP",
}
FILE_CREATE, FILE_DELETE, RENAME_OLD, RENAME_NEW = 0x100, 0x200, 0x1000, 0x2000
NAMING_MASK = FILE_CREATE | FILE_DELETE | RENAME_OLD | RENAME_NEW

# NT time sentinels, the epoch offset in ticks, and the accepted range.
NT_EPOCH_TICKS = 116_444_736_000_000_000
NT_UNSET = (0, 0x7FFFFFFFFFFFFFFF, -1)
NT_JOURNAL_MAX = 2_650_467_744_000_000_000
YEAR_2100_SECONDS = 4_102_444_800


def int_div(value: Column, by: int) -> Column:
    """Exact integer division (``/`` would go through a double)."""
    return F.call_function("div", value.cast("long"), F.lit(by).cast("long"))


def has_bits(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits).cast("long")) != 0


def reason_names(mask: Column) -> Column:
    """Names of the reason bits set, lowest bit first."""
    each = [F.when(has_bits(mask, bit), F.lit(name)) for bit, name in REASONS.items()]
    return F.filter(F.array(*each), lambda name: name.isNotNull())


def reference_entry(reference: Column) -> Column:
    """Low 48 bits: the file-table entry."""
    return reference.bitwiseAND(F.lit(0x0000FFFFFFFFFFFF).cast("long"))


def reference_sequence(reference: Column) -> Column:
    """High 16 bits: the reuse counter."""
    return F.shiftrightunsigned(reference, 48).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")


def nt_time(ticks: Column, journal: bool = False) -> Column:
    """100 ns ticks since 1601 as a timestamp; null for sentinels and outside 1970-2100.

    ``ticks`` is a signed 64-bit column, so the all-ones sentinel reads as -1.
    """
    micros = int_div(ticks - F.lit(NT_EPOCH_TICKS), 10)
    in_range = (ticks >= NT_EPOCH_TICKS) & (ticks <= NT_EPOCH_TICKS + YEAR_2100_SECONDS * 10_000_000)
    if journal:
        in_range &= ticks <= NT_JOURNAL_MAX
    return F.when(~ticks.isin(*NT_UNSET) & in_range, F.timestamp_micros(micros))


def uint(data: Column, offset: int | Column, width: int, endian: str = "little") -> Column:
    """Unsigned integer of 1-8 bytes at a 0-based offset; null when the bytes are missing.

    Eight-byte values come back as ``DECIMAL(20,0)`` so the top bit is kept.
    """
    start = offset + 1 if isinstance(offset, Column) else F.lit(offset + 1)
    raw = data.substr(start, F.lit(width))
    digits = F.hex(raw)
    if endian == "little" and width > 1:
        pairs = [F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]
        digits = F.concat(*pairs)
    whole = F.octet_length(raw) == width
    value = F.conv(F.when(whole, digits), 16, 10)
    return value.cast("decimal(20,0)") if width == 8 else value.cast("long")


# Status and action codes of the sanitize-status log, and the tier an action supports.
STATUS_TEXT = {
    0x0: "the NVM subsystem has never been sanitized",
    0x1: "the most recent sanitize operation completed successfully",
    0x2: "a sanitize operation is currently in progress",
    0x3: "the most recent sanitize operation FAILED",
}
IN_PROGRESS = 0x2
ACTION_TEXT = {
    0x1: "exit failure",
    0x2: "block erase",
    0x3: "overwrite",
    0x4: "crypto erase",
    0x5: "exit media verification",
}
ACTION_TIER = {0x2: "Sanitize", 0x3: "Purge", 0x4: "Sanitize"}


def _text_of(table: dict[int, str], code: Column) -> Column:
    flat: list[Column] = []
    for key, value in table.items():
        flat += [F.lit(key), F.lit(value)]
    return F.element_at(F.create_map(*flat), code.cast("int"))


def status_text(code: Column) -> Column:
    unknown = F.concat(F.lit("unrecognised status code 0x"), F.lower(F.hex(code.cast("long"))))
    return F.coalesce(_text_of(STATUS_TEXT, code), unknown)


def action_text(action: Column) -> Column:
    return F.coalesce(_text_of(ACTION_TEXT, action), F.lit("unrecorded or unrecognised"))


def tier_for_action(action: Column) -> Column:
    """The sanitisation tier an action can support; null when it supports none."""
    return _text_of(ACTION_TIER, action)


def downgrade_record(requested: Column, achieved: Column, reason: Column) -> Column:
    """What was asked for, what the evidence supports, and why they differ."""
    return F.struct(
        requested.alias("requested_tier"),
        achieved.alias("achieved_tier"),
        (~achieved.eqNullSafe(requested)).alias("downgraded"),
        reason.alias("reason"),
        F.concat(
            F.lit("the requested "), requested,
            F.lit(" tier was NOT achieved; the highest tier the evidence supports is "),
            F.coalesce(F.when(achieved != "", achieved), F.lit("none")),
        ).alias("statement"),
    )


def sanitize_status(sprog: Column, sstat: Column, scdw10: Column) -> Column:
    """Decode the three status words of a sanitize log into named fields."""
    code = sstat.bitwiseAND(F.lit(0xF))
    passes = F.shiftright(sstat, 12).bitwiseAND(F.lit(0xF))
    wide = scdw10.cast("long")
    asked = F.shiftright(wide, 15).bitwiseAND(F.lit(0x3F).cast("long")).cast("int")
    return F.struct(
        code.cast("int").alias("status_code"),
        (F.shiftright(sstat, 8).bitwiseAND(F.lit(1)) == 1).alias("global_data_erased"),
        (F.shiftright(sstat, 9).bitwiseAND(F.lit(1)) == 1).alias("media_verification_canceled"),
        F.when(passes != 0, passes).cast("int").alias("completed_passes"),
        F.when(code == IN_PROGRESS, sprog / F.lit(65536.0)).alias("progress_fraction"),
        F.shiftright(wide, 8).bitwiseAND(F.lit(0xF).cast("long")).cast("int").alias("action"),
        F.when(asked == 0, 16).otherwise(asked).alias("overwrite_passes"),
        F.shiftright(wide, 21).bitwiseAND(F.lit(0x7).cast("long")).cast("int").alias("no_deallocate"),
        (wide.bitwiseAND(F.lit(1).cast("long")) == 1).alias("allow_unrestricted_exit"),
        (F.shiftright(wide, 4).bitwiseAND(F.lit(1).cast("long")) == 1).alias("invert_pattern_between_passes"),
    )


def short_name_checksum(raw: Column) -> Column:
    """Rotate-right checksum over the 11 raw bytes of an 8.3 name."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(10)),
        F.lit(0),
        lambda acc, i: (
            F.shiftleft(acc.bitwiseAND(F.lit(1)), 7) + F.shiftright(acc, 1)
            + F.conv(F.hex(raw.substr(i + 1, F.lit(1))), 16, 10).cast("int")
        ).bitwiseAND(F.lit(0xFF)),
    )
