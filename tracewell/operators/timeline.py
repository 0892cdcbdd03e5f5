"""Change-journal records folded into one history per file reference, in USN order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import bits
from tracewell.plans.joins import lookup
from tracewell.plans.prefix import Running, bucket_of, running, union_all

#: USN positions per bucket; a USN is a byte position in the journal, so this bounds the rows.
BUCKET_USN = 1 << 25

#: Plausibility limits of a journal record.
MIN_RECORD, MAX_REASON, FIXED_HEADER = 0x3C, 0x20000000, 0x3C


def plausible_record(
    length: Column, major: Column, minor: Column, reason: Column, name_length: Column, name_offset: Column, name: Column
) -> Column:
    """Whether decoded fields can be a journal record that carries a name."""
    return (
        (length >= MIN_RECORD)
        & (length % 8 == 0)
        & major.isin(2, 3)
        & ((major == 3) | minor.isin(0, 1, 2))
        & reason.between(0, MAX_REASON)
        & (name_length > 0)
        & (name_length % 2 == 0)
        & (name_offset >= FIXED_HEADER)
        & (name_offset + name_length <= length)
        & name.isNotNull()
        & ~name.contains("\u0000")
        & ~name.rlike(r"(?U)^[\s\x1c-\x1f]*$")
    )


def naming_events(usn: DataFrame, name: str = "name") -> DataFrame:
    """Records that say a name came into being or ceased to, under a usable name."""
    return usn.where(
        bits.has_bits(F.col("reason_mask"), bits.NAMING_MASK) & ~F.coalesce(F.col(name), F.lit("")).isin("", ".", "..")
    )


def fold_timeline(usn: DataFrame, keys: Sequence[str] = ("volume_id",), bucket_usn: int = BUCKET_USN) -> DataFrame:
    """One row per full file reference.

    Every column is a map-side combinable aggregate, so a reference with a billion records costs one
    partial row per input partition. Only the rename rows are ordered, bucket by bucket, to find the
    name each rename replaced.
    """
    group = [*keys, "file_reference"]
    mask, at = F.col("reason_mask"), F.struct("usn", "name")
    naming = bits.has_bits(mask, bits.NAMING_MASK)
    renames = bits.has_bits(mask, bits.RENAME_NEW)

    def first_of(column: str | Column, when: Column | None = None) -> Column:
        return F.min_by(column, at if when is None else F.when(when, at))

    first_seen = [
        F.min(F.when(bits.has_bits(mask, bit), F.col("usn"))).alias(f"__r{i}") for i, bit in enumerate(bits.REASONS)
    ]
    folded = usn.groupBy(*group).agg(
        first_of("name").alias("first_name"),
        F.max_by("name", F.when(renames, at)).alias("__last_rename"),
        first_of("parent_reference").alias("parent_reference"),
        first_of("file_attributes").alias("file_attributes"),
        F.min_by("ts", F.when(naming & F.col("ts").isNotNull(), at)).alias("created_at"),
        F.max_by("ts", F.when(bits.has_bits(mask, bits.FILE_DELETE), at)).alias("deleted_at"),
        F.max("usn").alias("last_usn"),
        F.count("*").alias("event_count"),
        F.bit_or(mask).alias("reason_mask"),
        *first_seen,
    )
    # A rename is effective when the name before it differs; before any rename that is the first name.
    previous = running(
        usn.where(renames).select(*group, "usn", "name"),
        group,
        bucket_of("usn", bucket_usn),
        ["usn", "name"],
        [Running("__before", "last", F.col("name"))],
    )
    effective = (
        previous.join(folded.select(*group, "first_name"), group)
        .withColumn("__before", F.coalesce("__before", "first_name"))
        .where(F.col("name") != F.col("__before"))
        .groupBy(*group)
        .agg(F.max_by("__before", F.struct("usn", "name")).alias("renamed_from"))
    )
    names = list(bits.REASONS.values())
    seen = F.array(
        *[F.when(F.col(f"__r{i}").isNotNull(), F.struct(F.col(f"__r{i}").alias("usn"), F.lit(i).alias("bit"), F.lit(n).alias("reason")))
          for i, n in enumerate(names)]
    )
    reasons = F.transform(F.array_sort(F.filter(seen, lambda s: s.isNotNull())), lambda s: s["reason"])
    return (
        folded.join(effective, group, "left")
        .select(
            *group,
            bits.reference_entry(F.col("file_reference")).alias("entry"),
            F.coalesce("__last_rename", "first_name").alias("name"),
            bits.reference_entry(F.col("parent_reference")).alias("parent_entry"),
            "created_at",
            "deleted_at",
            "renamed_from",
            F.col("renamed_from").isNotNull().alias("renamed"),
            bits.has_bits(F.col("file_attributes"), 0x10).alias("is_directory"),
            "last_usn",
            "event_count",
            "reason_mask",
            reasons.alias("reasons"),
        )
    )


def hint_names(timeline: DataFrame, hints: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Replace empty or ``.`` names by the hint ``(keys, file_reference, hint_name)`` for their reference."""
    joined = timeline.join(hints, [*keys, "file_reference"], "left")
    better = F.when(F.col("name").isin("", ".") & F.col("hint_name").isNotNull(), F.col("hint_name")).otherwise(F.col("name"))
    return joined.withColumn("name", better).drop("hint_name")


def order_timeline(timeline: DataFrame) -> DataFrame:
    """Newest deletion first, then newest USN, then name."""
    deleted = F.coalesce(F.unix_micros("deleted_at"), F.lit(0))
    return timeline.orderBy(deleted.desc(), F.desc("last_usn"), "name")


def order_deleted(entries: DataFrame) -> DataFrame:
    """Deleted file records by change time, newest first and undated last, then record number."""
    return entries.orderBy(F.coalesce(F.unix_micros("mft_changed"), F.lit(0)).desc(), "record_num")


def summarize(timeline: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    return timeline.groupBy(*keys).agg(
        F.count("*").alias("files_tracked"),
        F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"),
        F.count_if("renamed").alias("renamed"),
        F.count_if("is_directory").alias("directories"),
        F.count_if(F.col("entry") == 0).alias("entry_zero"),
    )


def corroborate(timeline: DataFrame, names: DataFrame, keys: Sequence[str] = ("volume_id",)) -> DataFrame:
    """Timeline rows that name something, flagged when the name is confirmed elsewhere.

    A name is confirmed when the metadata ``names`` hold it, or when an earlier row of the ordered
    timeline already did. The earliest row per name comes from a combinable minimum, and the rows of a name are salted
    in both joins, so a name shared by most files is not gathered anywhere.
    """
    position = F.struct(
        (-F.coalesce(F.unix_micros("deleted_at"), F.lit(0))).alias("d"), (-F.col("last_usn")).alias("u"),
        F.col("name").alias("n"), F.col("file_reference").alias("r"),
    )
    rows = naming_events(timeline).withColumn("__at", position)
    firsts = rows.groupBy(*keys, "name").agg(F.min("__at").alias("__first"))
    known = names.select(*keys, "name").where(F.col("name").isNotNull()).distinct().withColumn("__known", F.lit(True))
    salt = F.xxhash64("file_reference", "last_usn")
    return (
        lookup(lookup(rows, firsts, [*keys, "name"], salt), known, [*keys, "name"], salt)
        .where(F.col("__first").isNotNull())
        .withColumn("corroborated", F.coalesce("__known", F.lit(False)) | (F.col("__at") != F.col("__first")))
        .drop("__at", "__first", "__known")
    )


def name_evidence(journal: DataFrame, log_names: DataFrame) -> DataFrame:
    """Change-journal and metadata-log evidence in one shape; the log says nothing about deletion."""
    log_rows = log_names.where(~F.coalesce(F.col("name"), F.lit("")).isin("", ".", "..")).select(
        F.col("image_id").alias("volume_id"),
        "name",
        F.col("inode").alias("entry"),
        (F.col("file_type") == 2).alias("is_directory"),
        F.lit(1).cast("long").alias("event_count"),
        F.array(F.lit("jbd2 journal")).alias("reasons"),
        F.lit(None).cast("boolean").alias("was_deleted"),
        F.lit(False).alias("corroborated"),
    )
    journal_rows = journal.withColumn("was_deleted", F.col("deleted_at").isNotNull())
    return union_all([journal_rows, log_rows])


# The metadata log's descriptor block type and the inodes it reserves.
DESCRIPTOR_BLOCK = 1
SYSTEM_INODES = tuple(range(12))


def log_payloads(log_blocks: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Entries of the block that follows each trusted descriptor block."""
    trusted = log_blocks.where(
        F.coalesce(F.col("checksum_ok"), F.lit(True)) & (F.col("block_type") == DESCRIPTOR_BLOCK)
    ).select(*keys, (F.col("index") + 1).alias("index"), F.col("checksum_ok").alias("descriptor_ok"))
    payload = log_blocks.select(*keys, "index", "entries")
    return trusted.join(payload, [*keys, "index"]).select(*keys, "index", "descriptor_ok", F.inline("entries"))


def log_names(log_blocks: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Distinct ``(inode, name)`` pairs in the log, without reserved inodes; the first sighting decides."""
    entries = log_payloads(log_blocks, keys).where((F.col("name") != "") & ~F.col("inode").isin(*SYSTEM_INODES))
    first = F.min_by(F.struct("file_type", F.col("descriptor_ok").alias("checksum_ok")), "index")
    grouped = entries.groupBy(*keys, "inode", "name").agg(first.alias("f"))
    return grouped.select(*keys, "inode", "name", "f.file_type", "f.checksum_ok")


def log_summary(log_blocks: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    keys = list(keys)
    blocks = log_blocks.groupBy(*keys).agg(
        F.count("*").alias("blocks_read"),
        F.count_if(~F.coalesce(F.col("checksum_ok"), F.lit(True))).alias("checksum_failures"),
    )
    entries = log_payloads(log_blocks, keys).groupBy(*keys).agg(F.count("*").alias("directory_entries"))
    names = log_names(log_blocks, keys).groupBy(*keys).agg(
        F.count("*").alias("names_found"),
        F.count_if(F.col("file_type") == 2).alias("directories"),
        F.count_if(F.col("file_type") == 1).alias("regular_files"),
    )
    counts = ["directory_entries", "names_found", "directories", "regular_files"]
    joined = blocks.join(entries, keys, "left").join(names, keys, "left")
    return joined.select(
        *keys, "blocks_read", "checksum_failures", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]
    )


def journal_timeline(usn: DataFrame, metadata_names: DataFrame, keys: Sequence[str] = ("volume_id",)) -> tuple[DataFrame, DataFrame]:
    """``(rows, summary)``: the ordered timeline of named objects with corroboration, and its counts."""
    folded = fold_timeline(usn, keys)
    return order_timeline(corroborate(folded, metadata_names, keys)), summarize(folded, keys)
