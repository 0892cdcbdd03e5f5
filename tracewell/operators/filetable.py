"""Deleted files out of file-table records: predicates, satellites, extents and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.paths import build_paths
from tracewell.plans.prefix import Running, bucket_of, running
from tracewell.sources.records import decode_runs

# Attribute flags and the records that belong to the file system itself.
COMPRESSED, ENCRYPTED, SPARSE = 0x0001, 0x4000, 0x8000
SYSTEM_RECORDS = tuple(range(16))
DATA = 0x80


def primary_name(names: Column) -> Column:
    """The entry that names the object: a DOS or Win32 name that is no dot link, else the first entry."""
    real = F.filter(names, lambda n: n["namespace"].isin(1, 3) & ~n["is_dot"] & ~n["is_dotdot"])
    return F.coalesce(F.get(real, F.lit(0)), F.get(names, F.lit(0)))


def content_caveat(attrs: Column) -> Column:
    """Why the primary stream cannot be given out as the file's content; null when it can."""

    def flagged(bit: int) -> Column:
        return F.exists(attrs, lambda a: (a["type"] == DATA) & (a["name"] == "") & (a["flags"].bitwiseAND(F.lit(bit)) != 0))

    return (
        F.when(flagged(ENCRYPTED), F.lit("the $DATA stream is EFS-encrypted; the plaintext is not on the volume"))
        .when(flagged(COMPRESSED), F.lit("the $DATA stream is NTFS-compressed; the on-disk bytes are not the file"))
        .when(flagged(SPARSE), F.lit("the $DATA stream is sparse; holes read as zeros, not as file content"))
    )


def deleted_records(records: DataFrame, include_system: bool = False, include_allocated: bool = False) -> DataFrame:
    """Records of deleted, named files, with ``name`` and ``parent_record`` of their primary name."""
    named = records.withColumn("__n", primary_name(F.col("names")))
    named = named.withColumn("name", F.col("__n.name")).withColumn("parent_record", F.col("__n.parent_record"))
    keep = ~F.col("is_directory") & (F.coalesce(F.col("name"), F.lit("")) != "")
    if not include_system:
        keep &= ~F.col("record_num").isin(*SYSTEM_RECORDS)
    if not include_allocated:
        keep &= ~F.col("allocated")
    return named.where(keep)


def merge_satellites(records: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Primary-stream attributes of each record with those of its listed satellites, one per ``(name, vcn)``.

    The record's own attribute wins over a satellite's with the same position.
    """
    keys = list(keys)
    own = records.select(*keys, "record_num", F.inline(F.filter("attrs", lambda a: a["type"] == DATA))).withColumn("__rank", F.lit(0))
    listed = records.select(*keys, "record_num", F.posexplode("satellites").alias("__pos", "__sat"))
    theirs = records.select(*keys, F.col("record_num").alias("__sat"), F.inline(F.filter("attrs", lambda a: a["type"] == DATA)))
    added = listed.join(theirs, [*keys, "__sat"]).withColumn("__rank", F.col("__pos") + 1).drop("__pos", "__sat")
    both = own.unionByName(added)
    cols = [c for c in both.columns if c not in (*keys, "record_num", "name", "start_vcn", "__rank")]
    merged = both.groupBy(*keys, "record_num", "name", "start_vcn").agg(F.min_by(F.struct(*cols), "__rank").alias("a"))
    return merged.select(*keys, "record_num", "name", "start_vcn", *[F.col(f"a.{c}").alias(c) for c in cols])


def runs_to_extents(
    runs: DataFrame, keys: Sequence[str] = ("image_id", "record_num"), bucket: int = 1 << 20
) -> DataFrame:
    """Byte spans of ``(keys, start_vcn, run_no, lcn, len, cluster_size, limit_bytes)`` runs, clipped to the limit.

    ``seq`` numbers the spans, ``file_offset`` is where a span belongs in the file; a sparse run has
    no position on the medium. The cumulative length comes from a running sum over the run order.
    """
    keys = list(keys)
    sized = runs.withColumn("__bytes", F.col("len") * F.col("cluster_size")).where(F.col("__bytes") > 0)
    placed = running(
        sized, keys, bucket_of("start_vcn", bucket), ["start_vcn", "run_no"], [Running("file_offset", "sum", F.col("__bytes"))]
    )
    length = F.least(F.col("__bytes"), F.col("limit_bytes") - F.col("file_offset"))
    return placed.where(length > 0).select(
        *keys, "start_vcn", "run_no", "file_offset", length.alias("length"), (F.col("lcn") < 0).alias("is_sparse"),
        F.when(F.col("lcn") >= 0, F.col("lcn") * F.col("cluster_size")).alias("offset"),
    )


def stream_extents(records: DataFrame, geometry: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Spans of every record's primary stream; ``geometry`` is ``(image_id, cluster_size, partition_offset)``.

    A stream is as long as its real size, or as its runs where that is not known. ``max_bytes`` clips longer ones, whose
    spans are ``truncated`` then.
    """
    attrs = merge_satellites(records).where((F.col("name") == "") & F.col("non_resident"))
    limits = attrs.groupBy("image_id", "record_num").agg(F.sum("real_size").alias("__real"))
    decoded = attrs.withColumn("runs", decode_runs("value"))
    flat = decoded.select("image_id", "record_num", "start_vcn", F.posexplode("runs").alias("run_no", "r")).select(
        "image_id", "record_num", "start_vcn", "run_no", "r.lcn", "r.len"
    )
    real = F.when(F.col("__real") > 0, F.col("__real"))
    limit = (real if max_bytes is None else F.least(real, F.lit(max_bytes))).cast("long")
    ready = flat.join(limits, ["image_id", "record_num"]).join(geometry, "image_id").withColumn("limit_bytes", limit)
    spans = runs_to_extents(ready.drop("__real", "partition_offset"))
    if max_bytes is None:
        spans = spans.withColumn("truncated", F.lit(False))
    else:
        held = ready.groupBy("image_id", "record_num").agg(
            (F.least(F.max(real), F.sum(F.col("len") * F.col("cluster_size"))) > max_bytes).alias("truncated")
        )
        spans = spans.join(held, ["image_id", "record_num"])
    return spans.join(geometry.select("image_id", "partition_offset"), "image_id").withColumn(
        "offset", F.col("offset") + F.col("partition_offset")
    ).drop("partition_offset")


def recover_deleted(records: DataFrame, geometry: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(files, spans)`` of deleted files: names, paths, times and caveats, and where their bytes lie.

    Content of encrypted, compressed or sparse streams is withheld while the name is kept. Files are whole unless
    ``max_bytes`` is given; ``truncated`` says of a file and of its spans that it was clipped.
    """
    dead = deleted_records(records)
    named = records.withColumn("__n", primary_name(F.col("names"))).select(
        "image_id", "record_num", F.col("__n.name").alias("name"), F.col("__n.parent_record").alias("parent_record")
    )
    paths = build_paths(dead.select("image_id", "record_num", "name", "parent_record"), named).select("image_id", "record_num", "path")
    streams = merge_satellites(records).where("name = ''").groupBy("image_id", "record_num").agg(
        F.sum(F.when(F.col("non_resident"), F.col("real_size"))).alias("__stream"),
        F.max(F.when(~F.col("non_resident"), F.col("value"))).alias("resident_data"),
    )
    caveat = content_caveat(F.col("attrs"))
    spans = stream_extents(records, geometry, max_bytes)
    primary = F.get(F.filter("attrs", lambda a: (a["type"] == DATA) & (a["name"] == "")), F.lit(0))["real_size"]
    runs = spans.groupBy("image_id", "record_num").agg(
        F.count("*").alias("__runs"), F.max("truncated").alias("__truncated"), F.min_by("offset", F.when(~F.col("is_sparse"), F.struct("file_offset"))).alias("first_data_offset")
    )
    files = (
        dead.join(paths, ["image_id", "record_num"], "left").join(streams, ["image_id", "record_num"], "left")
        .join(runs, ["image_id", "record_num"], "left")
        .select(
            "image_id", "record_num", "sequence_number", "name", "path", "parent_record",
            F.coalesce(primary, F.col("__n.real_size"), F.lit(0)).alias("size_bytes"),
            "created", "modified", "mft_changed", "accessed", "fixup_verified", caveat.alias("content_caveat"),
            F.when(caveat.isNull(), F.col("resident_data")).alias("resident_data"),
            F.greatest(F.lit(1), F.coalesce("__runs", F.lit(0))).cast("int").alias("fragment_count"),
            F.when(caveat.isNull(), F.col("first_data_offset")).alias("first_data_offset"),
            (F.size("satellites") > 0).alias("recovered_from_satellite"), F.coalesce("__truncated", F.lit(False)).alias("truncated"),
        )
    )
    readable = files.where("content_caveat IS NULL AND resident_data IS NULL").select("image_id", "record_num")
    return files, spans.join(readable, ["image_id", "record_num"], "left_semi")
