"""Resumable sessions: identity, recorded entries, and folding a new run into them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = ["offset", "length", "sha256", "extension", "original_name", "recovered_path"]

# How an image is fingerprinted.
EDGE_BYTES = 1 << 20
SAMPLE_COUNT = 64
SAMPLE_BYTES = 4096


def fingerprint_ranges(images: DataFrame) -> DataFrame:
    """The byte ranges a fingerprint reads: both edges, and 64 samples when the middle is long enough."""
    size = F.col("size")
    span = F.greatest(F.lit(0), size - 2 * EDGE_BYTES)
    step = F.expr(f"greatest(0, size - {2 * EDGE_BYTES}) div {SAMPLE_COUNT}")

    def piece(seq: Column, offset: Column, length: Column) -> Column:
        return F.struct(seq.cast("int").alias("seq"), offset.cast("long").alias("offset"), length.cast("long").alias("length"))

    head = piece(F.lit(0), F.lit(0), F.least(size, F.lit(EDGE_BYTES)))
    tail = F.when(size > EDGE_BYTES, piece(F.lit(1), F.greatest(F.lit(0), size - EDGE_BYTES), F.least(size, F.lit(EDGE_BYTES))))
    samples = F.when(
        span > SAMPLE_COUNT * SAMPLE_BYTES,
        F.transform(
            F.sequence(F.lit(0), F.lit(SAMPLE_COUNT - 1)), lambda i: piece(i + 2, F.lit(EDGE_BYTES) + i * step, F.lit(SAMPLE_BYTES))
        ),
    )
    every = F.concat(F.array_compact(F.array(head, tail)), F.coalesce(samples, F.array().cast("array<struct<seq:int,offset:bigint,length:bigint>>")))
    return images.select("image_id", "size", F.inline(every))


def image_fingerprint(pieces: DataFrame) -> DataFrame:
    """SHA-256 over the size text and the pieces in order: ``pieces(image_id, size, seq, bytes)``.

    At most 66 pieces and about 2.3 MiB per image, whatever the image size.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "bytes")))
    joined = F.aggregate(ordered, F.encode(F.first("size").cast("string"), "UTF-8"), lambda acc, p: F.concat(acc, p["bytes"]))
    return pieces.groupBy("image_id").agg(F.first("size").alias("size"), F.sha2(joined, 256).alias("fingerprint"))


def check_identity(sessions: DataFrame, images: DataFrame) -> DataFrame:
    """Sessions whose image still has the recorded size and fingerprint; anything else is an error."""
    joined = sessions.join(
        images.select("image_id", F.col("size").alias("__size"), F.col("fingerprint").alias("__fp")), "image_id", "left"
    )
    wrong = identity_problem(F.col("target_size"), F.col("fingerprint"), F.col("__size"), F.col("__fp"))
    checked = joined.withColumn("__ok", F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean")))
    return checked.where(F.col("__ok")).drop("__size", "__fp", "__ok")


def identity_problem(target_size: Column, fingerprint: Column, size: Column, actual: Column) -> Column:
    """Why a session must not be resumed on an image; null when it may."""
    resized = F.concat(
        F.lit("session was taken against a "), target_size.cast("string"), F.lit("-byte target but the image is "),
        size.cast("string"), F.lit(" bytes; these are not the same image"),
    )
    return (
        F.when(size.isNull(), F.lit("the session's image is not among those given"))
        .when(size != target_size, resized)
        .when(~actual.eqNullSafe(fingerprint), F.lit("session fingerprint does not match; the image has changed since the session was written"))
    )


def merge_session(entries: DataFrame, found: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Existing entries win per offset, new findings are added, ordered by offset."""
    columns = [c for c in entries.columns if c not in keys and c != "offset"]
    both = entries.withColumn("__new", F.lit(0)).unionByName(found.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = F.struct("__new", *[c for c in ("ord",) if c in both.columns], "sha256", "length")
    kept = both.groupBy(*keys, "offset").agg(F.min_by(F.struct(*columns), order).alias("e"))
    return kept.select(*keys, "offset", *[F.col(f"e.{c}").alias(c) for c in columns]).orderBy(*keys, "offset")


def missing_outputs(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries with a recorded path that is no longer in ``listing(path)``."""
    recorded = entries.where(F.coalesce(F.col("recovered_path"), F.lit("")) != "")
    return recorded.join(listing.select(F.col("path").alias("recovered_path")).distinct(), "recovered_path", "left_anti").select(
        *entries.columns
    )


def resume_counts(candidates: DataFrame, entries: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Candidates per image that a session already recorded for it (for any image, if entries have no image), by digest."""
    on = [*[k for k in keys if k in entries.columns], "sha256"]
    done = entries.where(F.col("sha256") != "").select(*on).distinct()
    hits = candidates.join(done, on, "left_semi")
    return hits.groupBy(*keys).agg(F.count("*").alias("resumed"))
