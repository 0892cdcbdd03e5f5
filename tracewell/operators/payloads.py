"""Payload identity: digests, first-wins deduplication, known-file suppression and report roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.joins import lookup

# Supported digests and their hex length.
ALGORITHMS = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128}

#: Tasks that the copies of one digest are dealt over.
SALT = 16


def digest(payload: Column, algorithm: str) -> Column:
    if algorithm == "md5":
        return F.md5(payload)
    if algorithm == "sha1":
        return F.sha1(payload)
    return F.sha2(payload, {"sha256": 256, "sha512": 512}[algorithm])


def multi_digest(df: DataFrame, payload: str = "payload", algorithms: Sequence[str] = tuple(ALGORITHMS)) -> DataFrame:
    """One column per algorithm."""
    return df.select("*", *[digest(F.col(payload), a).alias(a) for a in algorithms])


def digests_long(df: DataFrame, ids: Sequence[str], payload: str, algorithms: Sequence[str]) -> DataFrame:
    """Digests in long form: one ``(ids, algo, digest)`` row per algorithm."""
    pairs = F.array(*[F.struct(F.lit(a).alias("algo"), digest(F.col(payload), a).alias("digest")) for a in algorithms])
    return df.select(*ids, F.inline(pairs))


def mark_duplicates(
    files: DataFrame, keys: Sequence[str], digest_col: str, order: Sequence[str], flag: str = "is_duplicate"
) -> DataFrame:
    """Flag every row but the first by ``order`` among those sharing ``keys`` and digest.

    The winner per digest is found with a map-side combined minimum, and only digests seen more than once travel back.
    The rows of one digest are salted in the join, so a payload copied a billion times does not meet in one task.
    """
    order = list(order)
    group = [*keys, digest_col]
    winners = (
        files.groupBy(*group)
        .agg(F.min(F.struct(*order)).alias("__first"), F.count("*").alias("__n"))
        .where(F.col("__n") > 1)
        .drop("__n")
    )
    joined = lookup(files, winners, group, F.xxhash64(*order), SALT)
    later = F.col("__first").isNotNull() & (F.struct(*order) != F.col("__first"))
    return joined.withColumn(flag, later).select(*files.columns, flag)


def dedupe_payloads(files: DataFrame, keys: Sequence[str], digest_col: str, order: Sequence[str]) -> DataFrame:
    """Keep the first row by ``order`` per ``keys`` and digest."""
    return mark_duplicates(files, keys, digest_col, order, "__dup").where(~F.col("__dup")).drop("__dup")


def known_algorithms(known: DataFrame) -> list[str]:
    """Algorithms present in a hash set, so only those are computed (at most four rows come back)."""
    found = {r.algo for r in known.where(F.col("algo").isin(*ALGORITHMS)).select("algo").distinct().collect()}
    return [a for a in ALGORITHMS if a in found]


def match_known(
    files: DataFrame,
    known: DataFrame,
    ids: Sequence[str],
    payload: str = "payload",
    algorithms: Sequence[str] | None = None,
    digests: Sequence[str] | None = None,
) -> DataFrame:
    """``files`` with ``matched_algo``: the first algorithm whose digest is known, else null.

    Only ``(ids, algo, digest)`` rows travel for the lookup, each digest once however many files have it; payloads stay
    where they are until the narrow match table joins back. ``digests`` names columns that already hold the digests,
    called after their algorithms, for files without their payload.
    """
    algorithms = list(algorithms) if algorithms is not None else known_algorithms(known)
    if not algorithms:
        return files.withColumn("matched_algo", F.lit(None).cast("string"))
    wanted = known.select("algo", F.lower("digest").alias("digest")).distinct()
    rank = F.array_position(F.array(*[F.lit(a) for a in algorithms]), F.col("algo"))
    if digests is None:
        rows = digests_long(files, ids, payload, algorithms)
    else:
        rows = files.select(*ids, F.inline(F.array(*[F.struct(F.lit(a).alias("algo"), F.col(a).alias("digest")) for a in algorithms])))
    found = rows.select("algo", "digest").distinct().join(wanted, ["algo", "digest"], "left_semi").withColumn("__known", F.lit(True))
    hits = (
        lookup(rows, found, ["algo", "digest"], F.xxhash64(*ids), SALT)
        .where("__known")
        .groupBy(*ids)
        .agg(F.min_by("algo", rank).alias("matched_algo"))
    )
    return files.join(hits, list(ids), "left")


def suppress_known(files: DataFrame, known: DataFrame, ids: Sequence[str], payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Split files into kept ones and suppressed ones (with the algorithm that matched)."""
    marked = match_known(files, known, ids, payload)
    return (
        marked.where(F.col("matched_algo").isNull()).drop("matched_algo"),
        marked.where(F.col("matched_algo").isNotNull()),
    )


def resume(candidates: DataFrame, session_entries: DataFrame, digest_col: str = "sha256") -> DataFrame:
    """Skip payloads that an earlier session recorded for the same image.

    Entries without an ``image_id`` speak for every image.
    """
    keys = ["image_id", digest_col] if {"image_id"} <= {*session_entries.columns} & {*candidates.columns} else [digest_col]
    done = session_entries.where(F.col("sha256") != "").withColumnRenamed("sha256", digest_col).select(*keys).distinct()
    return candidates.join(done, keys, "left_anti")


def category_counts(files: DataFrame, column: str, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """``keys -> map(value, count)`` for categories or recovery methods (both small fixed vocabularies)."""
    counts = files.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(f"by_{column}")
    )


def rejection_histogram(rejected: DataFrame, limit: int | None = None) -> DataFrame:
    """Rejection reasons: count descending, then reason; all of them unless ``limit`` asks for the first."""
    ranked = rejected.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")
    return ranked if limit is None else ranked.limit(limit)


def rejected_sample(rejected: DataFrame, keys: Sequence[str] = ("image_id",), order: Sequence[str] = ("offset",), *, k: int | None) -> DataFrame:
    """The first ``k`` rejected candidates per image, with how many there were in all (``truncated`` if more than ``k``).

    All of them if ``k`` is None. Ranks are taken inside hash slices first, so a noisy image is cut down before its rows
    meet.
    """
    totals = rejected.groupBy(*keys).agg(F.count("*").alias("rejected_total"))
    if k is None:
        return rejected.join(totals, list(keys)).withColumn("truncated", F.lit(False))
    order = list(order)
    slices = F.pmod(F.xxhash64(*order), F.lit(64))
    inner = Window.partitionBy(*keys, "__slice").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    few = (
        rejected.withColumn("__slice", slices)
        .withColumn("__rn", F.row_number().over(inner))
        .where(F.col("__rn") <= k)
        .withColumn("__rn", F.row_number().over(outer))
        .where(F.col("__rn") <= k)
        .drop("__slice", "__rn")
    )
    return few.join(totals, list(keys)).withColumn("truncated", F.col("rejected_total") > k)


def session_totals(tagged: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Counters of one session per image from candidates tagged with ``outcome`` and ``size_bytes``."""

    def count(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    def total(outcome: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("outcome") == outcome, F.col("size_bytes"))), F.lit(0)).cast("long")

    return tagged.groupBy(*keys).agg(
        F.count_if(~F.col("outcome").isin("prefiltered", "allocated")).alias("candidates"),
        count("accepted").alias("accepted"),
        total("accepted").alias("bytes_recovered"),
        count("rejected").alias("rejected"),
        total("rejected").alias("rejected_bytes"),
        count("duplicate").alias("duplicates"),
        count("filtered").alias("filtered"),
        count("prefiltered").alias("prefiltered"),
        count("known").alias("suppressed"),
        total("known").alias("suppressed_bytes"),
        count("allocated").alias("allocated_skipped"),
        count("contained").alias("contained"),
    )


def ranked_findings(files: DataFrame) -> DataFrame:
    """Findings by confidence, then size, both descending."""
    return files.orderBy(F.desc("confidence_score"), F.desc("size_bytes"))
