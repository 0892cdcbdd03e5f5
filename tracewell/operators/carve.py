"""Signature carving end to end: windows in, recovered files, rejections and a summary out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import scoring
from tracewell.functions.entropy import sample_entropy
from tracewell.functions.provenance import provenance
from tracewell.functions.structure import validate_structure
from tracewell.operators import payloads as pay
from tracewell.operators.boundaries import HEAD_BYTES, MARKERS, resolve_boundaries
from tracewell.operators.budget import UNLIMITED, Policy, admit_budget
from tracewell.operators.extents import drop_contained, merge_extents, prune_blocks, rate_ppm, restrict_to_free
from tracewell.operators.fragments import number_files
from tracewell.operators.scan import Pattern, prefiltered_counts, scan_images, signature_candidates, signature_patterns
from tracewell.plans.joins import lookup
from tracewell.plans.prefix import Running, running, union_all
from tracewell.session import cut_lineage
from tracewell.sources.images import BLOCK, OVERLAP, block_index, read_ranges
from tracewell.sources.signatures import signature_table, sniff, wanted_signatures

#: Pattern numbers of marker and terminator searches, far above any signature's.
MARKER_BASE, FOOTER_BASE = 1_000_000, 2_000_000


@dataclass
class CarveResult:
    """Tables of one carving session. ``recovered`` and ``rejected`` are materialised."""

    recovered: DataFrame
    rejected: DataFrame
    summary: DataFrame
    extents: DataFrame


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _inbuilt_present(head: Column, marker: Column, window: Column) -> Column:
    """Whether a marker occurs in the first bytes of a candidate (byte-exact, any position)."""
    near = head.substr(F.lit(1), F.greatest(window, F.octet_length(marker)))
    return F.contains(F.decode(near, "ISO-8859-1"), F.decode(marker, "ISO-8859-1"))


def find_candidates(
    images: DataFrame,
    signatures: DataFrame,
    *,
    free: DataFrame | None = None,
    extensions: list[str] | None = None,
    block: int = BLOCK,
    overlap: int = OVERLAP,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(candidates, markers, footers, counters)`` of one scan over the images.

    Only the signatures of ``extensions``, and custom ones, are looked for. With ``free`` (half-open ranges) only windows that touch free space are read, and only candidates
    that begin in it are kept.
    """
    signatures = wanted_signatures(signatures, extensions)
    index = block_index(images, block, overlap)
    skipped = None
    if free is not None:
        flagged = prune_blocks(index, free, flag="touches_free")
        skipped = flagged.groupBy("image_id").agg(
            F.sum(F.when(F.col("touches_free"), 0).otherwise(F.col("length"))).cast("long").alias("allocated_bytes_skipped")
        )
        index = flagged.where("touches_free").drop("touches_free")
    patterns = signature_patterns(signatures)
    markers = list(MARKERS.items())
    custom = [r for r in signatures.where("is_custom AND footer IS NOT NULL").select("sig_rank", "footer").toLocalIterator()]
    search = [
        *patterns,
        *[Pattern(MARKER_BASE + i, needle) for i, (_, needle) in enumerate(markers)],
        *[Pattern(FOOTER_BASE + r.sig_rank, bytes(r.footer)) for r in custom],
    ]
    hits = cut_lineage(scan_images(index, search))
    paths = images.select("image_id", "path", "size")
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in markers]), (F.col("pattern") - MARKER_BASE + 1).cast("int"))
    found = hits.where(F.col("offset").isNotNull())
    marker_hits = found.where(F.col("pattern").between(MARKER_BASE, FOOTER_BASE - 1)).select("image_id", kind.alias("kind"), "offset")
    footer_hits = found.where(F.col("pattern") >= FOOTER_BASE).select("image_id", (F.col("pattern") - FOOTER_BASE).alias("sig_rank"), "offset")
    cands = signature_candidates(hits.where(F.col("pattern") < MARKER_BASE), signatures)
    counters = prefiltered_counts(hits)
    if free is not None:
        cands = restrict_to_free(cands, free, flag="in_free")
        counters = counters.join(
            cands.groupBy("image_id").agg(F.count_if(~F.col("in_free")).alias("allocated_candidates_skipped")), "image_id", "full"
        ).join(skipped, "image_id", "full")
        cands = cands.where("in_free").drop("in_free")
    return cands.join(paths, "image_id"), marker_hits.join(paths.drop("size"), "image_id"), footer_hits, counters


def judge_candidates(
    candidates: DataFrame, markers: DataFrame, footers: DataFrame, policy: Policy, known: DataFrame | None, source: str = "the hash set"
) -> DataFrame:
    """Resolve, bound, validate, hash, match and score every candidate; ``stage``/``reason`` tell why one fell out.

    Each step only reads what the step before let through: heads for the marker check (8 KiB, or as far as a marker may
    lie), unit headers for the boundaries, and payloads for candidates whose end is known. Payloads do not leave the
    task that reads them.
    """
    need = F.greatest(F.lit(HEAD_BYTES), F.when(F.col("inbuilt").isNotNull(), F.greatest("inbuilt_window", F.octet_length("inbuilt"))))
    heads = read_ranges(candidates.withColumn("length", need.cast("long")), "head").drop("length")
    marked = F.col("inbuilt").isNull() | _inbuilt_present(F.col("head"), F.col("inbuilt"), F.col("inbuilt_window"))
    heads = cut_lineage(heads.withColumn("marked", marked).withColumn("max_file", F.lit(policy.max_file_bytes if policy.max_file_bytes is not None else (1 << 62)).cast("long")))
    absent = heads.where(~F.col("marked")).select(
        *_KEYS, F.lit("structure").alias("stage"),
        _text("inbuilt marker is absent from the first ", F.col("inbuilt_window"), " bytes").alias("reason"),
    )
    resolved = cut_lineage(resolve_boundaries(heads.where("marked"), markers, footers).drop("head"))
    size = F.col("boundary.end") - F.col("offset")
    sized = resolved.withColumn("size_bytes", size)
    too_small = _text("resolved ", F.col("size_bytes"), " B is below the ", F.col("min_size"), " B minimum")
    bound_problem = (
        F.when(F.col("boundary.end").isNull(), F.col("boundary.notes")[0])
        .when(F.col("size_bytes") < F.col("min_size"), too_small)
        .when(F.col("boundary.end") > F.col("size"), F.lit("file extends past end of target"))
    )
    sized = sized.withColumn("problem", bound_problem)
    unbound = sized.where(F.col("problem").isNotNull()).select(*_KEYS, F.lit("boundary").alias("stage"), F.col("problem").alias("reason"))
    whole = read_ranges(sized.where(F.col("problem").isNull()).drop("problem").withColumn("length", F.col("size_bytes")), "payload").drop("length")
    gated = whole.withColumn("gate", validate_structure(F.col("payload"), F.col("extension")))
    gated = gated.withColumn("entropy", sample_entropy(F.col("payload"))).withColumn("sha256", F.sha2("payload", 256))
    gated = gated.withColumn("candidate_id", F.concat_ws(":", "image_id", "sig_rank", "offset"))
    footer_seen = F.col("footer").isNotNull() & F.contains(F.decode("payload", "ISO-8859-1"), F.decode("footer", "ISO-8859-1"))
    scored = scoring.score_candidate(
        name=F.col("name"), extension=F.col("extension"), category=F.col("category"), header=F.col("header"),
        header_offset=F.col("header_offset"), min_size=F.col("min_size"), max_size=F.col("max_size"), payload=F.col("payload"),
        entropy=F.col("entropy"), method=F.col("boundary.method"), notes=F.col("boundary.notes"),
        has_valid_footer=F.coalesce(footer_seen, F.lit(False)),
    )
    algorithms = pay.known_algorithms(known) if known is not None else []
    gated = gated.withColumn("scored", scored).withColumns({a: pay.digest(F.col("payload"), a) for a in algorithms})
    # From here on rows are narrow; the bytes of admitted files are read once more at the end.
    gated = cut_lineage(gated.drop("payload"))
    if known is not None:
        gated = pay.match_known(gated, known, ["candidate_id"], algorithms=algorithms, digests=algorithms)
    else:
        gated = gated.withColumn("matched_algo", F.lit(None).cast("string"))
    low = F.col("scored.score") < policy.min_confidence
    stage = (
        F.when(~F.col("gate.ok"), F.lit("structure"))
        .when(F.col("matched_algo").isNotNull(), F.lit("known-file"))
        .when(low, F.lit("score"))
    )
    reason = (
        F.when(~F.col("gate.ok"), F.col("gate.reason"))
        .when(F.col("matched_algo").isNotNull(), _text("matches a known ", F.col("matched_algo"), " digest in ", source))
        .when(low, _text("confidence ", F.col("scored.score"), f" below the {policy.min_confidence} threshold"))
    )
    judged = gated.select(
        *_KEYS, "name", "category", "size_bytes", "sha256", F.col("scored.score").alias("confidence_score"),
        F.col("scored.heuristics").alias("heuristics"), F.col("boundary.method").alias("boundary_method"),
        stage.alias("stage"), reason.alias("reason"),
    )
    return union_all([judged, absent, unbound])


_KEYS = ("image_id", "block_no", "sig_rank", "offset", "extension", "scan_order")


def carve(
    images: DataFrame,
    signatures: DataFrame | None = None,
    policy: Policy | None = None,
    *,
    known: DataFrame | None = None,
    session: DataFrame | None = None,
    free: DataFrame | None = None,
    extensions: list[str] | None = None,
    block: int = BLOCK,
    overlap: int = OVERLAP,
) -> CarveResult:
    """Carve ``images(image_id, path, size)``.

    A payload is a duplicate when an earlier file of the scan with the same digest was recovered, or when a resumed
    ``session`` recorded it for the same image (for any image, if the session has no image_id). Without a ``policy``
    nothing is capped.
    """
    policy = policy or UNLIMITED
    spark = images.sparkSession
    signatures = signature_table(spark) if signatures is None else signatures
    cands, markers, footers, counters = find_candidates(
        images, signatures, free=free, extensions=extensions, block=block, overlap=overlap
    )
    judged = cut_lineage(judge_candidates(cands, markers, footers, policy, known))
    if session is not None:
        keys = ["image_id", "sha256"] if "image_id" in session.columns else ["sha256"]
        seen = session.where(F.col("sha256") != "").select(*keys).distinct().withColumn("__resumed", F.lit(True))
        judged = lookup(judged, seen, keys, F.xxhash64("offset", "sig_rank"))
    else:
        judged = judged.withColumn("__resumed", F.lit(None).cast("boolean"))
    validated = F.col("stage").isNull() | F.col("stage").isin("known-file", "score")
    resumed = F.coalesce("__resumed", F.lit(False)) & validated
    order = judged.select("image_id", "scan_order").distinct()
    # Scan order as one number: windows are the bucket, signature and offset order them inside.
    flat = order.select("image_id", "scan_order", F.col("scan_order.block_no").alias("__b"))
    ranked = running(flat, ["image_id"], F.expr("__b div 16"), ["scan_order"], [Running("ord", "sum", F.lit(1).cast("long"))])
    judged = judged.join(ranked.select("image_id", "scan_order", "ord"), ["image_id", "scan_order"])
    passing = judged.where(F.col("stage").isNull() & ~resumed).select(
        F.col("image_id"), "ord", "category", "extension", F.col("size_bytes").alias("size"), F.col("sha256").alias("digest")
    )
    budgeted = admit_budget(passing, policy).select("image_id", "ord", "admitted", "denial")
    first = (
        judged.join(budgeted.where("admitted"), ["image_id", "ord"], "left_semi")
        .groupBy("image_id", "sha256").agg(F.min("ord").alias("__first"))
    )
    tagged = judged.join(budgeted, ["image_id", "ord"], "left")
    tagged = lookup(tagged, first, ["image_id", "sha256"], F.xxhash64("ord"))
    again = resumed | (validated & (F.col("ord") > F.col("__first")))
    outcome = (
        F.when(F.coalesce(again, F.lit(False)), F.lit("duplicate"))
        .when(F.col("stage") == "known-file", F.lit("known"))
        .when(F.col("stage").isNotNull(), F.lit("rejected"))
        .when(F.col("admitted"), F.lit("accepted"))
        .otherwise(F.lit("rejected"))
    )
    tagged = cut_lineage(
        tagged.withColumn("outcome", outcome)
        .withColumn("stage", F.when(F.col("stage").isNull() & ~F.coalesce("admitted", F.lit(False)), F.lit("budget")).otherwise(F.col("stage")))
        .withColumn("reason", F.coalesce("reason", "denial"))
        .drop("__resumed", "__first", "admitted", "denial")
    )
    accepted = drop_contained(tagged.where("outcome = 'accepted'"), flag="contained")
    kept = number_files(accepted.where(~F.col("contained")).drop("contained"), order=["ord"], bucket_bytes=1 << 16)
    hex_at = F.lpad(F.lower(F.hex("offset")), 10, "0")
    recovered = kept.select(
        "file_id", "image_id",
        F.concat_ws("_", "file_id", hex_at, _text(F.col("confidence_score"), "pct.", F.col("extension"))).alias("filename"),
        "extension", "category", "offset", "size_bytes", "sha256", "confidence_score", "heuristics",
        F.lit("signature_carving").alias("recovery_method"), F.lit(False).alias("is_fragmented"), F.lit(1).alias("fragment_count"),
        "boundary_method", "ord",
    )
    placed = recovered.join(images.select("image_id", "path"), "image_id")
    recovered = cut_lineage(read_ranges(placed.withColumn("length", F.col("size_bytes")), "payload").drop("path", "length"))
    rejected = tagged.where("outcome IN ('rejected', 'known')").select("image_id", "offset", "extension", "reason", "stage", "outcome", "size_bytes", "ord")
    contained = accepted.where("contained").withColumn("outcome", F.lit("contained"))
    columns = ["image_id", "outcome", "size_bytes"]
    outcomes = union_all([tagged.where("outcome <> 'accepted'").select(*columns), contained.select(*columns),
                          recovered.select("image_id", F.lit("accepted").alias("outcome"), "size_bytes")])
    totals = pay.session_totals(outcomes).drop("prefiltered", "allocated_skipped")
    scanned = images.select("image_id", F.col("size").alias("bytes_scanned"))
    summary = (
        scanned.join(totals, "image_id", "left").join(counters, "image_id", "left")
        .withColumn("recovery_rate_ppm", rate_ppm(F.coalesce("bytes_recovered", F.lit(0)), F.col("bytes_scanned")))
        .join(pay.category_counts(recovered, "category"), "image_id", "left")
        .join(pay.category_counts(recovered, "recovery_method"), "image_id", "left")
    )
    extents = merge_extents(
        recovered.select("image_id", F.col("offset").alias("start"), (F.col("offset") + F.col("size_bytes") - 1).alias("end"))
    )
    return CarveResult(recovered, rejected, summary, extents)


#: Bytes that a payload column can hold, and those read as one piece.
CELL = (1 << 31) - (1 << 20)
PIECE = 64 << 20


def structure_payloads(files: DataFrame, spans: DataFrame, images: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """Deleted files with their bytes: resident content, or their spans read and joined in file order.

    Sparse pieces read as zeros. The payload is named by what it contains when it has no extension. A truncated file has
    its first bytes, no digest. A file longer than a column's cell (``CELL``) has its size, but neither payload nor
    digest: ``too_long`` says so, and its spans hold all of it.
    """
    signatures = signature_table(images.sparkSession) if signatures is None else signatures
    paths = images.select("image_id", "path")
    sizes = spans.groupBy("image_id", "record_num").agg(F.sum("length").alias("__long")).where(F.col("__long") > CELL)
    spans = spans.join(sizes, ["image_id", "record_num"], "left_anti")
    spans = spans.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(PIECE).cast("long")))).withColumns({
        "file_offset": F.col("file_offset") + F.col("__at"), "offset": F.col("offset") + F.col("__at"),
        "length": F.least(F.col("length") - F.col("__at"), F.lit(PIECE)),
    })
    placed = spans.where(~F.col("is_sparse")).join(paths, "image_id")
    pieces = read_ranges(placed.select("image_id", "record_num", "file_offset", "path", "offset", "length"), "piece").select(
        "image_id", "record_num", "file_offset", "piece"
    )
    holes = spans.where("is_sparse").select(
        "image_id", "record_num", "file_offset", F.unhex(F.repeat(F.lit("00"), F.col("length").cast("int"))).alias("piece")
    )
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("file_offset", "piece"))), F.unhex(F.lit("")), lambda acc, p: F.concat(acc, p["piece"])
    )
    assembled = pieces.unionByName(holes).groupBy("image_id", "record_num").agg(joined.alias("__body"))
    whole = files.join(assembled, ["image_id", "record_num"], "left").withColumn("payload", F.coalesce("resident_data", "__body"))
    whole = whole.join(sizes, ["image_id", "record_num"], "left")
    named = sniff(whole.where((F.octet_length("payload") > 0) | F.col("__long").isNotNull()), signatures)
    suffix = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]{1,8})$", 1))
    return named.select(
        "image_id", "record_num", F.col("name").alias("original_name"), F.col("path").alias("original_path"),
        F.coalesce(F.nullif(suffix, F.lit("")), "sniffed.extension", F.lit("bin")).alias("extension"),
        F.coalesce("sniffed.category", F.lit("custom")).alias("category"), F.col("first_data_offset").alias("offset"),
        F.coalesce(F.octet_length("payload").cast("long"), "__long").alias("size_bytes"),
        F.when(~F.col("truncated"), F.sha2("payload", 256)).alias("sha256"), "truncated", F.col("__long").isNotNull().alias("too_long"), "fragment_count",
        (F.col("fragment_count") > 1).alias("is_fragmented"), F.col("mft_changed").alias("deleted_at"),
        provenance(F.col("fs_type") if "fs_type" in files.columns else F.lit("ntfs"), F.col("path")).alias("provenance"), F.lit("filesystem_metadata").alias("boundary_method"),
        F.lit("filesystem_structure").alias("recovery_method"), "payload",
    )


def combine_recoveries(structure: DataFrame, signature: DataFrame) -> DataFrame:
    """Structure recoveries first, then signature recoveries that do not repeat a payload. Without a digest nothing repeats."""
    staged = union_all(
        [structure.withColumn("stage_no", F.lit(0)).withColumn("ord", F.col("record_num").cast("long")), signature.withColumn("stage_no", F.lit(1))]
    )
    staged = staged.withColumn("__digest", F.coalesce("sha256", F.concat_ws("-", "stage_no", "ord")))
    return pay.dedupe_payloads(staged, ["image_id"], "__digest", ["stage_no", "ord"]).drop("__digest")
