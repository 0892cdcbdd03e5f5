"""Confidence score of a structurally validated candidate, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.entropy import entropy_band

# Boundary methods with their weight and the words used in the report.
BOUNDARY_WEIGHT = {
    "declared_size": 25,
    "container_walk": 25,
    "frame_validated": 25,
    "decompressed": 23,
    "footer_anchored": 18,
    "sync_run": 12,
    "max_size_fallback": 8,
    "undetermined": 0,
}
BOUNDARY_LABEL = {
    "declared_size": "the format's own declared length",
    "container_walk": "a clean container-structure walk",
    "frame_validated": "a validated codec frame sequence",
    "decompressed": "the end of the decoded stream",
    "footer_anchored": "a matching format terminator",
    "sync_run": "a continuous packet sync run with no declared end",
    "max_size_fallback": "a heuristic guess (see note)",
}

# Expected entropy per (category, extension), then for uncompressed formats, then per category.
ENTROPY_BY_FORMAT = {
    ("image", "bmp"): (0.0, 7.2),
    ("image", "tiff"): (0.0, 8.01),
    ("audio", "wav"): (0.0, 7.4),
    ("audio", "aiff"): (0.0, 7.4),
    ("document", "rtf"): (1.0, 7.8),
    ("archive", "tar"): (0.0, 7.9),
}
UNCOMPRESSED = (
    "bmp", "wav", "aiff", "tar", "pcap", "pcapng", "sqlite", "rtf", "elf", "exe", "dll", "class", "macho", "tiff",
    "lnk", "pf", "url", "ini", "dat", "mid", "db", "mdb", "doc", "ts", "heic", "jp2",
)
UNCOMPRESSED_BAND = (0.0, 7.9)
ENTROPY_BY_CATEGORY = {
    "image": (0.5, 8.01),
    "archive": (0.5, 8.01),
    "audio": (0.5, 8.01),
    "video": (3.5, 8.01),
    "document": (1.0, 7.9),
}
ENTROPY_DEFAULT = (0.5, 8.01)


def _lookup(table: dict, key: Column) -> Column:
    flat: list[Column] = []
    for name, value in table.items():
        flat += [F.lit(name), F.lit(value)]
    return F.element_at(F.create_map(*flat), key)


def boundary_weight(method: Column) -> Column:
    return F.coalesce(_lookup(BOUNDARY_WEIGHT, method), F.lit(0))


def _expected(category: Column, extension: Column, side: int) -> Column:
    exact = _lookup({f"{c}|{e}": band[side] for (c, e), band in ENTROPY_BY_FORMAT.items()}, F.concat_ws("|", category, extension))
    plain = F.when(extension.isin(*UNCOMPRESSED), F.lit(UNCOMPRESSED_BAND[side]))
    broad = _lookup({c: band[side] for c, band in ENTROPY_BY_CATEGORY.items()}, category)
    return F.coalesce(exact, plain, broad, F.lit(ENTROPY_DEFAULT[side]))


def entropy_expectation(category: Column, extension: Column) -> Column:
    """``struct(lo, hi)`` of the entropy typical for a format."""
    return F.struct(_expected(category, extension, 0).alias("lo"), _expected(category, extension, 1).alias("hi"))


def two_places(value: Column) -> Column:
    """A double from 0 to 8 with two decimals, its exact binary value rounded, ties to even.

    ``format_string`` rounds the shortest decimal text and ties away from zero, so that 3.125 gave 3.13. Scaled by a power
    of two the value is an integer without loss; below 2**-10, where bits may fall off, no rounding border lies.
    """
    scale = F.when(value < 1, F.lit(2**62)).otherwise(F.lit(2**59)).cast("decimal(20,0)")
    units = F.when(value < 1, value * float(2**62)).otherwise(value * float(2**59)).cast("long").cast("decimal(20,0)") * 100
    whole = F.floor((units - units % scale) / scale).cast("long")
    twice = (units % scale) * 2
    hundredths = whole + F.when((twice > scale) | ((twice == scale) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def score_candidate(
    *,
    name: Column,
    extension: Column,
    category: Column,
    header: Column,
    header_offset: Column,
    min_size: Column,
    max_size: Column,
    payload: Column,
    entropy: Column,
    method: Column,
    notes: Column,
    has_valid_footer: Column,
) -> Column:
    """``struct(score INT, heuristics ARRAY<STRING>)``, clamped to 0-100.

    ``entropy`` is the sampled entropy of the payload. Scoring stops after the boundary step when
    nothing supports the end of the file.
    """
    ext = F.regexp_replace(F.lower(extension), r"^\.+", "")
    size = F.octet_length(payload)
    identity = payload.substr(header_offset + 1, F.octet_length(header)) == header
    where = F.when(header_offset == 0, F.lit("")).otherwise(F.concat(F.lit(" at offset "), header_offset.cast("string")))
    identity_text = F.concat(
        F.lit("Magic header confirmed"), where, F.lit(" and the payload parses as a structurally valid "), name, F.lit(" (+40)")
    )
    weight = boundary_weight(method)
    weighted = weight > 0
    resolved = weighted | has_valid_footer
    boundary_lines = (
        F.when(
            weighted,
            F.concat(
                F.array(F.concat(F.lit("End of file established by "), _lookup(BOUNDARY_LABEL, method), F.lit(" (+"),
                                 weight.cast("string"), F.lit(")"))),
                F.transform(F.coalesce(notes, F.array().cast("array<string>")), lambda n: F.concat(F.lit("  - "), n)),
            ),
        )
        .when(has_valid_footer, F.array(F.lit("End of file established by a matching format terminator (+18)")))
        .otherwise(F.array(F.lit("End of file was not independently resolvable (+0)")))
    )
    early = F.when(identity, 40).otherwise(0) + F.when(weighted, weight).when(has_valid_footer, 18).otherwise(0)

    fits = size.between(min_size, max_size)
    pretty = F.format_number(size, 0)
    size_line = F.when(
        fits, F.concat(F.lit("Size "), pretty, F.lit(" B is within the expected range for this format (+20)"))
    ).otherwise(F.concat(F.lit("Size "), pretty, F.lit(" B is outside the expected range for this format (-10)")))
    sized = F.when(fits, early + 20).otherwise(F.greatest(F.lit(0), early - 10))

    lo, hi = _expected(category, ext, 0), _expected(category, ext, 1)
    typical = entropy.between(lo, hi)
    constant = entropy < 1.0
    band = entropy_band(entropy)
    two = two_places(entropy)
    entropy_line = (
        F.when(typical, F.concat(F.lit("Entropy "), two, F.lit("/8.0 ("), band, F.lit(") is typical for this format (+15)")))
        .when(
            constant,
            F.concat(F.lit("Entropy "), two, F.lit("/8.0 is effectively constant: consistent with padding or an unwritten allocation (-8)")),
        )
        .otherwise(
            F.concat(
                F.lit("Entropy "), two, F.lit("/8.0 ("), band, F.lit(") is outside the typical "),
                F.format_string("%.1f-%.1f", lo, hi), F.lit(" band for this format (+8)"),
            )
        )
    )
    final = F.when(typical, sized + 15).when(constant, F.greatest(F.lit(0), sized - 8)).otherwise(sized + 8)

    score = F.when(resolved, F.least(F.lit(100), F.greatest(F.lit(0), final))).otherwise(early)
    opening = F.concat(F.when(identity, F.array(identity_text)).otherwise(F.array().cast("array<string>")), boundary_lines)
    lines = F.when(resolved, F.concat(opening, F.array(size_line, entropy_line))).otherwise(opening)
    return F.struct(score.cast("int").alias("score"), lines.alias("heuristics"))
