"""Where each candidate ends: declared lengths, chain walks, and footers found by as-of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import chains
from tracewell.functions.bits import uint
from tracewell.plans.asof import first_at_or_after, latest_at_or_before
from tracewell.plans.prefix import union_all
from tracewell.sources.images import image_opener, read_ranges

# The least file, and how far from a window's end a ZIP end record may lie (its longest comment).
MIN_WINDOW = 16
ZIP_TAIL = 65557 + 22
POSITION_BUCKET = 1 << 28
HEAD_BYTES = 8192

#: Marker patterns the footer rules need; the scan looks for them next to the signatures.
MARKERS = {"pdf": b"%%EOF", "zip": b"PK\x05\x06"}

_EXTRA_RULES: dict[str, Callable] = {}


def register_boundary(extension: str, rule: Callable[[chains.Read, int, int], chains.Verdict]) -> None:
    """Add or replace the chain rule of an extension: ``rule(read, start, limit) -> (end, method, note)``."""
    _EXTRA_RULES[extension.lower().lstrip(".")] = rule


def _verdict(end: Column, method: str, note: Column) -> Column:
    return F.struct(end.cast("long").alias("end"), F.lit(method).alias("method"), F.array(note).alias("notes"))


def undetermined(note: Column | str) -> Column:
    text = F.lit(note) if isinstance(note, str) else note
    return F.struct(F.lit(None).cast("long").alias("end"), F.lit(chains.NONE).alias("method"), F.array(text).alias("notes"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _declared(head: Column, start: Column, limit: Column) -> dict[str, Column]:
    """Rules of formats that state their own length, evaluated on the head of the file."""

    def u(offset: int, width: int, endian: str = "little") -> Column:
        value = uint(head, offset, width, endian)
        # A 64-bit field above the signed range is a lie, not a length: null fails every check of it.
        return value.try_cast("long") if width == 8 else value

    def sized(size: Column, least: int, ok: list[tuple[Column, Column | str]], note: Column, outside: Column, needs: int, name: str) -> Column:
        end = start + size
        result = F.when(F.octet_length(head) < needs, undetermined(f"{name} header truncated"))
        for good, complaint in ok:
            result = result.when(~F.coalesce(good, F.lit(False)), undetermined(complaint))
        return result.when((size < least) | (end > limit), undetermined(outside)).otherwise(_verdict(end, chains.DECLARED, note))

    bmp_size, dib, pixels = u(2, 4), u(14, 4), u(10, 4)
    bmp = sized(
        bmp_size, 26,
        [
            (u(6, 4) == 0, "BMP reserved field non-zero"),
            (dib.isin(12, 40, 52, 56, 64, 108, 124), _text("BMP DIB header size ", dib, " is not a known variant")),
            ((bmp_size >= 26) & (pixels < bmp_size), "BMP declared size inconsistent with pixel offset"),
        ],
        _text("BMP declares total size ", bmp_size, " at offset 2"),
        _text("BMP declared size ", bmp_size, " outside carve bounds"), 26, "BMP",
    )
    riff_size = u(4, 4)
    riff = sized(
        riff_size + 8, 12, [], _text("RIFF declares ", riff_size, " bytes of chunks"),
        _text("RIFF declared size ", riff_size, " outside carve bounds"), 12, "RIFF",
    )
    next_off, next_size = u(12, 8), u(20, 8)
    seven_size = next_off + next_size + 32
    top = 1 << 40
    seven = sized(
        seven_size, 32, [(F.coalesce((next_off <= top) & (next_size <= top), F.lit(False)), "7z next-header offsets implausible")],
        _text("7z declares ", seven_size, " bytes (32 + nextHeaderOffset + nextHeaderSize)"),
        _text("7z declared size ", seven_size, " outside carve bounds"), 32, "7z",
    )
    raw_page = u(16, 2, "big")
    page = F.when(raw_page == 1, 65536).otherwise(raw_page)
    pages = u(28, 4, "big")
    sqlite = sized(
        pages * page, 512,
        [
            ((page >= 512) & (page.bitwiseAND(page - 1) == 0), _text("SQLite page size ", page, " is not a power of two in 512..65536")),
            (
                u(24, 4, "big") == u(92, 4, "big"),
                "SQLite change counter != version-valid-for: database header is stale, the on-disk page count cannot be trusted",
            ),
            (pages != 0, "SQLite in-header page count is zero"),
        ],
        _text("SQLite header: ", pages, " pages x ", page, " B = ", pages * page, " bytes"),
        _text("SQLite declared size ", pages * page, " exceeds the carve window"), 100, "SQLite",
    )
    form, aiff_size = F.hex(head.substr(9, 4)), u(4, 4, "big")
    aiff = sized(
        aiff_size + 8, 16, [(form.isin("41494646", "41494643"), "FORM type is not AIFF")],
        _text("FORM declares ", aiff_size, " bytes"), _text("FORM declared size ", aiff_size, " outside carve bounds"), 12, "FORM",
    )
    return {"bmp": bmp, "wav": riff, "webp": riff, "avi": riff, "7z": seven, "sqlite": sqlite, "aiff": aiff}


def declared_boundary(head: Column, extension: Column, start: Column, limit: Column) -> Column:
    """Boundary of a self-declaring format; null when the extension needs another rule."""
    result = F.lit(None).cast("struct<end:bigint,method:string,notes:array<string>>")
    open_riff = extension.isin("wav", "webp", "avi") & (F.hex(head.substr(5, 4)) == "FFFFFFFF")
    for ext, rule in _declared(head, start, limit).items():
        result = F.when((extension == ext) & ~F.coalesce(open_riff, F.lit(False)), rule).otherwise(result)
    return result


def walk_boundaries(candidates: DataFrame) -> DataFrame:
    """Chain-walk the candidates ``(image_id, path, offset, extension, limit)`` and append ``boundary``.

    Each task opens the images of its candidates and reads only unit headers. Candidates are spread
    by position, so one image with most of the candidates is worked on by many tasks.
    """
    rules = {ext: partial(chains.walk, ext) for ext in chains.LAYOUTS} | _EXTRA_RULES
    schema = candidates.withColumn("boundary", undetermined("")).schema

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = image_opener()
        for batch in batches:
            found = []
            for path, offset, extension, limit in zip(batch["path"], batch["offset"], batch["extension"], batch["limit"]):
                try:
                    end, method, note = rules[extension](opened(path).read, int(offset), int(limit))
                except (ValueError, IndexError, OverflowError) as exc:
                    end, method, note = None, chains.NONE, f"boundary rule for .{extension} failed: {exc}"
                found.append({"end": end, "method": method, "notes": [note]})
            yield batch.assign(boundary=found)

    # Without a number of its own the shuffle follows the session and adaptive execution.
    placed = candidates.repartition("image_id", F.expr(f"offset div {64 << 20}"))
    return placed.mapInPandas(walk, schema)


def pdf_boundaries(candidates: DataFrame, markers: DataFrame) -> DataFrame:
    """The last end marker within the window, with the line ends that follow it."""
    last = latest_at_or_before(
        candidates, markers, ["image_id"], F.col("limit") - 5, "offset", F.col("offset"), "__eof", width=POSITION_BUCKET
    )
    hit = F.col("__eof").isNotNull() & (F.col("__eof") >= F.col("offset"))
    after = read_ranges(
        last.where(hit).select("image_id", "path", (F.col("__eof") + 5).alias("offset"), F.lit(256).alias("length")).distinct(), "after"
    ).select("image_id", (F.col("offset") - 5).alias("__eof"), F.octet_length(F.unhex(F.regexp_extract(F.hex("after"), "^(?:0A|0D)*", 0))).alias("__nl"))
    joined = last.join(after, ["image_id", "__eof"], "left")
    end = F.col("__eof") + 5 + F.coalesce("__nl", F.lit(0))
    found = _verdict(end, chains.FOOTER, F.lit("last %%EOF within the carve window"))
    return joined.withColumn("boundary", F.when(hit, found).otherwise(undetermined("no %%EOF within the carve window"))).drop("__eof", "__nl")


def zip_boundaries(candidates: DataFrame, markers: DataFrame) -> DataFrame:
    """The end record whose directory offsets agree with the archive's start, else the nearest one.

    A record names its own archive: ``offset - directory offset - directory size`` is the start, so the
    right record is found by an equi-join however many archives lie in between. Only without such a
    record is the last one near the window's end, or else the first behind the start, taken.
    """
    records = read_ranges(markers.select("image_id", "path", "offset", F.lit(22).alias("length")).distinct(), "rec").where(
        F.octet_length("rec") == 22
    ).select(
        "image_id", "offset", uint(F.col("rec"), 12, 4).alias("cd_size"), uint(F.col("rec"), 16, 4).alias("cd_off"),
        uint(F.col("rec"), 20, 2).alias("comment"),
    )
    info = F.struct("offset", "cd_size", "cd_off", "comment")
    sound = (F.col("cd_off") != 0) & (F.col("cd_off") != 0xFFFFFFFF) & (F.col("cd_size") != 0xFFFFFFFF)
    exact = records.where(sound).select(
        "image_id", (F.col("offset") - F.col("cd_off") - F.col("cd_size")).alias("__start"), info.alias("__exact")
    ).groupBy("image_id", "__start").agg(F.max("__exact").alias("__exact"))
    joined = candidates.join(
        exact, (candidates["image_id"] == exact["image_id"]) & (candidates["offset"] == exact["__start"]), "left"
    ).drop(exact["image_id"])
    joined = joined.withColumn("__exact", F.when(F.col("__exact.offset") < F.col("limit"), F.col("__exact"))).drop("__start")
    near = latest_at_or_before(joined, records, ["image_id"], F.col("limit") - 4, "offset", info, "__near", width=POSITION_BUCKET)
    first = first_at_or_after(near, records, ["image_id"], F.col("offset"), "offset", info, "__first", width=POSITION_BUCKET)
    close = F.when(
        (F.col("__near.offset") >= F.col("limit") - ZIP_TAIL) & (F.col("__near.offset") >= F.col("offset")), F.col("__near")
    )
    reach = F.when(F.col("__first.offset") < F.col("limit"), F.col("__first"))
    rec = F.coalesce("__exact", close, reach)
    note = _text("ZIP EOCD: ", rec["cd_size"], " bytes of central directory at +", rec["cd_off"])
    agree = F.when(
        F.col("__exact").isNotNull(), F.lit("central directory offsets are self-consistent with this archive's start")
    ).otherwise(F.lit("no EOCD had offsets consistent with this start; using the nearest, so the end offset may belong to a later archive"))
    found = F.struct(
        (rec["offset"] + 22 + rec["comment"]).cast("long").alias("end"), F.lit(chains.FOOTER).alias("method"),
        F.array(note, agree).alias("notes"),
    )
    missing = undetermined("no end-of-central-directory record in range")
    return first.withColumn("boundary", F.when(rec.isNotNull(), found).otherwise(missing)).drop("__exact", "__near", "__first")


def custom_boundaries(candidates: DataFrame, footers: DataFrame) -> DataFrame:
    """Caller-supplied signatures: the declared terminator, else the declared maximum size as a guess.

    ``footers`` is ``(image_id, sig_rank, offset)``: each signature looks for its own terminator.
    """
    body = F.col("offset") + F.col("header_offset") + F.octet_length("header")
    hit = first_at_or_after(
        candidates, footers, ["image_id", "sig_rank"], body, "offset", F.col("offset"), "__foot", width=POSITION_BUCKET
    )
    end = F.col("__foot") + F.octet_length("footer")
    inside = F.col("__foot").isNotNull() & (end <= F.col("limit"))
    stop = F.least(F.col("offset") + F.col("window"), F.col("size"))
    guess = _text(
        "no boundary rule exists for .", F.col("extension"),
        " and the signature declares no terminator; carved to the declared max_size of ", F.col("window"), " bytes",
    )
    found = _text("terminator declared by the signature found ", end - F.col("offset"), " bytes in")
    boundary = F.when(inside, _verdict(end, chains.FOOTER, found)).otherwise(_verdict(stop, "max_size_fallback", guess))
    return hit.withColumn("boundary", boundary).drop("__foot")


def resolve_boundaries(
    candidates: DataFrame, markers: DataFrame | None = None, footers: DataFrame | None = None, optional_footers: bool = False
) -> DataFrame:
    """Append ``boundary`` to candidates ``(image_id, path, size, offset, extension, head, signature columns, max_file)``.

    ``markers`` holds hits of :data:`MARKERS` as ``(image_id, path, kind, offset)``, ``footers`` hits of
    custom terminators. Extensions without a rule stay undetermined, except custom ones; with
    ``optional_footers`` the built-in formats that only declare a footer are sized by it as well.
    """
    window = F.least(F.col("max_size"), F.col("max_file")).cast("long")
    rows = candidates.withColumn("window", window).withColumn("limit", F.least(F.col("size"), F.col("offset") + F.col("window")))
    ext = F.col("extension")
    declared = declared_boundary(F.col("head"), ext, F.col("offset"), F.col("limit"))
    rows = rows.withColumn("boundary", F.when(F.col("window") < MIN_WINDOW, undetermined("carve window smaller than the minimum file size")).otherwise(declared))
    done = rows.where(F.col("boundary").isNotNull())
    open_ = rows.where(F.col("boundary").isNull()).drop("boundary")
    walked = [*chains.LAYOUTS, *_EXTRA_RULES]
    parts = [done, walk_boundaries(open_.where(ext.isin(*walked)))]
    if markers is not None:
        for kind, rule in (("pdf", pdf_boundaries), ("zip", zip_boundaries)):
            parts.append(rule(open_.where(ext == kind), markers.where(F.col("kind") == kind)))
    handled = [*walked, *(MARKERS if markers is not None else [])]
    rest = open_.where(~ext.isin(*handled))
    sized = F.col("is_custom") | (F.col("footer").isNotNull() if optional_footers else F.lit(False))
    if footers is not None:
        parts.append(custom_boundaries(rest.where(sized), footers))
        rest = rest.where(~sized)
    parts.append(rest.withColumn("boundary", undetermined(_text("no boundary rule is registered for .", ext))))
    resolved = union_all(parts)
    found = F.col("boundary.end") - F.col("offset")
    outside = F.col("boundary.end").isNotNull() & ((found < F.col("min_size")) | (found > F.col("max_size")))
    complaint = _text("resolved size ", found, " outside the signature's [", F.col("min_size"), ", ", F.col("max_size"), "] bounds")
    keep = F.col("boundary.method") == "max_size_fallback"
    return resolved.withColumn("boundary", F.when(outside & ~keep, undetermined(complaint)).otherwise(F.col("boundary"))).drop("window", "limit")
