"""The signature dimension: built-in file signatures plus user-supplied JSON definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30

SCHEMA = T.StructType(
    [
        T.StructField("sig_rank", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("extension", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("header", T.BinaryType(), False),
        T.StructField("header_offset", T.IntegerType(), False),
        T.StructField("footer", T.BinaryType()),
        T.StructField("footer_offset_from_end", T.IntegerType(), False),
        T.StructField("min_size", T.LongType(), False),
        T.StructField("max_size", T.LongType(), False),
        T.StructField("fixed_size", T.LongType()),
        T.StructField("inbuilt", T.BinaryType()),
        T.StructField("inbuilt_window", T.IntegerType(), False),
        T.StructField("is_custom", T.BooleanType(), False),
    ]
)

# The file signatures, in table order.
# (name, extension, category, header, min_size, max_size, other fields)
BUILTIN = [
    ("JPEG Image", "jpg", "image", b"\xff\xd8\xff", 64, 64 * MB, {"footer": b"\xff\xd9"}),
    ("PNG Image", "png", "image", b"\x89PNG\r\n\x1a\n", 64, 64 * MB, {"footer": b"IEND\xaeB`\x82"}),
    ("GIF Image", "gif", "image", b"GIF8", 32, 32 * MB, {"footer": b"\x00\x3b"}),
    ("BMP Image", "bmp", "image", b"BM", 70, 512 * MB, {}),
    ("WebP Image", "webp", "image", b"RIFF", 32, 64 * MB, {"inbuilt": b"WEBP", "inbuilt_window": 16}),
    ("TIFF Image", "tiff", "image", b"II*\x00", 32, 512 * MB, {}),
    ("BigTIFF Image", "tiff", "image", b"II+\x00", 32, GB, {}),
    ("TIFF Image (Motorola)", "tiff", "image", b"MM\x00*", 32, 512 * MB, {}),
    ("BigTIFF Image (Motorola)", "tiff", "image", b"MM\x00+", 32, GB, {}),
    ("HEIF / AVIF Image (heic brand)", "heic", "image", b"ftypheic", 64, 512 * MB, {"header_offset": 4}),
    ("HEIF / AVIF Image (mif1 brand)", "heic", "image", b"ftypmif1", 64, 512 * MB, {"header_offset": 4}),
    ("HEIF / AVIF Image (avif brand)", "avif", "image", b"ftypavif", 64, 512 * MB, {"header_offset": 4}),
    ("JPEG 2000 Image", "jp2", "image", b"\x00\x00\x00\x0cjP  \r\n\x87\n", 64, 512 * MB, {}),
    ("SVG Vector Image", "svg", "image", b"<?xml", 64, 16 * MB, {"footer": b"</svg>", "inbuilt": b"<svg"}),
    ("PDF Document", "pdf", "document", b"%PDF-", 64, 256 * MB, {"footer": b"%%EOF"}),
    ("Microsoft Word 2007+", "docx", "archive", b"PK\x03\x04", 128, 512 * MB,
     {"footer": b"PK\x05\x06", "inbuilt": b"word/", "inbuilt_window": 8192}),
    ("Microsoft Excel 2007+", "xlsx", "archive", b"PK\x03\x04", 128, 512 * MB,
     {"footer": b"PK\x05\x06", "inbuilt": b"xl/", "inbuilt_window": 8192}),
    ("PowerPoint 2007+", "pptx", "archive", b"PK\x03\x04", 128, 512 * MB,
     {"footer": b"PK\x05\x06", "inbuilt": b"ppt/", "inbuilt_window": 8192}),
    ("ZIP / Office OpenXML / JAR / APK", "zip", "archive", b"PK\x03\x04", 64, 2 * GB, {"footer": b"PK\x05\x06"}),
    ("Legacy Office (OLE2 compound file)", "doc", "document", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 512, 2 * GB, {}),
    ("Rich Text Format", "rtf", "document", b"{\\rtf", 12, 256 * MB, {}),
    ("Windows Registry Hive", "dat", "database", b"regf", 4096, 512 * MB, {}),
    ("PCAP Packet Capture", "pcap", "document", b"\xd4\xc3\xb2\xa1", 24, 2 * GB, {}),
    ("PCAP Packet Capture (nanosecond)", "pcap", "document", b"\x4d\x3c\xb2\xa1", 24, 2 * GB, {}),
    ("PCAP (swapped byte order)", "pcap", "document", b"\xa1\xb2\xc3\xd4", 24, 2 * GB, {}),
    ("PCAP Next-Generation Capture", "pcapng", "document", b"\n\r\r\n", 32, 2 * GB, {}),
    ("GZIP Archive", "gz", "archive", b"\x1f\x8b\x08", 32, 2 * GB, {}),
    ("BZIP2 Archive", "bz2", "archive", b"BZh", 14, 2 * GB, {}),
    ("XZ / LZMA Archive", "xz", "archive", b"\xfd7zXZ\x00", 24, 2 * GB, {}),
    ("Zstandard Archive", "zst", "archive", b"\x28\xb5\x2f\xfd", 12, 2 * GB, {}),
    ("7-Zip Archive", "7z", "archive", b"7z\xbc\xaf'\x1c", 64, 2 * GB, {}),
    ("RAR Archive (v5)", "rar", "archive", b"Rar!\x1a\x07\x01\x00", 64, 2 * GB, {}),
    ("RAR Archive (v4)", "rar", "archive", b"Rar!\x1a\x07\x00", 64, 2 * GB, {}),
    ("tar Archive (ustar)", "tar", "archive", b"ustar", 1024, 2 * GB, {}),
    ("LZ4 Frame", "lz4", "archive", b"\x04\x22\x4d\x18", 16, 2 * GB, {}),
    ("ISO 9660 Image", "iso", "archive", b"\x01CD001", 20 * KB, 8 * GB, {"header_offset": 0x8001}),
    ("SQLite Database", "sqlite", "database", b"SQLite format 3\x00", 512, 4 * GB, {}),
    ("Berkeley DB Hash", "db", "database", b"\x61\x15\x06\x00", 4096, 2 * GB, {}),
    ("Microsoft Access Database", "mdb", "database", b"Standard Jet DB", 512, 2 * GB, {}),
    ("WAV Audio", "wav", "audio", b"RIFF", 64, 2 * GB, {"inbuilt": b"WAVE", "inbuilt_window": 16}),
    ("FLAC Lossless Audio", "flac", "audio", b"fLaC", 128, 2 * GB, {}),
    ("OGG Container", "ogg", "audio", b"OggS", 64, 2 * GB, {}),
    ("MIDI Sequence", "mid", "audio", b"MThd", 14, 16 * MB, {}),
    ("AIFF Audio", "aiff", "audio", b"FORM", 64, 2 * GB, {"inbuilt": b"AIFF", "inbuilt_window": 16}),
    ("MP3 Audio (MPEG-1 Layer III sync frame)", "mp3", "audio", b"\xff\xfb", 1024, 256 * MB, {}),
    ("MP3 Audio (MPEG-1 Layer II sync frame)", "mp3", "audio", b"\xff\xf5", 1024, 256 * MB, {}),
    ("MP3 Audio (MPEG-2 Layer III sync frame)", "mp3", "audio", b"\xff\xf3", 1024, 256 * MB, {}),
    ("MP3 Audio (MPEG-2.5 Layer III sync frame)", "mp3", "audio", b"\xff\xe3", 1024, 256 * MB, {}),
    ("MP4 / QuickTime / ISO-BMFF Container", "mp4", "video", b"ftyp", 128, 16 * GB, {"header_offset": 4}),
    ("AVI Video (RIFF)", "avi", "video", b"RIFF", 256, 16 * GB, {"inbuilt": b"AVI ", "inbuilt_window": 16}),
    ("MPEG Transport Stream", "ts", "video", b"G", 188, 64 * GB, {}),
    ("Matroska Video (EBML)", "mkv", "video", b"\x1a\x45\xdf\xa3", 1024, 64 * GB,
     {"inbuilt": b"matroska", "inbuilt_window": 64}),
    ("WebM Video (EBML)", "webm", "video", b"\x1a\x45\xdf\xa3", 1024, 64 * GB,
     {"inbuilt": b"webm", "inbuilt_window": 64}),
    ("Matroska Audio (EBML)", "mka", "audio", b"\x1a\x45\xdf\xa3", 512, 16 * GB,
     {"inbuilt": b"matroska", "inbuilt_window": 64}),
    ("ELF Executable", "elf", "executable", b"\x7fELF", 128, 2 * GB, {}),
    ("Windows PE Executable", "exe", "executable", b"MZ", 512, 2 * GB, {}),
    ("Windows PE DLL", "dll", "executable", b"MZ", 512, 2 * GB, {}),
    ("Mach-O 64-bit executable", "macho", "executable", b"\xcf\xfa\xed\xfe", 512, 2 * GB, {}),
    ("Mach-O 64-bit executable (little endian)", "macho", "executable", b"\xce\xfa\xed\xfe", 512, 2 * GB, {}),
    ("Java Class File", "class", "executable", b"\xca\xfe\xba\xbe", 20, 64 * MB, {}),
    ("Windows LNK Shortcut", "lnk", "system", b"L\x00\x00\x00\x01\x14\x02\x00", 64, 16 * MB, {}),
    ("Windows Prefetch", "pf", "system", b"SCCA", 64, 4 * MB, {}),
    ("Windows Event Log", "evtx", "system", b"ElfFile\x00", 68 * KB, 512 * MB, {}),
    ("Windows Shortcut (DOS/Windows shell link)", "url", "system", b"[InternetShortcut]", 16, 4 * MB, {}),
    ("Windows Desktop INI", "ini", "system", b"[Desktop]", 16, 1024 * MB, {}),
]

# The categories a custom signature may name.
CATEGORIES = ("image", "document", "archive", "audio", "video", "executable", "database", "system", "custom")

CUSTOM_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("extension", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("header", T.StringType()),
        T.StructField("header_hex", T.StringType()),
        T.StructField("footer", T.StringType()),
        T.StructField("footer_hex", T.StringType()),
        T.StructField("footer_offset_from_end", T.IntegerType()),
        T.StructField("min_size", T.LongType()),
        T.StructField("max_size", T.LongType()),
        T.StructField("fixed_size", T.LongType()),
        T.StructField("inbuilt", T.StringType()),
        T.StructField("inbuilt_hex", T.StringType()),
        T.StructField("inbuilt_search_window", T.IntegerType()),
    ]
)


def builtin_rows() -> list[tuple]:
    rows = []
    for rank, (name, ext, category, header, low, high, more) in enumerate(BUILTIN):
        rows.append(
            (rank, name, ext, category, header, more.get("header_offset", 0), more.get("footer"), 0, low, high, None,
             more.get("inbuilt"), more.get("inbuilt_window", 4096), False)
        )
    return rows


def parse_hex(text: Column) -> Column:
    """Bytes of a hex string: everything that is not a hex digit is dropped, odd lengths get a leading 0."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9a-fA-F]", "")
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    return F.unhex(even)


def _given(*columns: str) -> Column:
    """The first non-empty of several alternative fields."""
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in columns])


def custom_signatures(raw: DataFrame) -> DataFrame:
    """Shape custom definitions (``CUSTOM_SCHEMA``) as signature rows; a missing header is an error."""
    header = parse_hex(_given("header", "header_hex"))
    label = F.coalesce(_given("name"), F.lit("unnamed"))
    checked = F.when(F.length(header) > 0, header).otherwise(
        F.raise_error(
            F.concat(F.lit("Custom signature '"), label, F.lit("' requires valid non-empty header magic bytes"))
        ).cast("binary")
    )
    category = F.lower(F.coalesce(_given("category"), F.lit("custom")))
    extension = F.regexp_replace(F.lower(F.coalesce(_given("extension"), F.lit("bin"))), r"^\.+", "")
    footer, inbuilt = _given("footer", "footer_hex"), _given("inbuilt", "inbuilt_hex")
    return raw.select(
        (F.lit(len(BUILTIN)) + F.coalesce(F.col("sig_rank"), F.lit(0)) if "sig_rank" in raw.columns
         else F.lit(len(BUILTIN))).cast("int").alias("sig_rank"),
        F.coalesce(_given("name"), F.lit("Custom Signature")).alias("name"),
        extension.alias("extension"),
        F.when(category.isin(*CATEGORIES), category).otherwise(F.lit("custom")).alias("category"),
        checked.alias("header"),
        F.lit(0).alias("header_offset"),
        F.when(footer.isNotNull(), parse_hex(footer)).alias("footer"),
        F.coalesce("footer_offset_from_end", F.lit(0)).alias("footer_offset_from_end"),
        F.greatest(F.lit(1), F.coalesce("min_size", F.lit(64))).cast("long").alias("min_size"),
        F.coalesce("max_size", F.lit(256 * MB)).cast("long").alias("max_size"),
        F.when(F.col("fixed_size") != 0, F.col("fixed_size")).alias("fixed_size"),
        F.when(inbuilt.isNotNull(), parse_hex(inbuilt)).alias("inbuilt"),
        F.coalesce("inbuilt_search_window", F.lit(4096)).alias("inbuilt_window"),
        F.lit(True).alias("is_custom"),
    )


def signature_table(spark: SparkSession, custom_json: str | None = None) -> DataFrame:
    """Built-in signatures, plus those in a JSON file of custom definitions when given."""
    builtin = spark.createDataFrame(builtin_rows(), SCHEMA)
    if custom_json is None:
        return builtin
    # The file is configuration; its definitions are numbered in the order they stand in, as one array.
    text = spark.read.option("wholetext", True).text(custom_json)
    listed = F.from_json(F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]"))), T.ArrayType(CUSTOM_SCHEMA))
    raw = text.select(F.posexplode(listed).alias("sig_rank", "d")).select("sig_rank", "d.*")
    return builtin.unionByName(custom_signatures(raw))


def filter_extensions(df: DataFrame, wanted: list[str] | None, custom: list[str] | None = None) -> DataFrame:
    """Keep rows whose extension was asked for (case and leading dots ignored) or is a custom one."""
    if not wanted:
        return df
    names = {w.lower().lstrip(".") for w in wanted} | {c.lower().lstrip(".") for c in custom or []}
    return df.where(F.regexp_replace(F.lower("extension"), r"^\.+", "").isin(*sorted(names)))


def wanted_signatures(signatures: DataFrame, extensions: list[str] | None) -> DataFrame:
    """The signatures a caller asked for: those of the extensions, and every custom one; all if none is named."""
    if not extensions:
        return signatures
    names = {e.lower().lstrip(".") for e in extensions}
    return signatures.where(F.col("is_custom") | F.regexp_replace(F.lower("extension"), r"^\.+", "").isin(*sorted(names)))


def sniff(df: DataFrame, signatures: DataFrame, payload: str = "payload", ids: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Name a payload by its longest matching magic; table order breaks ties, inbuilt markers must be present.

    The signature table is configuration (a few dozen rows), so the matches are tested as one column
    expression per signature; the payload rows are neither shuffled nor multiplied.
    """
    rules = sorted(signatures.collect(), key=lambda r: (-len(r.header), r.sig_rank))
    body = F.col(payload)
    name, extension, category = (F.lit(None).cast("string") for _ in range(3))
    hits = []
    for rule in rules:
        fits = F.substring(body, rule.header_offset + 1, len(rule.header)) == F.lit(bytes(rule.header))
        if rule.inbuilt is not None:
            window = max(rule.inbuilt_window, len(rule.inbuilt))
            fits &= contains_bytes(F.substring(body, 1, window), bytes(rule.inbuilt))
        hits.append(
            F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.extension).alias("extension"),
                                  F.lit(rule.category).alias("category")))
        )
    found = F.coalesce(*hits) if hits else F.struct(name.alias("name"), extension.alias("extension"), category.alias("category"))
    return df.withColumn("sniffed", found)


def contains_bytes(haystack: Column, needle: bytes) -> Column:
    """Byte-exact containment: both sides go through a one-byte-per-character decoding."""
    return F.locate(needle.decode("latin-1"), F.decode(haystack, "ISO-8859-1")) > 0
