"""Registered queries over image windows, footers, free space and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog.common import payloads, table
from tracewell.functions import provenance as pv
from tracewell.functions.bits import uint
from tracewell.functions.structure import validate_structure
from tracewell.operators import fragments as fr
from tracewell.operators import freespace
from tracewell.operators.boundaries import declared_boundary
from tracewell.operators.scan import Pattern, count_needles, scan_blocks
from tracewell.session import spread
from tracewell.plans.asof import first_at_or_after, latest_at_or_before

_PATTERNS = [b"<div", b"</div>", b"e", b"aa", b"</p>", b"%PDF-", b"href"]
_BLOCK, _TAIL = 1000, 16


def page_blocks(spark: SparkSession, sf_dir: str, block: int = _BLOCK, tail: int = _TAIL) -> DataFrame:
    """Pages as images cut into small windows with their overlap, so patterns straddle edges."""
    pages = spread(table(spark, sf_dir, "pages"), "page_id").select(F.col("page_id").cast("string").alias("image_id"), F.encode("html", "UTF-8").alias("html"))
    size = F.octet_length("html")
    cut = pages.where(size > 0).select(
        "image_id", "html", F.explode(F.sequence(F.lit(0), F.expr(f"(octet_length(html) - 1) div {block}"))).alias("block_no")
    )
    start = F.col("block_no") * block
    body = F.col("html").substr(start + 1, F.lit(block))
    return cut.select(
        "image_id", F.col("block_no").cast("long").alias("block_no"), start.cast("long").alias("offset"),
        F.octet_length(body).alias("length"), body.alias("bytes"), F.col("html").substr(start + block + 1, F.lit(tail)).alias("tail"),
    )


def signature_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan_blocks(page_blocks(spark, sf_dir), [Pattern(i, p) for i, p in enumerate(_PATTERNS)])
    return hits.groupBy(F.col("image_id").cast("long").alias("page_id"), "pattern").agg(
        F.count("*").alias("hits"), F.sum("offset").alias("offset_sum"), F.min("offset").alias("first_hit")
    )


def needle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_needles(page_blocks(spark, sf_dir), [b"<div", b"</p>", b"href"])
    return counted.groupBy(F.decode("needle", "UTF-8").alias("needle")).agg(F.sum("hits").alias("hits"), F.count("*").alias("pages"))


def _tag_positions(spark: SparkSession, sf_dir: str, tag: bytes) -> DataFrame:
    hits = scan_blocks(page_blocks(spark, sf_dir), [Pattern(0, tag)])
    return hits.select("image_id", "offset")


def next_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paragraph's nearest end; 2,000 bytes is the largest size of the format, which the operator takes as input."""
    heads, feet = _tag_positions(spark, sf_dir, b"<p>"), _tag_positions(spark, sf_dir, b"</p>")
    near = first_at_or_after(heads, feet, ["image_id"], F.col("offset"), "offset", F.col("offset"), "foot", width=1 << 12)
    kept = F.when(F.col("foot") < F.col("offset") + 2000, F.col("foot"))
    return near.select(F.col("image_id").cast("long").alias("page_id"), "offset", kept.alias("footer"))


def last_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last end within the format's largest size, 2,000 bytes, from each paragraph's start."""
    heads, feet = _tag_positions(spark, sf_dir, b"<p>"), _tag_positions(spark, sf_dir, b"</p>")
    far = latest_at_or_before(heads, feet, ["image_id"], F.col("offset") + 2000, "offset", F.col("offset"), "foot", width=1 << 12)
    kept = F.when(F.col("foot") >= F.col("offset"), F.col("foot"))
    return far.select(F.col("image_id").cast("long").alias("page_id"), "offset", kept.alias("footer"))


def bitmap_free_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as allocation units, large parts free, packed into bitmap words of a brand's partition."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("unit"), (F.col("p_size") > 20).alias("free"), F.expr("p_partkey div 64").alias("word")
    )
    bit = F.pmod(F.col("unit"), F.lit(64))
    words = parts.groupBy("word").agg(
        F.bit_or(F.when(~F.col("free"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).otherwise(F.lit(0).cast("long"))).alias("bits"),
        F.count("*").alias("n_units"),
    )
    digits = F.lpad(F.hex("bits"), 16, "0")
    little = F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])
    rows = words.select(
        F.lit("disk").alias("image_id"), F.lit(0).alias("part_no"), (F.col("word") * 64).alias("first_unit"), "n_units",
        F.unhex(little).alias("bits"), F.lit(4096).alias("unit_bytes"), F.lit(1 << 20).alias("base"),
    )
    return freespace.bitmap_to_ranges(rows).select(F.col("start").alias("free_start"), F.col("end").alias("free_end"))


def free_space_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as free clusters of their supplier's partition, at their order's place, summed up per partition."""
    lines = table(spark, sf_dir, "lineitem")
    units = lines.select(
        F.lit("disk").alias("image_id"), (F.col("l_suppkey") % 10).cast("int").alias("part_no"), F.col("l_orderkey").alias("unit"),
        F.lit(512).alias("unit_bytes"), F.lit(0).alias("base"),
    )
    ranges = freespace.units_to_ranges(units)
    parts = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).cast("int").alias("part_no")).distinct().select(
        F.lit("disk").alias("image_id"), "part_no", F.lit(0).alias("start"), F.lit(1 << 32).alias("end"), (F.col("part_no") != 3).alias("reliable"),
        F.lit("fat32").alias("fs_type"),
    )
    return freespace.free_summary(ranges, parts).select("part_no", "free_bytes", "range_count", "coverage_ppm", "reliable")


def declared_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as payloads behind a bitmap header that declares its length from the table."""
    def le32(value):
        digits = F.lpad(F.hex(value), 8, "0")
        return F.concat(*[F.substring(digits, 7 - 2 * i, 2) for i in range(4)])

    docs = table(spark, sf_dir, "documents")
    header = F.unhex(F.concat(F.lit("424D"), le32(F.col("n_chars")), F.lit("00000000"), le32(F.lit(54)), le32(F.when(F.col("lang") == "de", 41).otherwise(40)), F.lit("00" * 8)))
    found = docs.select("doc_id", declared_boundary(header, F.lit("bmp"), F.lit(1000), F.lit(1000 + 20000)).alias("b"))
    return found.select("doc_id", F.col("b.end").alias("end_offset"), "b.method", F.col("b.notes")[0].alias("note"))


def structure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents tested as several formats: text is none of them, and unchecked formats pass on size."""
    ext = F.when(F.col("lang") == "en", "png").when(F.col("lang") == "fr", "bmp").when(F.col("lang") == "de", "rtf").otherwise("tar")
    gated = payloads(spark, sf_dir).withColumn("extension", ext).select(
        "extension", "payload", validate_structure(F.col("payload"), F.col("extension")).alias("g")
    )
    return gated.groupBy("extension", F.coalesce("g.ok", F.lit(False)).alias("ok")).agg(F.count("*").alias("n"))


def binary_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = payloads(spark, sf_dir)
    body = F.col("payload")
    return docs.select(
        "doc_id", uint(body, 0, 2).alias("le16"), uint(body, 4, 4).alias("le32"), uint(body, 4, 4, "big").alias("be32"),
        uint(body, 8, 8).cast("string").alias("le64"),
    )


def two_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sample-table indexes, line items as media boxes of the predicted payload length."""
    indexes = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("image_id"), (F.col("o_orderkey") * 100).alias("start"), (F.col("o_orderkey") * 100 + 60).alias("index_end"),
        F.when(F.col("o_orderstatus") == "F", 68).otherwise(F.when(F.col("o_orderstatus") == "O", 68).otherwise(70)).cast("long").alias("media_start"),
        (F.col("o_totalprice").cast("long") % 50 + 1).alias("media_len"), "o_orderkey",
    )
    media = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("image_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("box_start"), F.lit(8).alias("header"),
        F.col("l_quantity").cast("long").alias("payload_len"),
    ).distinct()
    return fr.two_fragment_match(indexes, media).select("o_orderkey", "box_start", "box_size", "gap_bytes")


def index_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as index rows of their supplier's file, orders as the chunks they should land on."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("file_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"), F.col("l_returnflag").alias("chunk_id"),
        F.col("l_partkey").alias("offset"), (F.col("l_linestatus") == "X").alias("is_list"),
    ).distinct()
    chunks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file_id"), (F.col("l_partkey") + F.when(F.col("l_suppkey") % 2 == 0, 5).otherwise(0)).alias("offset")).agg(
        F.min("l_returnflag").alias("fourcc")
    ).withColumn("list_type", F.lit(None).cast("string"))
    bases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.lit(5).alias("base"))
    return fr.resolve_index_base(rows, chunks, bases)


def name_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = F.when(F.col("role") == "user", "ntfs").when(F.col("role") == "system", "exfat").otherwise("fat32")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", pv.provenance(fs, F.col("text")).alias("p"))
    return rows.select("conv_id", "turn", "p.name_source", "p.name_is_verified", "p.path_source", "p.path_is_recovered", F.length("p.path").alias("path_length"))


QUERIES = {
    "signature_hits": signature_hits,
    "needle_counts": needle_counts,
    "next_footer": next_footer,
    "last_footer": last_footer,
    "bitmap_free_runs": bitmap_free_runs,
    "free_space_summary": free_space_summary,
    "declared_sizes": declared_sizes,
    "structure_gate": structure_gate,
    "binary_fields": binary_fields,
    "two_fragments": two_fragments,
    "index_base": index_base,
    "name_provenance": name_provenance,
}


def _positions(tag: str) -> str:
    """Byte positions of a tag in every page, by its hex text at even positions."""
    hexed = tag.encode().hex().upper()
    return f"""SELECT page_id, i AS o FROM (SELECT page_id, hex(encode(html)) AS h, unnest(range(octet_length(encode(html)))) AS i FROM pages)
  WHERE substr(h, 2 * i + 1, {len(hexed)}) = '{hexed}'"""


_ALL = " UNION ALL ".join(f"SELECT page_id, {i} AS pattern, o FROM ({_positions(p.decode())})" for i, p in enumerate(_PATTERNS))

SQL = {
    "signature_hits": f"""SELECT page_id, CAST(pattern AS INTEGER) AS pattern, count(*) AS hits, CAST(sum(o) AS BIGINT) AS offset_sum, min(o) AS first_hit
FROM ({_ALL}) GROUP BY 1, 2""",
    "needle_counts": """SELECT needle, CAST(sum(n) AS BIGINT) AS hits, count(*) AS pages FROM (
  SELECT page_id, needle, (length(html) - length(replace(html, needle, ''))) // length(needle) AS n
  FROM pages, (VALUES ('<div'), ('</p>'), ('href')) v(needle)) WHERE n > 0 GROUP BY needle""",
    "next_footer": f"""WITH a AS ({_positions("<p>")}), b AS ({_positions("</p>")})
SELECT a.page_id, a.o AS "offset", (SELECT min(b.o) FROM b WHERE b.page_id = a.page_id AND b.o >= a.o AND b.o < a.o + 2000) AS footer FROM a""",
    "last_footer": f"""WITH a AS ({_positions("<p>")}), b AS ({_positions("</p>")})
SELECT a.page_id, a.o AS "offset", (SELECT max(b.o) FROM b WHERE b.page_id = a.page_id AND b.o >= a.o AND b.o <= a.o + 2000) AS footer FROM a""",
    "bitmap_free_runs": """WITH f AS (SELECT p_partkey AS u, p_partkey - row_number() OVER (ORDER BY p_partkey) AS g FROM part WHERE p_size > 20)
SELECT 1048576 + min(u) * 4096 AS free_start, 1048576 + (max(u) + 1) * 4096 AS free_end FROM f GROUP BY g""",
    "free_space_summary": """
WITH u AS (SELECT DISTINCT l_suppkey % 10 AS p, l_orderkey AS u FROM lineitem),
g AS (SELECT p, u, u - row_number() OVER (PARTITION BY p ORDER BY u) AS g FROM u),
s AS (SELECT p, count(*) * 512 AS free_bytes, count(DISTINCT g) AS range_count FROM g GROUP BY p)
SELECT CAST(q.p AS INTEGER) AS part_no, coalesce(free_bytes, 0) AS free_bytes, coalesce(range_count, 0) AS range_count,
  coalesce(free_bytes, 0) * 1000000 // 4294967296 AS coverage_ppm, q.p <> 3 AND coalesce(free_bytes, 0) > 0 AS reliable
FROM (SELECT DISTINCT s_suppkey % 10 AS p FROM supplier) q LEFT JOIN s ON s.p = q.p""",
    "declared_sizes": """
WITH d AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'BMP DIB header size 41 is not a known variant'
  WHEN n_chars < 26 OR n_chars <= 54 THEN 'BMP declared size inconsistent with pixel offset'
  WHEN n_chars > 20000 THEN 'BMP declared size ' || n_chars || ' outside carve bounds' END AS bad, n_chars FROM documents)
SELECT doc_id, CASE WHEN bad IS NULL THEN 1000 + n_chars END AS end_offset, CASE WHEN bad IS NULL THEN 'declared_size' ELSE 'undetermined' END AS method,
  coalesce(bad, 'BMP declares total size ' || n_chars || ' at offset 2') AS note FROM d""",
    "structure_gate": """
WITH d AS (SELECT CASE lang WHEN 'en' THEN 'png' WHEN 'fr' THEN 'bmp' WHEN 'de' THEN 'rtf' ELSE 'tar' END AS extension, octet_length(encode(text)) AS n,
  hex(encode(text)) AS h, text FROM documents)
SELECT extension, n >= 16 AND (extension = 'rtf' OR (extension = 'tar' AND
    regexp_matches(substr(h, 1, 2), '^(3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|2E|2F)$') AND n <= 124)) AS ok, count(*) AS n FROM d GROUP BY 1, 2""",
    "binary_fields": """
WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
b AS (SELECT doc_id, length(h) // 2 AS n, list_transform(range(16), lambda i: CAST(('0x' || CASE WHEN length(h) >= 2 * i + 2 THEN substr(h, 2 * i + 1, 2) ELSE '00' END) AS BIGINT)) AS v FROM d)
SELECT doc_id, CASE WHEN n >= 2 THEN v[1] + 256 * v[2] END AS le16,
  CASE WHEN n >= 8 THEN v[5] + 256 * v[6] + 65536 * v[7] + 16777216 * v[8] END AS le32,
  CASE WHEN n >= 8 THEN v[8] + 256 * v[7] + 65536 * v[6] + 16777216 * v[5] END AS be32,
  CASE WHEN n >= 16 THEN CAST(v[9] + 256 * v[10] + 65536 * v[11] + 16777216 * v[12] + CAST(4294967296 AS HUGEINT) * (v[13] + 256 * v[14] + 65536 * v[15] + 16777216 * v[16]) AS VARCHAR) END AS le64
FROM b""",
    "two_fragments": """
WITH i AS (SELECT o_orderkey, o_custkey % 50 AS img, o_orderkey * 100 + 60 AS e, CAST(trunc(o_totalprice) AS BIGINT) % 50 + 1 AS len FROM orders WHERE o_orderstatus IN ('F', 'O')),
m AS (SELECT DISTINCT l_suppkey % 50 AS img, l_orderkey * 100 + l_linenumber AS s, CAST(trunc(l_quantity) AS BIGINT) AS len FROM lineitem),
f AS (SELECT o_orderkey, any_value(e) AS e, any_value(i.len) AS len, min(s) AS s FROM i JOIN m ON m.img = i.img AND m.len = i.len AND m.s >= i.e GROUP BY o_orderkey)
SELECT o_orderkey, s AS box_start, len + 8 AS box_size, s - e AS gap_bytes FROM f WHERE s <> e""",
    "index_base": """
WITH r AS (SELECT DISTINCT l_suppkey AS f, l_orderkey, l_linenumber, l_returnflag AS c, l_partkey AS o FROM lineitem),
k AS (SELECT l_suppkey AS f, l_partkey + CASE WHEN l_suppkey % 2 = 0 THEN 5 ELSE 0 END AS o, min(l_returnflag) AS c FROM lineitem GROUP BY 1, 2),
h AS (SELECT r.f, count(*) AS n, count(*) FILTER (WHERE a.c = r.c) AS ab, count(*) FILTER (WHERE b.c = r.c) AS re
  FROM r LEFT JOIN k a ON a.f = r.f AND a.o = r.o LEFT JOIN k b ON b.f = r.f AND b.o = r.o + 5 GROUP BY r.f)
SELECT f AS file_id, n AS entries, re AS hits_relative, ab AS hits_absolute, CASE WHEN re > ab THEN 'relative' WHEN ab > re THEN 'absolute' END AS base_mode,
  CAST(CASE WHEN re > ab THEN 5 WHEN ab > re THEN 0 END AS BIGINT) AS base FROM h""",
    "name_provenance": """
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'deleted-directory-entry' WHEN 'system' THEN 'deleted-directory-entry' ELSE 'adjacency-only' END AS name_source,
  FALSE AS name_is_verified, CASE WHEN text <> '' AND role = 'user' THEN 'ntfs-file-name-attribute' ELSE 'not-recoverable' END AS path_source,
  coalesce(text, '') <> '' AS path_is_recovered, CAST(length(text) AS INTEGER) AS path_length FROM conversations""",
}
