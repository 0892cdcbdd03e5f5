"""WARC derivative builder: response records to linked metadata and plain-text conversion records.

All column expressions: a response and its derivatives stay in one row until the last step, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "2020-01-01T00:00:00Z"
_BLOCK_TAGS = "p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|header|footer|nav|main|aside|title|head|body|html|blockquote|pre"
#: Named character references, ``&amp;`` last so that nothing is decoded twice.
_NAMED = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&middot;": "·", "&copy;": "©", "&reg;": "®",
    "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”",
}
#: A link's target: in double quotes, single quotes or none.
_LINK = r"""(?i)<a[ \t\r\n](?:[^>]*?[ \t\r\n"'])?href[ \t\r\n]*=[ \t\r\n]*("[^"]*"|'[^']*'|[^ \t\r\n"'>]+)"""
_NUMERIC = r"&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"


def _digest(column: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(column, 256))


def _urn(seed: Column) -> Column:
    """A record id that depends on ``seed`` alone, so that a task run again names its records as before."""
    h = F.sha2(seed, 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, *p) for p in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _numeric(text: str) -> Column:
    """Numeric character references of a column decoded; those that name no character become U+FFFD."""
    codes = F.regexp_extract_all(text, F.lit(_NUMERIC), F.lit(1))

    def char(code: Column) -> Column:
        number = F.when(F.lower(F.substring(code, 1, 1)) == "x", F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).cast("long")
        good = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(good, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")

    pieces = F.zip_with(F.split(text, _NUMERIC, -1), F.transform(codes, char), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit(""))))
    return F.when(F.contains(F.col(text), F.lit("&#")), F.array_join(pieces, "")).otherwise(F.col(text))


def _named(text: str) -> Column:
    """Named character references of a column decoded, but for the ampersand's."""
    out = F.col(text)
    for name, char in _NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(F.contains(F.col(text), F.lit("&")), out).otherwise(F.col(text))


def _stripped(html: Column) -> Column:
    """A page without comments, scripts, styles and tags, with a line end for every block."""
    text = F.regexp_replace(html, r"(?s)<!--.*?(-->|\z)", "")
    for tag in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{tag}([ \t\r\n][^>]*)?>.*?(</{tag}[ \t\r\n]*>|\z)", "")
    text = F.regexp_replace(text, rf"(?i)</?({_BLOCK_TAGS})([ \t\r\n/][^>]*)?>", "\n")
    return F.regexp_replace(text, r"<[a-zA-Z/!?][^>]*>", "")


def with_plain_text(rows: DataFrame, html: Column, name: str) -> DataFrame:
    """``rows`` with the readable text of pages: no markup, a line per block, blanks collapsed; null stays null.

    Each step that names its input several times reads a column of its own, so that no step is computed twice.
    """
    rows = rows.withColumn("_stripped", _stripped(html)).withColumn("_named", _named("_stripped")).withColumn("_decoded", _numeric("_named"))
    text = F.regexp_replace(F.replace("_decoded", F.lit("&amp;"), F.lit("&")), r"[ \t\r\f]+", " ")
    text = F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))
    return rows.withColumn(name, text).drop("_stripped", "_named", "_decoded")


def page_responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records (record_id, target_uri, date, http_header, payload) of crawled ``pages`` (page_id, url, html)."""
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    seed = F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), "url")
    return pages.select(_urn(seed).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), header.alias("http_header"), F.col("html").alias("payload"))


def derive(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records of ``responses`` (record_id, target_uri, date, http_header, payload as text).

    Returns warc_type, record_id, refers_to, target_uri, header, block, content_length and block_digest. Every
    response has a metadata record; HTML and other text also has a conversion record. Both refer to the response. The
    metadata block keeps the source's identifier, digests, status line and HTTP headers, names the conversion, and lists
    the links of the page in order. Null and empty payloads are empty blocks; a null http_header counts as empty, and
    its payload as HTML; a null target_uri leaves its field out. Rows with a null record_id get one from
    target_uri and payload. Repeated responses give repeated records. Other columns are not read.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    known = responses.select(
        F.coalesce(F.col("record_id").cast("string"), _urn(F.concat_ws("|", F.lit("source"), "target_uri", F.sha2(text("payload"), 256)))).alias("refers_to"),
        F.col("target_uri").cast("string").alias("target_uri"),
        F.coalesce(F.col("date").cast("string"), F.lit(DATE)).alias("date"),
        text("http_header").alias("http"),
        text("payload").alias("payload"),
    )
    kind = F.lower(F.btrim(F.regexp_extract("http", r"(?i)(\A|\n)content-type:[ \t]*([^\r\n;]*)", 2)))
    parts = known.select(
        "*",
        kind.alias("kind"),
        _urn(F.concat(F.lit("conversion|"), "refers_to")).alias("conversion_id"),
        _urn(F.concat(F.lit("metadata|"), "refers_to")).alias("metadata_id"),
        F.regexp_extract_all("payload", F.lit(_LINK), F.lit(1)).alias("outlinks"),
        F.filter(F.split("http", "\r?\n"), lambda x: x != "").alias("lines"),
    )
    html = F.col("kind").isin("", "text/html", "application/xhtml+xml")
    parts = with_plain_text(parts, F.when(html, F.col("payload")), "readable")
    parts = parts.withColumn("conversion", F.when(html, F.col("readable")).when(F.startswith("kind", F.lit("text/")), F.col("payload")))
    fields = F.concat(
        F.array(
            F.concat(F.lit("source-record-id: "), "refers_to"),
            F.concat(F.lit("source-block-digest: "), _digest(F.concat("http", "payload"))),
            F.concat(F.lit("source-payload-digest: "), _digest(F.col("payload"))),
        ),
        F.transform("lines", lambda x, i: F.concat(F.when(i == 0, F.lit("source-http-status: ")).otherwise(F.lit("source-http-header: ")), x)),
        F.when(F.col("conversion").isNotNull(), F.array(F.concat(F.lit("conversion-record-id: "), "conversion_id"))).otherwise(F.array()),
        F.transform("outlinks", lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, "^[\"']|[\"']$|[\r\n]", ""))),
    )
    meta = F.struct(
        F.lit("metadata").alias("warc_type"), F.col("metadata_id").alias("record_id"), F.lit("application/warc-fields").alias("content_type"),
        F.concat(F.array_join(fields, "\r\n"), F.lit("\r\n")).alias("block"),
    )
    conversion = F.struct(
        F.lit("conversion").alias("warc_type"), F.col("conversion_id").alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"),
        F.col("conversion").alias("block"),
    )
    rows = parts.select("refers_to", "target_uri", "date", F.explode(F.array(meta, conversion)).alias("r")).select("refers_to", "target_uri", "date", "r.*")
    rows = rows.where("block IS NOT NULL").withColumns({"content_length": F.octet_length("block").cast("long"), "block_digest": _digest(F.col("block"))})
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "warc_type"),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("target_uri", "[\r\n]", "")),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
        F.concat(F.lit("Content-Type: "), "content_type"),
        F.concat(F.lit("Content-Length: "), "content_length"),
    )
    return rows.select("warc_type", "record_id", "refers_to", "target_uri", header.alias("header"), "block", "content_length", "block_digest")


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write records as WARC files, one per partition: header, block, and the two line ends that close a record."""
    whole = records.select(F.concat("header", F.lit("\r\n\r\n"), "block").alias("value"))
    whole.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
