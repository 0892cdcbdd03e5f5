"""Text checks for names and report metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The organisation name that may carry an ampersand, and the characters refused elsewhere.
TRUSTED_ORGANISATION = "Digital Forensics & Data Sanitization Lab"
FORBIDDEN = "[<>&\"'\\\\|]"
_CONTROL = "\\x00-\\x1f\\x7f-\\x9f"
_BIDI = "\\u202a-\\u202e\\u2066-\\u2069"
_EDGE_SPACE = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def metadata_problem(text: Column, field: str, max_len: int = 128, trusted: str = TRUSTED_ORGANISATION) -> Column:
    """The first reason a metadata value is refused, or null when it is acceptable (or absent).

    ``trusted`` is the one organisation whose name may hold otherwise forbidden characters.
    """
    value = strip(text)
    too_long = F.lit(f"{field} exceeds maximum length of {max_len} characters")
    bad = F.regexp_extract(value, f"[{_CONTROL}{_BIDI}]", 0)
    code = F.format_string("U+%04X", F.ascii(bad))
    control = F.concat(
        F.lit(f"{field} contains a control character ("), code, F.lit("); control characters are not allowed")
    )
    bidi = F.concat(
        F.lit(f"{field} contains a bidirectional override ("), code,
        F.lit("); these can make text render in an order other than its logical one"),
    )
    rest = (
        F.when(value.rlike(FORBIDDEN), F.lit(f"{field} contains forbidden characters (<, >, &, \", ', \\, |)"))
        .when(F.length(value) > max_len, too_long)
        .when(bad != "", F.when(bad.rlike(f"[{_BIDI}]"), bidi).otherwise(control))
    )
    if field == "organization":
        rest = F.when(value == trusted, F.when(F.length(value) > max_len, too_long)).otherwise(rest)
    return F.when(text.isNull(), F.lit(None).cast("string")).when(
        value == "", F.lit(f"{field} cannot be empty")
    ).otherwise(rest)


def sanitize_filename(raw: Column, max_len: int = 200) -> Column:
    """A path-safe file name: separators and control characters removed, never empty."""
    text = F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), "[\\x00-\\x1f]", "_")
    parts = F.filter(F.split(text, "[/\\\\:]+"), lambda p: ~p.isin("", ".", ".."))
    parts = F.transform(parts, lambda p: strip(F.regexp_replace(p, "^\\.+", "")))
    joined = F.array_join(F.filter(parts, lambda p: p != ""), "_")
    edged = F.regexp_replace(joined, "^[._ ]+|[._ ]+$", "")
    collapsed = F.regexp_replace(edged, "_{2,}", "_")
    cut = F.substring(collapsed, 1, max_len)
    return F.when(cut == "", F.lit("unnamed")).otherwise(cut)
