"""Canonical JSON and the hashes over it.

Keys sorted by code point, no white space, minimal escapes, exact integers only. Flat rows are
rendered in the JVM; nested documents go through one Arrow-batched function.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.batches import release, runs

MAX_EXACT = 2**53 - 1
MAX_DEPTH = 64

# Control characters whose escape has a hex letter; the JVM writes it in upper case.
_LETTERED = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def json_quote(text: Column) -> Column:
    """A JSON string literal with minimal escapes; control characters in lower-case ``\\u00xx`` form."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    # An escaped backslash must not pair with a following "u000B" of the text, so it is parked first.
    written = F.to_json(F.struct(text.alias("v")))
    body = written.substr(F.lit(7), F.length(written) - 8)
    body = F.replace(body, F.lit("\\\\"), F.lit("\u0000"))
    for code in _LETTERED:
        body = F.replace(body, F.lit(f"\\u00{code}"), F.lit(f"\\u00{code.lower()}"))
    full = F.replace(body, F.lit("\u0000"), F.lit("\\\\"))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), full).otherwise(plain), F.lit('"'))


def flat_object(strings: dict[str, Column], integers: dict[str, Column]) -> Column:
    """Canonical object of string and integer fields; an integer beyond 2^53-1 gives null."""
    parts: list[Column] = []
    for name in sorted([*strings, *integers]):
        lead = F.lit(("{" if not parts else ",") + json.dumps(name) + ":")
        if name in strings:
            value = F.when(strings[name].isNull(), F.lit("null")).otherwise(json_quote(strings[name]))
        else:
            number = integers[name]
            exact = F.when(F.abs(number) <= MAX_EXACT, number.cast("string"))
            value = F.when(number.isNull(), F.lit("null")).otherwise(exact)
        parts += [lead, value]
    return F.concat(*parts, F.lit("}"))


class _Refused(ValueError):
    pass


def _exact_int(text: str) -> int:
    value = int(text)
    if abs(value) > MAX_EXACT:
        raise _Refused(f"integer {value} exceeds the interoperable exact-integer range (+/-{MAX_EXACT}, 2**53-1)")
    return value


def _no_float(text: str):
    raise _Refused("float values are not representable in canonical JSON")


def _depth(value) -> int:
    level, depth = [value], -1
    while level:
        depth += 1
        if depth > MAX_DEPTH:
            break
        level = [
            child
            for item in level
            if isinstance(item, (dict, list))
            for child in (item.values() if isinstance(item, dict) else item)
        ]
    return depth


def canonical_text(text: str, drop: str | None = None) -> str:
    """Canonical form of one JSON document, without the top-level member ``drop``.

    Only the numbers that remain in the result have to be exact integers. Most documents hold no other numbers at all and
    are read once; the rest are read again without what is dropped.
    """
    try:
        value = json.loads(text, parse_float=_no_float, parse_int=_exact_int, parse_constant=_no_float)
        sound = True
    except _Refused:
        value = json.loads(text, parse_float=lambda t: float(t))
        sound = False
    if drop is not None and isinstance(value, dict):
        value.pop(drop, None)
    if text.count("{") + text.count("[") > MAX_DEPTH and _depth(value) > MAX_DEPTH:
        raise _Refused(f"data structure exceeds maximum nesting depth ({MAX_DEPTH} levels)")
    if not sound:
        kept = json.dumps(value, ensure_ascii=False)
        value = json.loads(kept, parse_float=_no_float, parse_int=_exact_int, parse_constant=_no_float)
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


CANONICAL = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def _canonical_runs(docs: Iterator[pa.Array], drop: str | None) -> Iterator[pa.Array]:
    for column in docs:
        for at, n in runs(column):
            texts, errors = [], []
            for doc in column.slice(at, n).to_pylist():
                text = error = None
                if doc is not None:
                    try:
                        text = canonical_text(doc, drop)
                        text.encode("utf-8")
                    except (ValueError, RecursionError) as exc:
                        text, error = None, str(exc)
                texts.append(text)
                errors.append(error)
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["text", "error"])
    release()


@F.arrow_udf(CANONICAL)
def canonicalize(docs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``struct(text, error)`` per JSON document."""
    return _canonical_runs(docs, None)


@F.arrow_udf(CANONICAL)
def canonical_payload(docs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Canonical form of a certificate without its ``signature`` member."""
    return _canonical_runs(docs, "signature")


def payload_sha256(canonical: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(canonical, "UTF-8"), 256))


BLOCK_STRINGS = (
    "timestamp", "operation_type", "target_id", "operator_id", "organization", "cert_uuid", "payload_hash", "signature",
    "prev_hash",
)


def block_hash(block_index: str = "block_index", **columns: str) -> Column:
    """SHA-256 over the canonical ten-field object of a ledger row."""
    strings = {name: F.col(columns.get(name, name)) for name in BLOCK_STRINGS}
    return F.sha2(F.encode(flat_object(strings, {"block_index": F.col(block_index)}), "UTF-8"), 256)


_FLOAT_HINT = re.compile(r"\d[.eE]|NaN|Infinity")


@F.pandas_udf(T.ArrayType(T.StringType()))
def number_problems(docs: pd.Series) -> pd.Series:
    """Paths of float values, and of structures nested deeper than 64 levels, outside ``signature``."""

    def walk(node, path: str, depth: int, found: list[str]) -> None:
        if depth > MAX_DEPTH:
            found.append(f"{path}: structure exceeds maximum nesting depth ({MAX_DEPTH} levels)")
        elif isinstance(node, float):
            found.append(f"{path}: float values are forbidden in schema v1")
        elif isinstance(node, dict):
            for key, child in node.items():
                walk(child, f"{path}.{key}", depth + 1, found)
        elif isinstance(node, list):
            for at, child in enumerate(node):
                walk(child, f"{path}[{at}]", depth + 1, found)

    def problems(doc: str) -> list[str]:
        if doc.count("{") + doc.count("[") <= MAX_DEPTH and not _FLOAT_HINT.search(doc):
            return []
        try:
            value = json.loads(doc)
        except (ValueError, RecursionError):
            return []
        found: list[str] = []
        if isinstance(value, dict):
            walk({k: v for k, v in value.items() if k != "signature"}, "$", 0, found)
        return found

    return docs.map(problems, na_action="ignore")
