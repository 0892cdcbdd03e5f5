"""What the operators share beside the library's general helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.plans.joins import lookup, materialise

__all__ = ["ascii_lower", "lookup", "materialise"]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. ``lower`` does the same where all is ASCII, and is faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
