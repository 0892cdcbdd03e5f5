"""As-of and interval-membership joins built on bucketed running values.

Both sides are unioned on one position axis and scanned once, so neither side is exploded into
buckets, nothing is broadcast, and a single huge image is spread over its position buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans.prefix import Running, bucket_of, running

_POS, _SIDE, _VALUE = "__pos", "__side", "__value"


def _axis(
    probes: DataFrame, marks: DataFrame, keys: Sequence[str], at: Column, mark_at: str, value: Column, marks_first: bool
) -> DataFrame:
    # The side column settles ties: a mark at the probe's own position counts when marks sort first.
    mark_side, probe_side = (0, 1) if marks_first else (1, 0)
    marks_ = marks.select(
        *keys, F.col(mark_at).cast("long").alias(_POS), F.lit(mark_side).alias(_SIDE), value.alias(_VALUE)
    ).where(F.col(_POS).isNotNull())
    probes_ = probes.select("*", at.cast("long").alias(_POS), F.lit(probe_side).alias(_SIDE))
    return probes_.unionByName(marks_, allowMissingColumns=True)


def latest_at_or_before(
    probes: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    at: Column,
    mark_at: str,
    value: Column,
    out: str,
    *,
    width: int,
    kind: str = "last",
    strict: bool = False,
) -> DataFrame:
    """For each probe, the ``value`` of the last mark at or before ``at`` (``kind='max'``: the largest)."""
    both = _axis(probes, marks, keys, at, mark_at, value, marks_first=not strict)
    scanned = running(both, keys, bucket_of(_POS, width), [_POS, _SIDE], [Running(out, kind, F.col(_VALUE))])
    probe_side = 0 if strict else 1
    return scanned.where(F.col(_SIDE) == probe_side).select(*probes.columns, out)


def first_at_or_after(
    probes: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    at: Column,
    mark_at: str,
    value: Column,
    out: str,
    *,
    width: int,
) -> DataFrame:
    """For each probe, the ``value`` of the first mark at or after ``at``."""
    # Scanning downwards, a mark at the probe's own position must come first, so it sorts higher.
    both = _axis(probes, marks, keys, at, mark_at, value, marks_first=False)
    scanned = running(
        both, keys, bucket_of(_POS, width), [_POS, _SIDE], [Running(out, "last", F.col(_VALUE))], descending=True
    )
    return scanned.where(F.col(_SIDE) == 0).select(*probes.columns, out)
