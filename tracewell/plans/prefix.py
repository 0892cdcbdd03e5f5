"""Running aggregates over long ordered groups without putting a group into one task.

A plain ``Window.partitionBy(image).orderBy(offset)`` sends every row of an image to one task. Here
the order axis is cut into buckets: rows are windowed inside ``(key, bucket)``, one summary row per
bucket is windowed inside ``key``, and the two are combined. The bucket is a pure function of the
row, so a recomputed partition lands in the same bucket after an executor is lost. Rows move once,
on ``(key, bucket)``, and the bucket summaries are pre-aggregated before their own small shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.joins import materialise

_BUCKET = "__bucket"


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is ``max``, ``min``, ``sum`` or ``last`` (last non-null)."""

    out: str
    kind: str
    expr: Column


def bucket_of(column: str | Column, width: int) -> Column:
    """Bucket number of a numeric position."""
    return F.floor(F.col(column) / F.lit(width) if isinstance(column, str) else column / F.lit(width)).cast("long")


def _plain(kind: str, expr: Column, order: Sequence[str], descending: bool) -> Column:
    if kind == "max":
        return F.max(expr)
    if kind == "min":
        return F.min(expr)
    if kind == "sum":
        return F.sum(expr)
    position = F.when(expr.isNotNull(), F.struct(*order))
    return F.min_by(expr, position) if descending else F.max_by(expr, position)


def _windowed(kind: str, expr: Column, window) -> Column:
    if kind == "last":
        return F.last(expr, ignorenulls=True).over(window)
    return {"max": F.max, "min": F.min, "sum": F.sum}[kind](expr).over(window)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.coalesce(local, carried)


def computed_once(df: DataFrame) -> DataFrame:
    """``df`` as a written table if computing it takes more than a scan: a running value reads its rows twice, and nested
    ones would double the work at every level."""
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().analyzed().toString()
    return materialise(df) if re.search("Join|Aggregate|Window|Union|Generate|MapIn|FlatMap", plan) else df


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    specs: Sequence[Running],
    *,
    inclusive: bool = False,
    descending: bool = False,
) -> DataFrame:
    """Append one running value per spec, over the rows before each row in ``order`` within ``keys``.

    ``bucket`` must be monotone in the first ``order`` column. ``descending`` scans from the high end,
    which turns ``last`` into "nearest following". ``inclusive`` counts the row itself as well.
    """
    keys = list(keys)
    rows = computed_once(df).withColumn(_BUCKET, bucket)
    totals = rows.groupBy(*keys, _BUCKET).agg(
        *[_plain(s.kind, s.expr, order, descending).alias(f"__t_{s.out}") for s in specs]
    )
    bucket_order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    earlier = Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        _BUCKET,
        *[_windowed(s.kind, F.col(f"__t_{s.out}"), earlier).alias(f"__c_{s.out}") for s in specs],
    )
    directed = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*directed)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = rows.select("*", *[_windowed(s.kind, s.expr, inside).alias(f"__l_{s.out}") for s in specs])
    joined = local.join(carry, [*keys, _BUCKET], "left")
    kept = [F.col(c) for c in df.columns]
    return joined.select(
        *kept,
        *[
            _combine(s.kind, F.col(f"__c_{s.out}"), F.col(f"__l_{s.out}")).alias(s.out)
            for s in specs
        ],
    )


def row_numbers(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], out: str) -> DataFrame:
    """1-based position of each row within ``keys`` by ``order`` (ties must be impossible)."""
    numbered = running(df, keys, bucket, order, [Running("__before", "sum", F.lit(1).cast("long"))])
    return numbered.withColumn(out, F.col("__before") + 1).drop("__before")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """``unionByName`` over a sequence, tolerating missing columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
