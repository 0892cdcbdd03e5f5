"""Extent algebra against brute force, with buckets far smaller than the extents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import extents as ex


def brute_merge(rows, slack):
    out = []
    for s, e in sorted(r for r in rows if r[1] >= r[0] + (1 - slack)):
        if out and s <= out[-1][1] + slack:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def sample(seed, n=60):
    rng = random.Random(seed)
    return [(k, s, s + rng.choice([-3, 0, 1, 5, 40, 300])) for k in "ab" for s in (rng.randrange(1000) for _ in range(n))]


def table(spark, rows):
    return spark.createDataFrame(rows, "image_id string, start long, end long")


def by_key(rows, key):
    return [(s, e) for k, s, e in rows if k == key]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("mode,slack", [(ex.INCLUSIVE, 1), (ex.HALF_OPEN, 0)])
def test_merge(spark, seed, mode, slack):
    rows = sample(seed)
    got = [tuple(r) for r in ex.merge_extents(table(spark, rows), mode=mode, bucket_bytes=16).collect()]
    for key in "ab":
        assert sorted(by_key(got, key)) == brute_merge(by_key(rows, key), slack)


@pytest.mark.parametrize("seed", range(3))
def test_complement(spark, seed):
    rows = sample(seed, 12)
    bounds = spark.createDataFrame([("a", 100, 700), ("b", 0, 2000), ("c", 5, 9), ("d", 9, 5)], "image_id string, lo long, hi long")
    got = [tuple(r) for r in ex.complement(table(spark, rows), bounds, bucket_bytes=16).collect()]
    for key, lo, hi in (("a", 100, 700), ("b", 0, 2000), ("c", 5, 9), ("d", 9, 5)):
        covered = {p for s, e in by_key(rows, key) for p in range(s, e + 1)}
        free = {p for s, e in by_key(got, key) for p in range(s, e + 1)}
        assert free == set(range(lo, hi + 1)) - covered


def test_touching_extents_merge_only_when_inclusive(spark):
    rows = [("a", 0, 9), ("a", 10, 19)]
    assert ex.merge_extents(table(spark, rows)).count() == 1
    assert ex.merge_extents(table(spark, [("a", 0, 10), ("a", 11, 19)]), mode=ex.HALF_OPEN).count() == 2
    assert ex.total_length(table(spark, rows)).first().total_bytes == 20


@pytest.mark.parametrize("seed", range(3))
def test_drop_contained(spark, seed):
    rows = [(k, s, e - s) for k, s, e in sample(seed, 40)]
    df = spark.createDataFrame(rows, "image_id string, offset long, size_bytes long")
    got = sorted(tuple(r) for r in ex.drop_contained(df, bucket_bytes=16).collect())
    want = []
    for k, o, n in rows:
        inside = n > 0 and any(kk == k and nn > n and oo <= o and o + n <= oo + nn for kk, oo, nn in rows)
        if not inside:
            want.append((k, o, n))
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_free_space_joins(spark, seed):
    free = sample(seed, 8)
    rng = random.Random(seed + 50)
    points = [(k, rng.randrange(1300), rng.randrange(60)) for k in "abz" for _ in range(60)]
    cands = spark.createDataFrame(points, "image_id string, offset long, length long")
    ranges = table(spark, free)
    hits = ex.restrict_to_free(cands, ranges, flag="hit", bucket_bytes=16).collect()
    for r in hits:
        assert r.hit == any(s <= r.offset < e for s, e in by_key(free, r.image_id))
    touched = ex.prune_blocks(cands, ranges, flag="hit", bucket_bytes=16).collect()
    for r in touched:
        stop = r.offset + r.length
        assert r.hit == (r.length > 0 and any(s < stop and r.offset < e for s, e in by_key(free, r.image_id) if e > s))
    assert len(hits) == len(touched) == len(points)


def test_partition_extents(spark):
    parts = spark.createDataFrame([("a", "ntfs", 100), ("a", "ext4", 500)], "image_id string, fs_type string, start long")
    images = spark.createDataFrame([("a", 900)], "image_id string, size long")
    got = {(r.fs_type, r.start, r.end) for r in ex.partition_extents(parts, images).collect()}
    assert got == {("ntfs", 100, 500), ("ext4", 500, 900)}


def test_rate_is_integer_and_safe(spark):
    row = spark.range(1).select(ex.rate_ppm(F.lit(1), F.lit(3)).alias("a"), ex.rate_ppm(F.lit(1), F.lit(0)).alias("b")).first()
    assert (row.a, row.b) == (333333, 0)
