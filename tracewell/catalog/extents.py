"""Registered queries over the extent algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog.common import LINE_EXTENTS_SQL, PART_FREE_SQL, line_extents, part_free, table
from tracewell.operators import extents as ex

_MERGED = f"""
WITH ext AS ({LINE_EXTENTS_SQL}),
reach AS (
  SELECT image_id, s, e,
         max(e) OVER (PARTITION BY image_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM ext WHERE e >= s),
isl AS (
  SELECT image_id, s, e,
         sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END)
           OVER (PARTITION BY image_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
  FROM reach),
merged AS (SELECT image_id, min(s) AS s, max(e) AS e FROM isl GROUP BY image_id, g)
"""


def merge_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.merge_extents(line_extents(spark, sf_dir)).select(
        "image_id", F.col("start").alias("ext_start"), F.col("end").alias("ext_end")
    )


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searched range of every supplier's image: up to the largest part position."""
    top = table(spark, sf_dir, "part").agg((F.max("p_partkey") * 64 + 63).alias("hi")).withColumn("one", F.lit(1))
    images = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(0).alias("lo"), F.lit(1).alias("one"))
    # One aggregate row, so the broadcast cannot grow.
    return images.join(F.broadcast(top), "one").drop("one")


_SEARCHED_SQL = "SELECT s_suppkey AS image_id, 0 AS lo, (SELECT max(p_partkey) * 64 + 63 FROM part) AS hi FROM supplier"


def extent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.complement(line_extents(spark, sf_dir), _searched(spark, sf_dir)).select(
        "image_id", F.col("start").alias("gap_start"), F.col("end").alias("gap_end")
    )


def extent_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.total_length(line_extents(spark, sf_dir))


def free_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = part_free(spark, sf_dir)
    return ex.merge_extents(free, mode=ex.HALF_OPEN).select(
        "image_id", F.col("start").alias("free_start"), F.col("end").alias("free_end")
    )


def drop_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = line_extents(spark, sf_dir).select(
        "image_id", F.col("start").alias("offset"), (F.col("end") - F.col("start") + 1).alias("size_bytes")
    )
    kept = ex.drop_contained(files, flag="contained")
    return kept.groupBy("image_id").agg(
        F.count("*").alias("files"),
        F.sum(F.col("contained").cast("long")).alias("contained"),
        F.sum(F.when(F.col("contained"), F.col("size_bytes")).otherwise(0)).alias("contained_bytes"),
    )


def free_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = line_extents(spark, sf_dir).select("image_id", (F.col("start") + 20).alias("offset"))
    return (
        ex.restrict_to_free(cands, part_free(spark, sf_dir))
        .groupBy("image_id")
        .agg(F.count("*").alias("candidates"), F.sum("offset").alias("offset_sum"))
    )


def free_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = line_extents(spark, sf_dir).select(
        "image_id", F.col("start").alias("offset"), (F.col("end") - F.col("start") + 1).alias("length")
    )
    flagged = ex.prune_blocks(blocks, part_free(spark, sf_dir), flag="touches_free")
    return flagged.groupBy("image_id").agg(
        F.sum(F.col("touches_free").cast("long")).alias("blocks_kept"),
        F.sum(F.when(F.col("touches_free"), 0).otherwise(F.col("length"))).alias("allocated_bytes_skipped"),
    )


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = ex.coverage(line_extents(spark, sf_dir), _searched(spark, sf_dir))
    totals = both.groupBy("image_id").agg(
        F.sum(F.when(F.col("kind") == "recovered", F.col("end") - F.col("start") + 1).otherwise(0)).alias("recovered"),
        F.sum(F.when(F.col("kind") == "gap", F.col("end") - F.col("start") + 1).otherwise(0)).alias("gap"),
    )
    joined = totals.join(_searched(spark, sf_dir), "image_id")
    return joined.select(
        "image_id", "recovered", "gap", ex.rate_ppm(F.col("recovered"), F.col("hi") + 1).alias("rate_ppm")
    )


def partition_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    parts = nation.select(
        F.col("n_regionkey").alias("image_id"), (F.col("n_nationkey") * 1000).cast("long").alias("start"),
        F.col("n_name").alias("fs_type"),
    )
    images = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("image_id"), F.lit(30000).cast("long").alias("size"))
    return ex.partition_extents(parts, images).select(
        "image_id", "part_no", "fs_type", F.col("start").alias("part_start"), F.col("end").alias("part_end")
    )


QUERIES = {
    "merge_extents": merge_extents,
    "extent_gaps": extent_gaps,
    "extent_total": extent_total,
    "free_merge": free_merge,
    "drop_contained": drop_contained,
    "free_contains": free_contains,
    "free_overlap": free_overlap,
    "coverage_report": coverage_report,
    "partition_extents": partition_extents,
}

_GAPS = f"""
{_MERGED},
rng AS ({_SEARCHED_SQL}),
clipped AS (
  SELECT rng.image_id, greatest(s, lo) AS s, least(e, hi) AS e
  FROM rng JOIN merged ON merged.image_id = rng.image_id WHERE e >= lo AND s <= hi),
marks AS (
  SELECT image_id, s, e FROM clipped
  UNION ALL SELECT image_id, lo - 1, lo - 1 FROM rng
  UNION ALL SELECT image_id, hi + 1, hi + 1 FROM rng),
seq AS (SELECT image_id, e + 1 AS gs, lead(s) OVER (PARTITION BY image_id ORDER BY s, e) - 1 AS ge FROM marks),
gaps AS (SELECT image_id, gs, ge FROM seq WHERE ge >= gs)
"""

SQL = {
    "merge_extents": _MERGED + "SELECT image_id, s AS ext_start, e AS ext_end FROM merged",
    "extent_gaps": _GAPS + "SELECT image_id, gs AS gap_start, ge AS gap_end FROM gaps",
    "extent_total": _MERGED + "SELECT image_id, CAST(sum(e - s + 1) AS BIGINT) AS total_bytes FROM merged GROUP BY image_id",
    "free_merge": f"""
WITH ext AS ({PART_FREE_SQL}),
reach AS (
  SELECT image_id, s, e,
         max(e) OVER (PARTITION BY image_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM ext WHERE e > s),
isl AS (
  SELECT image_id, s, e,
         sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END)
           OVER (PARTITION BY image_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
  FROM reach)
SELECT image_id, min(s) AS free_start, max(e) AS free_end FROM isl GROUP BY image_id, g""",
    "drop_contained": f"""
WITH ext AS (SELECT row_number() OVER () AS rid, image_id, s, e FROM ({LINE_EXTENTS_SQL}) WHERE e >= s),
flags AS (
  SELECT a.image_id, a.e - a.s + 1 AS sz,
         EXISTS (SELECT 1 FROM ext b WHERE b.image_id = a.image_id AND b.s <= a.s AND b.e >= a.e
                 AND b.e - b.s > a.e - a.s) AS c
  FROM ext a)
SELECT image_id, count(*) AS files, CAST(sum(CASE WHEN c THEN 1 ELSE 0 END) AS BIGINT) AS contained,
       CAST(sum(CASE WHEN c THEN sz ELSE 0 END) AS BIGINT) AS contained_bytes
FROM flags GROUP BY image_id""",
    "free_contains": f"""
WITH c AS (SELECT image_id, s + 20 AS o FROM ({LINE_EXTENTS_SQL})), f AS ({PART_FREE_SQL})
SELECT image_id, count(*) AS candidates, CAST(sum(o) AS BIGINT) AS offset_sum FROM c
WHERE EXISTS (SELECT 1 FROM f WHERE f.image_id = c.image_id AND f.s <= c.o AND c.o < f.e)
GROUP BY image_id""",
    "free_overlap": f"""
WITH b AS (SELECT image_id, s AS lo, e + 1 AS hi FROM ({LINE_EXTENTS_SQL})), f AS ({PART_FREE_SQL}),
t AS (SELECT image_id, hi - lo AS n,
        EXISTS (SELECT 1 FROM f WHERE f.image_id = b.image_id AND f.s < b.hi AND b.lo < f.e) AS hit FROM b)
SELECT image_id, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS blocks_kept,
       CAST(sum(CASE WHEN hit THEN 0 ELSE n END) AS BIGINT) AS allocated_bytes_skipped
FROM t GROUP BY image_id""",
    "coverage_report": _GAPS + """,
r AS (SELECT image_id, sum(e - s + 1) AS n FROM merged GROUP BY image_id),
g AS (SELECT image_id, sum(ge - gs + 1) AS n FROM gaps GROUP BY image_id)
SELECT rng.image_id, CAST(coalesce(r.n, 0) AS BIGINT) AS recovered, CAST(coalesce(g.n, 0) AS BIGINT) AS gap,
       CAST(coalesce(r.n, 0) * 1000000 // (hi + 1) AS BIGINT) AS rate_ppm
FROM rng LEFT JOIN r ON r.image_id = rng.image_id LEFT JOIN g ON g.image_id = rng.image_id""",
    "partition_extents": """
SELECT n_regionkey AS image_id,
       CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS part_no,
       n_name AS fs_type, CAST(n_nationkey * 1000 AS BIGINT) AS part_start,
       CAST(coalesce(lead(n_nationkey * 1000) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 30000) AS BIGINT) AS part_end
FROM nation JOIN region ON r_regionkey = n_regionkey""",
}
