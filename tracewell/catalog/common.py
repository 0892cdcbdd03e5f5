"""Views that present the given tables as evidence tables, shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as inclusive extents: the supplier is the image, the part the position."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_id"),
        (F.col("l_partkey") * 64).alias("start"),
        (F.col("l_partkey") * 64 + F.col("l_quantity").cast("long") * 4 - 1).alias("end"),
    )


LINE_EXTENTS_SQL = """
SELECT l_suppkey AS image_id, l_partkey * 64 AS s, l_partkey * 64 + CAST(l_quantity AS BIGINT) * 4 - 1 AS e
FROM lineitem
"""


def part_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as half-open free ranges, present on every supplier's image."""
    parts = table(spark, sf_dir, "part")
    placed = parts.select(
        F.col("p_partkey").alias("image_part"),
        (F.col("p_partkey") * 64 + 16).alias("start"),
        (F.col("p_partkey") * 64 + 16 + F.col("p_size")).alias("end"),
    )
    # Each part's range lies on the images of the suppliers that ship it.
    ships = (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("image_part"))
        .distinct()
    )
    return ships.join(placed, "image_part").select("image_id", "start", "end")


PART_FREE_SQL = """
SELECT DISTINCT l_suppkey AS image_id, p_partkey * 64 + 16 AS s, p_partkey * 64 + 16 + p_size AS e
FROM lineitem JOIN part ON p_partkey = l_partkey
"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recovered payloads, in scan order by ``ord``."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("image_id"),
        F.col("doc_id").alias("ord"),
        F.col("doc_id"),
        F.col("lang"),
        F.encode("text", "UTF-8").alias("payload"),
    )
