"""Registered queries over volumes: table rows laid out as the slots of directories, and as free and structural ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.catalog.common import table
from tracewell.functions.bits import uint
from tracewell.operators.extents import HALF_OPEN, subtract_extents
from tracewell.operators.paths import FAT_END
from tracewell.operators.volumes import VOLUME, fat_directory, walk_directories

#: Slots of one cluster.
_SLOTS = 128


def _little(value: Column, width: int) -> Column:
    """The bytes of a number, the lowest first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(F.lit(0xFF).cast("long"))), 2, "0")) for k in range(width)])


def _slot(name: Column, cluster: Column, size: Column, deleted: Column, directory: Column) -> Column:
    """A 32-byte directory slot; a deleted one has lost the first letter of its name."""
    zero = lambda n: F.unhex(F.lit("00" * n))
    first = F.when(deleted, F.unhex(F.lit("E5"))).otherwise(F.encode(F.substring(name, 1, 1), "US-ASCII"))
    rest = F.encode(F.rpad(F.substring(name, 2, 7), 10, " "), "US-ASCII")
    attributes = F.when(directory, F.unhex(F.lit("10"))).otherwise(F.unhex(F.lit("20")))
    return F.concat(first, rest, attributes, zero(8), _little(F.shiftright(cluster.cast("long"), 16), 2), zero(4), _little(cluster, 2), _little(size, 4))


def _volume(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, links)``: regions as directories of the root, nations below, their customers as files.

    A directory is a chain of clusters of ``_SLOTS`` slots. Customers in debt are deleted; where their content lies and
    how long it is follow from their key and balance.
    """
    no, yes = F.lit(False), F.lit(True)
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    home = lambda kind, key: F.lit(kind << 20) + F.col(key).cast("long") * F.lit(1 << 14)
    parts = [
        region.select(F.lit(2).cast("long").alias("dir_id"), F.col("r_regionkey").alias("key"), _slot(
            F.concat(F.lit("R"), F.lpad(F.col("r_regionkey").cast("string"), 7, "0")), home(1, "r_regionkey"), F.lit(0), no, yes).alias("raw")),
        nation.select(home(1, "n_regionkey").alias("dir_id"), F.col("n_nationkey").alias("key"), _slot(
            F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 7, "0")), home(2, "n_nationkey"), F.lit(0), no, yes).alias("raw")),
        customer.select(home(2, "c_nationkey").alias("dir_id"), F.col("c_custkey").alias("key"), _slot(
            F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")), F.lit(1 << 22) + F.col("c_custkey"),
            F.round(F.abs("c_acctbal")) + 1, F.col("c_acctbal") < 0, no).alias("raw")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # Directories are dealt into clusters by the rank of their keys.
    rank = F.row_number().over(Window.partitionBy("dir_id").orderBy("key")) - 1
    placed = rows.withColumn("rank", rank.cast("long")).withColumn("pos", F.floor(F.col("rank") / _SLOTS))
    lengths = placed.groupBy("dir_id").agg(F.max("pos").alias("last"))
    chain = lengths.select("dir_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("pos"), "last")
    following = F.when(F.col("pos") < F.col("last"), F.col("dir_id") + F.col("pos") + 1).otherwise(FAT_END + 1)
    one = [F.lit("volume").alias("image_id"), F.lit(0).alias("part_no")]
    links = chain.select(*one, (F.col("dir_id") + F.col("pos")).alias("cluster"), following.cast("long").alias("next_cluster"))
    return placed.select(*one, (F.col("dir_id") + F.col("pos")).alias("cluster"), F.expr(f"cast(rank % {_SLOTS} as int)").alias("i"), "raw"), links


def deleted_in_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, links = _volume(spark, sf_dir)

    def read(clusters: DataFrame) -> DataFrame:
        met = clusters.join(rows, [*VOLUME, "cluster"])
        slot = F.col("pos") * _SLOTS + F.col("i")
        return met.select(*VOLUME, "dir_id", slot.alias("slot"), (F.col("cluster") * 4096 + F.col("i") * 32).alias("record_num"), "raw")

    root = spark.range(1).select(F.lit("volume").alias("image_id"), F.lit(0).alias("part_no"), F.lit(2).cast("long").alias("dir_id"))
    found = walk_directories(root, links, read, fat_directory, lambda raw: uint(raw, 0, 1) == 0x2E)
    return found.where("is_deleted AND NOT is_directory").select("path", "name", "slot", "first_cluster", "size_bytes")


SQL_DELETED_IN_TREES = """
SELECT 'R' || lpad(CAST(n_regionkey AS VARCHAR), 7, '0') || chr(92) || 'N' || lpad(CAST(n_nationkey AS VARCHAR), 7, '0') || chr(92) || '_' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS path,
  '_' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS name, slot, 4194304 + c_custkey AS first_cluster, CAST(round(abs(c_acctbal)) AS BIGINT) + 1 AS size_bytes
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS slot FROM customer) JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal < 0
"""

def free_minus_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier: ranges of parts as long as their quantity, less those of order lines."""
    lines = table(spark, sf_dir, "lineitem")
    free = lines.select(F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    held = lines.select(F.col("l_suppkey").alias("image_id"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + 2 * F.col("l_linenumber")).alias("end"))
    return subtract_extents(free, held, mode=HALF_OPEN)


SQL_FREE_MINUS_STRUCTURAL = """
WITH u AS (SELECT DISTINCT image_id, unnest(range(s, e)) AS p FROM (SELECT l_suppkey AS image_id, l_partkey AS s, l_partkey + CAST(trunc(l_quantity) AS BIGINT) AS e FROM lineitem)),
h AS (SELECT DISTINCT image_id, unnest(range(s, e)) AS p FROM (SELECT l_suppkey AS image_id, l_orderkey AS s, l_orderkey + 2 * l_linenumber AS e FROM lineitem)),
f AS (SELECT image_id, p, p - row_number() OVER (PARTITION BY image_id ORDER BY p) AS island FROM (SELECT * FROM u EXCEPT SELECT * FROM h))
SELECT image_id, min(p) AS start, max(p) + 1 AS "end" FROM f GROUP BY image_id, island
"""

QUERIES = {"deleted_in_trees": deleted_in_trees, "free_minus_structural": free_minus_structural}
SQL = {"deleted_in_trees": SQL_DELETED_IN_TREES, "free_minus_structural": SQL_FREE_MINUS_STRUCTURAL}
