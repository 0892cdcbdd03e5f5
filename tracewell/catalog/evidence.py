"""Registered queries over metadata logs, bad sectors, allocation tables, sessions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog.common import table
from tracewell.operators import freespace, sampling, sessions
from tracewell.operators import payloads as pay
from tracewell.operators import timeline as tl
from tracewell.sources import hashlists
from tracewell.sources.signatures import filter_extensions


def _log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the entries of metadata-log blocks, one block per order; every third block is a descriptor."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(
            F.struct(
                (F.col("l_partkey") % 40).cast("long").alias("inode"), F.concat("l_returnflag", "l_linestatus").alias("name"),
                (F.lit(1) + F.col("l_partkey") % 2).cast("int").alias("file_type"),
            )
        ).alias("entries")
    )
    return items.select(
        (F.col("l_orderkey") % 7).cast("string").alias("image_id"), F.expr("l_orderkey div 7").alias("index"),
        F.when(F.expr("l_orderkey div 7 % 3 = 0"), 1).otherwise(2).alias("block_type"), (F.col("l_orderkey") % 11 != 0).alias("checksum_ok"), "entries",
    )


def log_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.log_names(_log_blocks(spark, sf_dir)).select("image_id", "inode", "name", "file_type")


def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.log_summary(_log_blocks(spark, sf_dir))


def log_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the log beside a journal of events, counted by what they say."""
    journal = table(spark, sf_dir, "events").select(
        F.lit("v").alias("volume_id"), F.col("event_type").alias("name"), F.col("event_id").alias("file_reference"),
        F.when(F.col("value") > 20, F.col("ts")).alias("deleted_at"),
    )
    both = tl.name_evidence(journal, tl.log_names(_log_blocks(spark, sf_dir)))
    return both.groupBy("name", "was_deleted").agg(F.count("*").alias("n"))


def bad_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") * 64).alias("offset"), (F.col("l_quantity").cast("long") * 16).alias("length")
    )
    return sampling.bad_sector_rollup(bad)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("cluster")).agg(
        F.min(F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_linenumber"))).alias("next_cluster")
    ).select("image_id", F.lit(0).alias("part_no"), "cluster", "next_cluster", F.lit(4096).cast("long").alias("unit_bytes"), F.lit(512).cast("long").alias("base"))


def fat_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free clusters of an allocation table less those that directories occupy, as byte ranges."""
    links = _clusters(spark, sf_dir)
    structural = links.where("cluster % 7 = 0").select("image_id", "part_no", "cluster")
    ranges = freespace.units_to_ranges(freespace.fat_free_units(links, structural))
    return ranges.select("image_id", F.col("start").alias("range_start"), F.col("end").alias("range_end"))


def free_space_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which suppliers' free ranges may restrict a search: all partitions readable, and some space free."""
    ranges = freespace.units_to_ranges(freespace.fat_free_units(_clusters(spark, sf_dir)))
    partitions = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("image_id"), F.lit(0).alias("part_no"), F.lit(0).cast("long").alias("start"), F.lit(1 << 30).cast("long").alias("end"),
        (F.col("s_nationkey") % 5 != 0).alias("reliable"), F.when(F.col("s_nationkey") % 7 == 0, "raw").otherwise("fat32").alias("fs_type"),
    )
    return freespace.free_space(ranges, partitions)[1]


def hash_load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a hash list written from the documents."""
    digest = F.sha2("text", 256)
    line = F.when(F.col("lang") == "en", digest).when(F.col("lang") == "de", F.concat(F.md5("text"), F.lit("  file.bin"))).otherwise(F.concat(F.lit("md5,"), digest))
    return hashlists.load_summary(hashlists.parse_hash_lines(table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))))


def session_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sessions whose image may have another size or content by now."""
    size = F.col("c_custkey") * 10
    problem = sessions.identity_problem(
        size, F.col("c_name"), F.when(F.col("c_custkey") % 5 != 0, size + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", problem.alias("problem"))


def rejected_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty returned items of every supplier, with how many there are."""
    rejected = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offset")
    )
    return pay.rejected_sample(rejected, k=20)


def wanted_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("."), F.upper("lang")).alias("extension"))
    return filter_extensions(files, [".EN"], ["fr"])


def resumed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text another document of the same language holds, as candidates that a session recorded."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("image_id"), "doc_id", F.sha2("text", 256).alias("sha256"))
    return sessions.resume_counts(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"))


QUERIES = {
    "log_names": log_names,
    "log_summary": log_summary,
    "log_evidence": log_evidence,
    "bad_sectors": bad_sectors,
    "fat_free": fat_free,
    "free_space_notes": free_space_notes,
    "hash_load_summary": hash_load_summary,
    "session_identity": session_identity,
    "rejected_first": rejected_first,
    "wanted_extensions": wanted_extensions,
    "resumed_counts": resumed_counts,
}

_LOG = """
e AS (SELECT CAST(l_orderkey % 7 AS VARCHAR) AS image_id, l_orderkey // 7 AS idx, l_orderkey % 11 <> 0 AS ok, l_orderkey // 7 % 3 = 0 AS descr,
  l_partkey % 40 AS inode, l_returnflag || l_linestatus AS name, CAST(1 + l_partkey % 2 AS INTEGER) AS file_type FROM lineitem),
b AS (SELECT DISTINCT image_id, idx, ok, descr FROM e),
p AS (SELECT e.image_id, e.inode, e.name, e.file_type FROM b JOIN e ON e.image_id = b.image_id AND e.idx = b.idx + 1 WHERE b.ok AND b.descr),
n AS (SELECT DISTINCT * FROM p WHERE name <> '' AND inode >= 12)"""
_FREE = """
c AS (SELECT l_suppkey AS image_id, l_partkey AS cluster, min(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber END) AS nxt FROM lineitem GROUP BY 1, 2)"""

SQL = {
    "log_names": f"WITH {_LOG} SELECT * FROM n",
    "log_summary": f"""WITH {_LOG}
SELECT image_id, count(*) AS blocks_read, count(*) FILTER (NOT ok) AS checksum_failures,
  (SELECT count(*) FROM p WHERE p.image_id = b.image_id) AS directory_entries, (SELECT count(*) FROM n WHERE n.image_id = b.image_id) AS names_found,
  (SELECT count(*) FROM n WHERE n.image_id = b.image_id AND file_type = 2) AS directories,
  (SELECT count(*) FROM n WHERE n.image_id = b.image_id AND file_type = 1) AS regular_files FROM b GROUP BY image_id""",
    "log_evidence": f"""WITH {_LOG}
SELECT name, was_deleted, count(*) AS n FROM (
  SELECT event_type AS name, coalesce(value > 20 AND ts IS NOT NULL, false) AS was_deleted FROM events UNION ALL SELECT name, NULL FROM n) GROUP BY 1, 2""",
    "bad_sectors": """
WITH x AS (SELECT l_suppkey AS image_id, l_partkey * 64 AS s, l_partkey * 64 + CAST(l_quantity AS BIGINT) * 16 AS e FROM lineitem WHERE l_quantity >= 1),
r AS (SELECT *, max(e) OVER (PARTITION BY image_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM r),
m AS (SELECT image_id, isl, max(e) - min(s) AS n FROM i GROUP BY 1, 2)
SELECT image_id, count(*) AS bad_ranges, CAST(sum(n) AS BIGINT) AS bad_bytes, CAST(ceil(sum(n) / 512.0) AS BIGINT) AS bad_sectors FROM m GROUP BY 1""",
    "fat_free": f"""WITH {_FREE},
f AS (SELECT image_id, cluster, cluster - row_number() OVER (PARTITION BY image_id ORDER BY cluster) AS run FROM c WHERE nxt = 0 AND cluster > 2 AND cluster % 7 <> 0)
SELECT image_id, 512 + (min(cluster) - 2) * 4096 AS range_start, 512 + (max(cluster) - 1) * 4096 AS range_end FROM f GROUP BY image_id, run""",
    "free_space_notes": f"""WITH {_FREE},
f AS (SELECT image_id, count(*) * 4096 AS n FROM c WHERE nxt = 0 AND cluster > 2 GROUP BY 1),
v AS (SELECT s_suppkey AS image_id, s_nationkey % 5 <> 0 AND s_nationkey % 7 <> 0 AND coalesce(n, 0) > 0 AS reliable, coalesce(n, 0) AS free_bytes,
  CASE WHEN n IS NULL THEN '' ELSE 'table' END AS source FROM supplier LEFT JOIN f ON f.image_id = s_suppkey)
SELECT *, CASE WHEN reliable THEN 'carving restricted to unallocated space'
  ELSE 'no trustworthy allocation map for every partition; the whole volume is searched' END AS note FROM v""",
    "hash_load_summary": """
SELECT count(*) AS lines_read, count(*) FILTER (lang IN ('en', 'de')) AS lines_parsed, count(*) FILTER (lang NOT IN ('en', 'de')) AS lines_skipped,
  count(DISTINCT text) FILTER (lang = 'de') AS md5_digests, 0 AS sha1_digests, count(DISTINCT text) FILTER (lang = 'en') AS sha256_digests, 0 AS sha512_digests
FROM documents""",
    "session_identity": """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'the session''s image is not among those given'
  WHEN c_custkey % 3 = 0 THEN 'session was taken against a ' || c_custkey * 10 || '-byte target but the image is ' || (c_custkey * 10 + 1) || ' bytes; these are not the same image'
  WHEN c_custkey % 2 <> 0 THEN 'session fingerprint does not match; the image has changed since the session was written' END AS problem FROM customer""",
    "rejected_first": """
WITH r AS (SELECT l_suppkey AS image_id, l_orderkey * 10 + l_linenumber AS "offset" FROM lineitem WHERE l_returnflag = 'R'),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY "offset") AS rn, count(*) OVER (PARTITION BY image_id) AS rejected_total FROM r)
SELECT image_id, "offset", rejected_total, rejected_total > 20 AS truncated FROM k WHERE rn <= 20""",
    "wanted_extensions": "SELECT doc_id, '.' || upper(lang) AS extension FROM documents WHERE lang IN ('en', 'fr')",
    "resumed_counts": """
SELECT a.lang AS image_id, count(*) AS resumed FROM documents a WHERE doc_id % 2 = 1
  AND EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 0 AND b.lang = a.lang AND b.text = a.text) GROUP BY 1""",
}
