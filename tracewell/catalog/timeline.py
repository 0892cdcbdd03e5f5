"""Registered queries over journals, names, paths and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog.common import table
from tracewell.functions import bits
from tracewell.operators import directory, paths
from tracewell.operators import timeline as tl

# Reason bits each event type stands for; large values add a truncation bit.
_REASON = {"signup": 0x100, "view": 0x2, "error": 0x200, "click": 0x2000, "purchase": 0x11000}
_ENTRY_SHIFT = 1 << 48


def usn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change-journal records: the user is the file, the event number the USN."""
    return shape_events(table(spark, sf_dir, "events"))


def shape_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    mask = F.lit(0).cast("long")
    for kind, value in _REASON.items():
        mask = F.when(F.col("event_type") == kind, F.lit(value).cast("long")).otherwise(mask)
    large = F.col("value") > 50
    return events.select(
        F.lit("vol").alias("volume_id"),
        (F.col("user_id") + F.when(large, F.lit(_ENTRY_SHIFT)).otherwise(F.lit(0))).alias("file_reference"),
        F.col("event_id").alias("usn"),
        F.when(k % 7 != 3, F.col("ts").cast("timestamp")).alias("ts"),
        (mask + F.when(F.col("value") > 20, F.lit(4)).otherwise(F.lit(0))).alias("reason_mask"),
        k.alias("parent_reference"),
        F.when(k > 60, F.lit(0x10)).otherwise(F.lit(0x20)).cast("long").alias("file_attributes"),
        F.concat(F.lit("f"), k.cast("string")).alias("name"),
    )


def timeline_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = tl.fold_timeline(usn_records(spark, sf_dir), bucket_usn=1 << 12)
    return folded.select(
        "file_reference", "entry", "name", "parent_entry", F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("deleted_at").alias("deleted_us"), "renamed_from", "is_directory", "last_usn", "event_count",
        F.array_join("reasons", ",").alias("reasons"),
    )


def timeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.summarize(tl.fold_timeline(usn_records(spark, sf_dir), bucket_usn=1 << 12))


def naming_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.naming_events(usn_records(spark, sf_dir)).select("usn", "file_reference", "name")


def reason_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = usn_records(spark, sf_dir).select(F.array_join(bits.reason_names(F.col("reason_mask")), ",").alias("reasons"))
    return named.groupBy("reasons").agg(F.count("*").alias("n"))


def corroborated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(
        F.lit("vol").alias("volume_id"), F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("name")
    )
    marked = tl.corroborate(tl.fold_timeline(usn_records(spark, sf_dir), bucket_usn=1 << 12), names)
    return marked.select("file_reference", "name", "corroborated")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 10).cast("long").alias("record_num"), F.col("r_name").alias("name"),
        F.lit(5).cast("long").alias("parent_record"),
    )
    nation = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 100).cast("long"), F.col("n_name"), (F.col("n_regionkey") + 10).cast("long")
    )
    customer = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 10000).cast("long"), F.col("c_name"), (F.col("c_nationkey") + 100).cast("long")
    )
    return region.union(nation).union(customer).withColumn("image_id", F.lit("img"))


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.build_paths(_tree(spark, sf_dir)).select("record_num", "path")


def deep_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a binary tree under the root; parts of the largest size are lost records."""
    records = table(spark, sf_dir, "part").select(
        F.lit("img").alias("image_id"), (F.col("p_partkey") + 10).alias("record_num"), F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") == 0, F.lit(5)).otherwise(bits.int_div(F.col("p_partkey"), 2) + 10).cast("long").alias("parent_record"),
        "p_size",
    )
    alive = records.where("p_size < 50")
    return paths.build_paths(records.drop("p_size"), alive.drop("p_size")).select("record_num", "path")


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    cluster = F.col("p_partkey") + 2
    links = table(spark, sf_dir, "part").select(
        F.lit("img").alias("image_id"), cluster.alias("cluster"),
        F.when(size < 44, cluster + 1).when(size < 47, cluster + 3).when(size < 49, cluster - 5)
        .otherwise(F.lit(0x0FFFFFFF)).alias("next_cluster"),
    )
    heads = table(spark, sf_dir, "supplier").select(
        F.lit("img").alias("image_id"), (F.col("s_suppkey") * 7 + 2).alias("head"),
        (F.col("s_nationkey") * 3 + 1).alias("n_clusters"),
    )
    return paths.follow_chain(links, heads, max_clusters=16384)


def chain_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select("head", "pos", "cluster")


def chain_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.fragment_runs(_chains(spark, sf_dir)).select("head", "clusters", "fragment_count")


def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as an entry whose whole text is its long name, in fragments of 13 characters."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", 9).otherwise(7).alias("checksum"), F.coalesce("text", F.lit("")).alias("text")
    )
    pieces = turns.withColumn("n", F.expr("greatest(int((length(text) + 12) div 13), 1)"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("n"))))
    fragment = F.struct(
        F.col("piece").alias("sequence"), (F.col("piece") == F.col("n")).alias("is_last"), "checksum",
        F.col("text").substr(F.col("piece") * 13 - 12, F.lit(13)).alias("characters"),
    )
    grouped = pieces.groupBy("conv_id", "turn").agg(F.collect_list(fragment).alias("fragments"))
    expected = F.when(F.col("conv_id") % 2 == 0, F.lit(7))
    named = grouped.withColumn("n", directory.assemble_long_name(F.col("fragments"), expected))
    return named.select("conv_id", "turn", "n.long_name", F.col("n.level").alias("verification"))


def sanitize_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as device reports of a sanitize operation."""
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 1).when(
        F.col("event_type") == "error", 3).otherwise(0)
    words = table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") % 65536).cast("int").alias("sprog"),
        (code + F.when(k > 50, 256).otherwise(0) + F.shiftleft((k % 16), 12)).cast("int").alias("sstat"),
        (F.shiftleft((k % 6).cast("long"), 8) + F.shiftleft((k % 64).cast("long"), 15)).alias("scdw10"),
    )
    status = words.select("event_id", bits.sanitize_status(F.col("sprog"), F.col("sstat"), F.col("scdw10")).alias("s"))
    return status.select(
        "event_id", "s.status_code", bits.status_text(F.col("s.status_code")).alias("status_text"),
        "s.global_data_erased", "s.completed_passes", F.round("s.progress_fraction", 6).alias("progress_fraction"),
        bits.action_text(F.col("s.action")).alias("action_text"), "s.overwrite_passes",
        bits.tier_for_action(F.col("s.action")).alias("tier"),
    )


QUERIES = {
    "timeline_fold": timeline_fold,
    "timeline_summary": timeline_summary,
    "naming_events": naming_events,
    "reason_names": reason_names,
    "corroborated_names": corroborated_names,
    "paths": tree_paths,
    "paths_deep": deep_paths,
    "chain_follow": chain_follow,
    "chain_runs": chain_runs,
    "long_names": long_names,
    "sanitize_status": sanitize_status,
}

_USN = f"""
usn AS (
  SELECT event_id AS usn, user_id + CASE WHEN value > 50 THEN {_ENTRY_SHIFT} ELSE 0 END AS ref, user_id AS entry,
    CASE WHEN CAST(props->>'$.k' AS BIGINT) % 7 <> 3 THEN epoch_us(ts) END AS t, CAST(props->>'$.k' AS BIGINT) AS k,
    'f' || (props->>'$.k') AS name,
    CASE event_type WHEN 'signup' THEN 256 WHEN 'view' THEN 2 WHEN 'error' THEN 512 WHEN 'click' THEN 8192
      WHEN 'purchase' THEN 69632 ELSE 0 END + CASE WHEN value > 20 THEN 4 ELSE 0 END AS mask FROM events),
bitsof AS (SELECT unnest([{", ".join(f"{{'b': {b}, 'n': '{n}', 'i': {i}}}" for i, (b, n) in enumerate(bits.REASONS.items()))}]) AS r)"""
_FOLD = f"""WITH {_USN},
ord AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY usn, name) AS rn FROM usn),
named AS (SELECT ref, usn, name, lag(name) OVER (PARTITION BY ref ORDER BY usn, name) AS prev
          FROM ord WHERE rn = 1 OR mask & 8192 <> 0),
eff AS (SELECT ref, max_by(prev, usn) AS renamed_from FROM named WHERE prev IS NOT NULL AND prev <> name GROUP BY ref),
last AS (SELECT ref, max_by(name, usn) AS name FROM named GROUP BY ref),
reas AS (SELECT ref, string_agg(n, ',' ORDER BY u, i) AS reasons FROM (
  SELECT ref, r.n AS n, r.i AS i, min(usn) AS u FROM usn, bitsof WHERE mask & r.b <> 0 GROUP BY ALL) GROUP BY ref),
agg AS (SELECT ref, any_value(entry) AS entry, arg_min(k, usn) AS parent, arg_min(k, usn) > 60 AS is_directory,
  arg_min(t, usn) FILTER (WHERE mask & 13056 <> 0 AND t IS NOT NULL) AS created_us,
  max(usn) AS last_usn, count(*) AS event_count FROM usn GROUP BY ref),
del AS (SELECT ref, t AS deleted_us FROM (SELECT ref, t, row_number() OVER (PARTITION BY ref ORDER BY usn DESC) AS d
        FROM usn WHERE mask & 512 <> 0) WHERE d = 1),
tl AS (SELECT agg.*, last.name, renamed_from, deleted_us, reasons FROM agg JOIN last USING (ref) LEFT JOIN eff USING (ref)
       LEFT JOIN del USING (ref) LEFT JOIN reas USING (ref))
"""

SQL = {
    "timeline_fold": _FOLD + """SELECT ref AS file_reference, entry, name, parent AS parent_entry, created_us, deleted_us,
  renamed_from, is_directory, last_usn, event_count, coalesce(reasons, '') AS reasons FROM tl""",
    "timeline_summary": _FOLD + """SELECT 'vol' AS volume_id, count(*) AS files_tracked, count(deleted_us) AS deleted,
  count(renamed_from) AS renamed, count(*) FILTER (WHERE is_directory) AS directories,
  count(*) FILTER (WHERE entry = 0) AS entry_zero FROM tl""",
    "naming_events": f"WITH {_USN} SELECT usn, ref AS file_reference, name FROM usn WHERE mask & 13056 <> 0",
    "reason_names": f"""WITH {_USN},
j AS (SELECT usn, string_agg(r.n, ',' ORDER BY r.i) AS reasons FROM usn, bitsof WHERE mask & r.b <> 0 GROUP BY usn)
SELECT coalesce(reasons, '') AS reasons, count(*) AS n FROM usn LEFT JOIN j USING (usn) GROUP BY 1""",
    "corroborated_names": _FOLD + """,
m AS (SELECT ref, name, row_number() OVER (PARTITION BY name ORDER BY coalesce(deleted_us, 0) DESC, last_usn DESC, name) AS first
      FROM tl WHERE list_has_any(string_split(reasons, ','), ['FILE_CREATE', 'FILE_DELETE', 'RENAME_OLD_NAME', 'RENAME_NEW_NAME']))
SELECT ref AS file_reference, name, first > 1 OR name IN (SELECT 'f' || c_nationkey FROM customer) AS corroborated FROM m""",
    "paths": r"""
SELECT r_regionkey + 10 AS record_num, r_name AS path FROM region
UNION ALL SELECT n_nationkey + 100, r_name || '\' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT c_custkey + 10000, r_name || '\' || n_name || '\' || c_name
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "paths_deep": r"""
WITH RECURSIVE p AS (SELECT p_partkey + 10 AS rec, p_name AS name, p_size,
    CASE WHEN p_partkey = 0 THEN 5 ELSE p_partkey // 2 + 10 END AS parent FROM part),
w AS (
  SELECT rec, name AS path, parent AS nxt FROM p
  UNION ALL
  SELECT w.rec, CASE WHEN q.rec IS NULL THEN '<record ' || w.nxt || ' not found>' ELSE q.name END || '\' || w.path,
         CASE WHEN q.rec IS NULL THEN 5 ELSE q.parent END
  FROM w LEFT JOIN (SELECT * FROM p WHERE p_size < 50) q ON q.rec = w.nxt WHERE w.nxt <> 5)
SELECT rec AS record_num, path FROM w WHERE nxt = 5""",
    "chain_follow": """
WITH RECURSIVE link AS (SELECT p_partkey + 2 AS c, CASE WHEN p_size < 44 THEN p_partkey + 3 WHEN p_size < 47 THEN p_partkey + 5
    WHEN p_size < 49 THEN p_partkey - 3 ELSE 268435455 END AS n FROM part),
w AS (SELECT s_suppkey * 7 + 2 AS head, 0 AS pos, s_suppkey * 7 + 2 AS cluster, s_nationkey * 3 + 1 AS lim, [s_suppkey * 7 + 2] AS seen FROM supplier
  UNION ALL SELECT head, pos + 1, n, lim, list_append(seen, n) FROM w JOIN link ON c = cluster
  WHERE pos + 1 < lim AND n >= 2 AND n < 268435447 AND NOT list_contains(seen, n))
SELECT head, CAST(pos AS BIGINT) AS pos, cluster FROM w""",
    "long_names": r"""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 9 ELSE 7 END AS cs, coalesce(text, '') AS text,
  greatest((length(coalesce(text, '')) + 12) // 13, 1) AS pieces FROM conversations),
p AS (SELECT *, unnest(range(1, pieces + 1)) AS i FROM t),
g AS (SELECT conv_id, turn, count(*) AS n, max(i) AS hi, count(DISTINCT i) AS di, count(*) FILTER (WHERE i = pieces) AS lasts,
  count(DISTINCT cs) AS sums, min(cs) AS cs, regexp_replace(string_agg(substr(text, 13 * i - 12, 13), '' ORDER BY i), '\s+$', '') AS nm
  FROM p GROUP BY conv_id, turn),
v AS (SELECT *, hi = n AND di = n AND lasts = 1 AND sums = 1 AND (conv_id % 2 <> 0 OR cs = 7) AND nm <> '' AND length(nm) <= 255 AS good FROM g)
SELECT conv_id, turn, CASE WHEN good THEN nm END AS long_name,
  CASE WHEN NOT good THEN 'failed' WHEN conv_id % 2 = 0 THEN 'checksum' ELSE 'adjacency-only' END AS verification FROM v""",
    "sanitize_status": """
WITH e AS (SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, event_id % 65536 AS sprog,
  CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN 3 ELSE 0 END AS code FROM events)
SELECT event_id, code AS status_code, ['the NVM subsystem has never been sanitized',
    'the most recent sanitize operation completed successfully', 'a sanitize operation is currently in progress',
    'the most recent sanitize operation FAILED'][code + 1] AS status_text,
  k > 50 AS global_data_erased, CASE WHEN k % 16 <> 0 THEN k % 16 END AS completed_passes,
  CASE WHEN code = 2 THEN round(sprog / 65536.0, 6) END AS progress_fraction,
  CASE k % 6 WHEN 1 THEN 'exit failure' WHEN 2 THEN 'block erase' WHEN 3 THEN 'overwrite' WHEN 4 THEN 'crypto erase'
    WHEN 5 THEN 'exit media verification' ELSE 'unrecorded or unrecognised' END AS action_text,
  CASE WHEN k % 64 = 0 THEN 16 ELSE k % 64 END AS overwrite_passes,
  CASE k % 6 WHEN 2 THEN 'Sanitize' WHEN 4 THEN 'Sanitize' WHEN 3 THEN 'Purge' END AS tier FROM e""",
}
SQL["chain_runs"] = f"""
WITH ch AS ({SQL["chain_follow"]}),
s AS (SELECT head, pos, cluster, lead(cluster) OVER (PARTITION BY head ORDER BY pos) AS nxt FROM ch)
SELECT head, count(*) AS clusters, count(*) FILTER (WHERE pos >= 1 AND nxt IS NOT NULL AND nxt <> cluster + 1) + 1 AS fragment_count
FROM s GROUP BY head"""
