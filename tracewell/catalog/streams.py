"""Registered queries that replay the given tables through the streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog.ledger import _chain
from tracewell.catalog.timeline import _FOLD, shape_events
from tracewell.functions.canonical import BLOCK_STRINGS
from tracewell.session import checkpoint_folder
from tracewell.streaming.ledger import monitor_ledger
from tracewell.streaming.timeline import latest_rows, stream_timeline

#: What the monitor reads of a block, and the price that says where this query alters one.
_HASHED = ["chain_id", "block_index", *BLOCK_STRINGS, "block_hash", "price"]
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own below the shared one, which may be on any file system that Spark writes."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _replay(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a bounded stream to its end into a table and read it back."""
    folder = _folder(spark, "replay")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, _ROCKS)
    try:
        out = f"{folder}/out"

        def store(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = (
            stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return spark.read.schema(stream.schema).parquet(out)


def _as_stream(spark: SparkSession, path: str) -> DataFrame:
    """The files of a table as a stream of four batches, however many files there are: every batch costs a commit of every
    state partition."""
    stored = spark.read.parquet(path)
    files = len(stored.inputFiles())
    return spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", max(4, -(-files // 4))).parquet(path)


def stream_timeline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events replayed as files through the keyed fold."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    updates = _replay(spark, stream_timeline(shape_events(stream)), "update")
    return latest_rows(updates).select(
        "file_reference", "name", "renamed_from", F.unix_micros("created_at").alias("created_us"),
        F.unix_micros("deleted_at").alias("deleted_us"), "last_usn", "event_count",
    )


def stream_ledger_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' ledger with some blocks altered, replayed as files; one row per alert."""
    folder = _folder(spark, "ledger")
    altered = _chain(spark, sf_dir, _HASHED).withColumn(
        "operator_id", F.when(F.col("price").between(460000, 462999), F.lit("intruder")).otherwise(F.col("operator_id"))
    ).withColumn("prev_hash", F.when(F.col("price").between(470000, 472999), F.lit("f" * 64)).otherwise(F.col("prev_hash"))).drop("price")
    altered.write.parquet(f"{folder}/blocks")
    alerts = _replay(spark, monitor_ledger(_as_stream(spark, f"{folder}/blocks"), patience_seconds=None), "append")
    return alerts.select("chain_id", "block_index", "kind", "detail")


QUERIES = {"stream_timeline": stream_timeline_query, "stream_ledger": stream_ledger_query}

SQL = {
    "stream_timeline": _FOLD + "SELECT ref AS file_reference, name, renamed_from, created_us, deleted_us, last_usn, event_count FROM tl",
    "stream_ledger": """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS chain_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS block_index,
             CAST(trunc(o_totalprice) AS BIGINT) AS price FROM orders)
SELECT chain_id, block_index, 'hash' AS kind, 'recomputed hash differs from stored hash' AS detail FROM o
WHERE price BETWEEN 460000 AND 462999 OR price BETWEEN 470000 AND 472999
UNION ALL SELECT chain_id, block_index, 'link', 'prev_hash does not match previous block hash' FROM o WHERE price BETWEEN 470000 AND 472999""",
}
