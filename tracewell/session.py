"""Session helpers: a tuned local session for tests and lineage cutting that survives executor loss."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every job relies on. Cluster deployments set memory and partition counts themselves.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "tracewell", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass your own session instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **DEFAULT_CONF,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is used only on a local master with the setting unset, because executors on
    other machines could not read it back.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` through a reliable checkpoint and return it with a fresh lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_width(df: DataFrame) -> int:
    """The session's shuffle partition count, for repartitions that must not be coalesced."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Even out rows before CPU-heavy work when the input came in fewer pieces than there are cores."""
    return df.repartition(shuffle_width(df), *columns)
