"""Written intermediate tables, and joins whose hot keys are split."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import checkpoint_folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage like a checkpoint, survives the loss of any executor, and is smaller than a checkpoint of rows. The
    folder is the cluster's; whoever owns it clears it after the job.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, width: int = 8) -> DataFrame:
    """Left join to ``right`` (one row per key) with every key of ``left`` dealt over ``width`` tasks by ``salt``.

    ``right`` is repeated ``width`` times, so it should hold narrow rows, and only keys that matter.
    """
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return left.withColumn("_salt", F.pmod(salt, F.lit(width)).cast("int")).join(copies, [*keys, "_salt"], "left").drop("_salt")
