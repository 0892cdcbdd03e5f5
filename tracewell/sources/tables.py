"""Text and document sources and sinks: bodyfiles, sessions, ledgers, certificates, indexes and payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import sanitize_filename
from tracewell.operators.extents import merge_extents
from tracewell.operators.ledger import BLOCK_SCHEMA
from tracewell.operators.payloads import rejected_sample, rejection_histogram

SESSION_FORMAT = "carve-session"
SESSION_VERSION = 1
INDEX_SCHEMA = "recovery-index/1"


def parse_bodyfile(lines: DataFrame, column: str = "value") -> DataFrame:
    """``start end`` rows of text; comments, blanks and malformed rows are skipped."""
    body = F.trim(F.regexp_replace(F.split(F.col(column), "#")[0], r"\s+", " "))
    parts = F.split(body, " ")
    start, end = F.get(parts, F.lit(0)).try_cast("long"), F.get(parts, F.lit(1)).try_cast("long")
    kept = [c for c in lines.columns if c != column]
    return lines.select(*kept, start.alias("start"), end.alias("end")).where("start IS NOT NULL AND end IS NOT NULL")


def read_bodyfile(spark: SparkSession, path: str | list[str], image_id: str = "image") -> DataFrame:
    """Merged inclusive extents of one or several bodyfiles."""
    lines = spark.read.text(path).withColumn("image_id", F.lit(image_id))
    return merge_extents(parse_bodyfile(lines))


def write_bodyfile(extents: DataFrame, path: str, comment: str = "") -> tuple[int, int]:
    """Merge, sort and write extents of one image as text; returns ``(rows, bytes)``.

    The rows are range-sorted part files: read in name order they are one ascending bodyfile.
    """
    merged = merge_extents(extents)
    totals = merged.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("b")).first()
    rows = merged.select(F.lit(1).alias("k"), "start", F.concat_ws(" ", "start", "end").alias("value"))
    if comment:
        spark = extents.sparkSession
        notes = [(0, i, f"# {line}") for i, line in enumerate(comment.splitlines())]
        rows = spark.createDataFrame(notes, "k int, start long, value string").unionByName(rows)
    rows.orderBy("k", "start").select("value").write.mode("overwrite").text(path)
    return totals.n, totals.b


def merge_bodyfiles(spark: SparkSession, paths: list[str], destination: str) -> tuple[int, int]:
    return write_bodyfile(read_bodyfile(spark, paths), destination, f"merged from {len(paths)} bodyfile(s)")


_ENTRY = T.StructType(
    [
        T.StructField("offset", T.StringType()), T.StructField("length", T.StringType()), T.StructField("sha256", T.StringType()),
        T.StructField("extension", T.StringType()), T.StructField("original_name", T.StringType()),
        T.StructField("recovered_path", T.StringType()),
    ]
)
_SESSION = T.StructType(
    [
        T.StructField("format", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("target_path", T.StringType()),
        T.StructField("target_size", T.LongType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("policy", T.MapType(T.StringType(), T.StringType())), T.StructField("entries", T.ArrayType(_ENTRY)),
        T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("_corrupt", T.StringType()),
    ]
)


def _refuse(problem: Column, value: Column) -> Column:
    return F.when(problem.isNull(), value).otherwise(F.raise_error(problem).cast("string"))


def read_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(sessions, entries)`` of session documents, one JSON document per file.

    A document of another kind, or written by a newer version, is an error; one malformed entry is
    dropped and the rest kept.
    """
    docs = (
        spark.read.schema(_SESSION).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("source", F.input_file_name())
    )
    problem = (
        F.when(F.coalesce(F.col("format"), F.lit("")) != SESSION_FORMAT, F.concat(F.col("source"), F.lit(" is not a carve session")))
        .when(F.col("version").isNull(), F.concat(F.lit("session "), F.col("source"), F.lit(" has no format version")))
        .when(
            F.col("version") > SESSION_VERSION,
            F.concat(F.lit("session "), F.col("source"), F.lit(" is newer than this library understands")),
        )
    )
    checked = docs.withColumn("target_path", _refuse(problem, F.coalesce("target_path", F.lit(""))))
    sessions = checked.select(
        "target_path", F.coalesce("target_size", F.lit(0)).alias("target_size"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
        "policy", "warnings", "source",
    )
    rows = checked.select("target_path", F.inline("entries"))
    entries = rows.select(
        F.col("target_path").alias("image_id"), F.col("offset").try_cast("long").alias("offset"), F.col("length").try_cast("long").alias("length"),
        F.coalesce("sha256", F.lit("")).alias("sha256"), F.coalesce("extension", F.lit("")).alias("extension"), "original_name", "recovered_path",
    ).where("offset IS NOT NULL AND length IS NOT NULL")
    return sessions, entries


def write_sessions(sessions: DataFrame, entries: DataFrame, path: str) -> None:
    """Store sessions as tables: ``path/sessions`` and ``path/entries`` (committed atomically by the writer)."""
    sessions.withColumn("format", F.lit(SESSION_FORMAT)).withColumn("version", F.lit(SESSION_VERSION)).write.mode("overwrite").parquet(f"{path}/sessions")
    entries.write.mode("overwrite").parquet(f"{path}/entries")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def read_ledger(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Ledger blocks; a missing ledger reads as empty and is never created."""
    if not _exists(spark, path):
        return spark.createDataFrame([], BLOCK_SCHEMA)
    return spark.read.schema(BLOCK_SCHEMA).format(fmt).load(path)


def read_certificates(spark: SparkSession, path: str) -> DataFrame:
    """``(path, certificate_json)``, one document per file; anything that is not JSON has null ``parsed``."""
    docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("certificate_json")
    )
    return docs.withColumn("parsed", F.try_parse_json("certificate_json"))


def recovery_index(result, top_reasons: int | None = None, sample: int | None = None) -> dict[str, DataFrame]:
    """The machine-readable index of a carving result as tables.

    ``recovered`` (without payloads), ``summary``, the rejection reasons by how common they are, and the rejections
    beside their full count; all reasons and rejections unless ``top_reasons`` or ``sample`` asks for the first.
    """
    return {
        "recovered": result.recovered.drop("payload", "ord"),
        "summary": result.summary.withColumn("schema", F.lit(INDEX_SCHEMA)),
        "rejection_summary": rejection_histogram(result.rejected, top_reasons),
        "rejected_sample": rejected_sample(result.rejected, order=("ord",), k=sample).drop("ord"),
    }


def write_recovery_index(result, path: str, fmt: str = "json", top_reasons: int | None = None, sample: int | None = None) -> None:
    for name, table in recovery_index(result, top_reasons, sample).items():
        table.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def write_payloads(recovered: DataFrame, path: str) -> None:
    """Store payloads as a table keyed by a path-safe name; the usual sink at scale."""
    recovered.withColumn("filename", sanitize_filename(F.col("filename"))).write.mode("overwrite").parquet(path)


def export_payloads(recovered: DataFrame, directory: str) -> DataFrame:
    """Write one object per payload below a shared directory and return what was written.

    Names are sanitised and prefixed per image, and a file is replaced whole, so a task that runs
    again after a lost executor leaves the same files.
    """
    import pyarrow.fs as pafs

    named = recovered.select(
        "image_id", F.concat(F.sha2("image_id", 256).substr(1, 12), F.lit("_"), sanitize_filename(F.col("filename"))).alias("object"), "payload"
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = pafs.FileSystem.from_uri(directory) if "://" in directory else (pafs.LocalFileSystem(), directory)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for name, data in zip(batch["object"], batch["payload"]):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(bytes(data))
            yield pd.DataFrame({"image_id": batch["image_id"], "path": [f"{base}/{n}" for n in batch["object"]],
                                "bytes": [len(p) for p in batch["payload"]]})

    return named.mapInPandas(write, "image_id string, path string, bytes long")


def write_results(df: DataFrame, path: str, fmt: str) -> None:
    """The same rows as CSV or JSON; nested columns become JSON text in CSV."""
    if fmt == "csv":
        flat = [
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
            for f in df.schema.fields
        ]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").json(path)
