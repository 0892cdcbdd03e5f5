"""From raw documents to token ids: toxicity, line dedup, near-duplicates, decontamination, encoding.

``STAGES`` lists (name, function); each takes (spark, docs, sf_dir), where ``docs`` has the columns of ``documents``, and
all but the last return these columns. ``run`` writes each stage's result as Parquet for the next one to read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from tracewell.llm.catalog import toxicity_model
from tracewell.llm.tables import materialise

#: From this score on a document is rejected as toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under ``TOXIC``; the model learns from labelled rows of ``docs`` that are not held out."""
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.withColumnsRenamed({"score": "_own_score"}), model)
    return scored.where(F.col("score") < TOXIC).drop("score").withColumnsRenamed({"_own_score": "score"})


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the lines that an earlier one holds; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest doc_id."""
    linked = jaccard_join.link_documents(docs)
    copies = linked.where("component_id <> doc_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover less than a twentieth of the words."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the bytes they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(docs, *vocabulary, keep=["doc_id", "lang", "source"])
    return bpe.decode(ids, *vocabulary).select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode),
]
#: A learnt filter comes first, so SQL cannot name the rows; tests hold the later stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
