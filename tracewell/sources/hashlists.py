"""Known-hash lists and reference trees as ``(algo, digest, source)`` tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.payloads import ALGORITHMS, digests_long

_NAMED = r"^\s*([A-Za-z0-9-]+)\s*,"


def normalise_algorithm(name: str) -> str:
    return name.strip().lower().replace("-", "").replace("_", "")


def _width(algo: Column) -> Column:
    pairs: list[Column] = []
    for name, width in ALGORITHMS.items():
        pairs += [F.lit(name), F.lit(width)]
    return F.element_at(F.create_map(*pairs), algo)


def _algo_of_width(width: Column) -> Column:
    return F.coalesce(*[F.when(width == w, F.lit(a)) for a, w in ALGORITHMS.items()])


def parse_hash_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Parse each line to ``algo``/``digest``, or say why it was skipped.

    Adds ``algo``, ``digest`` (lower case, null when unusable), ``reason`` (null when usable) and
    ``counted`` (false for blanks and comments).
    """
    raw = F.trim(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))
    counted = (raw != "") & ~raw.rlike(r"^(#|;|//)")
    named = F.replace(F.lower(F.regexp_extract(raw, _NAMED, 1)), F.lit("-"), F.lit(""))
    is_named = named.isin(*ALGORITHMS)
    rest = F.regexp_replace(raw, _NAMED, "")
    quoted = F.regexp_extract(rest, '"([0-9a-fA-F]{32,128})"', 1)
    field = F.trim(F.element_at(F.split(F.trim(rest), ","), 1))
    named_digest = F.when(quoted != "", quoted).when(field.rlike("^[0-9a-fA-F]+$"), field)
    token = F.element_at(F.split(raw, r"\s+"), 1)
    head = F.element_at(F.split(token, ","), 1)
    token = F.when(token.contains(",") & head.rlike("^[0-9a-fA-F]+$"), head).otherwise(token)
    bare_hex = token.rlike("^[0-9a-fA-F]+$")
    bare_algo = _algo_of_width(F.length(token))
    algo = F.when(is_named, named).when(bare_hex, bare_algo)
    digest = F.when(is_named, named_digest).when(bare_hex & bare_algo.isNotNull(), token)
    reason = (
        F.when(is_named & named_digest.isNull(), F.lit("NSRL row with no digest field"))
        .when(is_named & (F.length(named_digest) != _width(named)), F.concat(named, F.lit(" digest of the wrong length")))
        .when(~is_named & bare_hex & bare_algo.isNull(),
              F.concat(F.lit("digest of unrecognised length "), F.length(token).cast("string")))
        .when(~is_named & ~bare_hex, F.lit("unparseable line"))
    )
    usable = counted & reason.isNull()
    return lines.select(
        "*",
        F.when(usable, algo).alias("algo"),
        F.when(usable, F.lower(digest)).alias("digest"),
        F.when(counted, reason).alias("reason"),
        counted.alias("counted"),
    )


def skip_report(parsed: DataFrame) -> DataFrame:
    """Why lines were skipped, most frequent first."""
    return (
        parsed.where(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "reason")
    )


def load_summary(parsed: DataFrame) -> DataFrame:
    """Lines read, parsed and skipped, and distinct digests per algorithm; ``skip_report`` names the reasons."""
    per_algo = [
        F.count_distinct(F.when(F.col("algo") == a, F.col("digest"))).alias(f"{a}_digests") for a in ALGORITHMS
    ]
    return parsed.agg(
        F.count_if("counted").alias("lines_read"),
        F.count_if(F.col("digest").isNotNull()).alias("lines_parsed"),
        F.count_if(F.col("reason").isNotNull()).alias("lines_skipped"),
        *per_algo,
    )


def known_from_lines(parsed: DataFrame, algorithms: Sequence[str] | None = None) -> DataFrame:
    """Usable digests of parsed lines, optionally restricted to some algorithms."""
    known = parsed.where(F.col("digest").isNotNull())
    if algorithms:
        known = known.where(F.col("algo").isin(*[normalise_algorithm(a) for a in algorithms]))
    columns = ["algo", "digest", "source"] if "source" in parsed.columns else ["algo", "digest"]
    return known.select(*columns).dropDuplicates(["algo", "digest"])


def read_hash_list(spark: SparkSession, path: str, algorithms: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(known, skip_report)`` of a hash list; a list without a usable digest is refused."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.lit(path).alias("source"))
    parsed = parse_hash_lines(lines)
    known = known_from_lines(parsed, algorithms)
    if known.isEmpty():
        raise ValueError(f"{path} yielded no usable digests")
    return known, skip_report(parsed)


def hash_directory(spark: SparkSession, path: str, algorithms: Sequence[str] = ("sha256",)) -> DataFrame:
    """Digest every file below ``path`` with all algorithms in one read."""
    names = list(dict.fromkeys(normalise_algorithm(a) for a in algorithms))
    unknown = [n for n in names if n not in ALGORITHMS]
    if unknown:
        raise ValueError(f"unknown algorithm {unknown[0]!r}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return digests_long(files, ["path"], "content", names).select("algo", "digest", F.col("path").alias("source"))
