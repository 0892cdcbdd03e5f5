"""Walks over implicit graphs: parent references to full paths, cluster chains to ordered clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

ROOT_RECORD = 5
MAX_DEPTH = 32


def build_paths(
    records: DataFrame,
    names: DataFrame | None = None,
    keys: Sequence[str] = ("image_id",),
    root: int = ROOT_RECORD,
    separator: str = "\\",
) -> DataFrame:
    """Full path of each ``(keys, record_num, name, parent_record)`` row.

    ``names`` holds the records a parent may be looked up in (the records themselves by default).
    The walk stops at the root, on a cycle, after 32 ancestors, or at a missing parent, which is
    written as ``<record n not found>``. Ancestor chains are built by doubling over the distinct
    parents only (five self-joins whatever the depth), then attached to the records in one join.
    """
    keys = list(keys)
    names = records if names is None else names
    table = names.select(*keys, F.col("record_num").alias("__n"), F.col("name").alias("__name"), F.col("parent_record").alias("__p"))
    step = F.struct(F.col("__n").alias("num"), F.col("__name").alias("name"))
    parents = (
        records.where(F.col("parent_record").isNotNull())
        .select(*keys, F.col("parent_record").alias("__n"))
        .unionByName(table.where(F.col("__p").isNotNull()).select(*keys, F.col("__p").alias("__n")))
        .distinct()
    )
    # chain[0] is the record itself, so a file's ancestors are its parent's chain. Nothing above the
    # root or above a missing record is followed.
    onward = F.when((F.col("__n") != root) & F.col("__name").isNotNull() & (F.col("__name") != ""), F.col("__p"))
    chains = cut_lineage(
        parents.join(table, [*keys, "__n"], "left").select(*keys, "__n", F.array(step).alias("chain"), onward.alias("next"))
    )
    length = 1
    while length < MAX_DEPTH:
        tail = chains.select(*keys, F.col("__n").alias("next"), F.col("chain").alias("__more"), F.col("next").alias("__far"))
        joined = chains.join(tail, [*keys, "next"], "left")
        chains = cut_lineage(
            joined.select(
                *keys,
                "__n",
                F.when(F.col("__more").isNotNull(), F.concat("chain", "__more")).otherwise(F.col("chain")).alias("chain"),
                F.col("__far").alias("next"),
            )
        )
        length *= 2
    attached = records.join(
        chains.select(*keys, F.col("__n").alias("parent_record"), "chain"), [*keys, "parent_record"], "left"
    )
    chain = F.slice(F.coalesce("chain", F.array().cast("array<struct<num:bigint,name:string>>")), 1, MAX_DEPTH)
    # A fold over at most 32 ancestors: stop at the root or a repeat, name a missing record and stop.
    empty = F.struct(
        F.array().cast("array<string>").alias("parts"),
        F.array(F.col("record_num").cast("long")).alias("seen"),
        F.lit(False).alias("stop"),
    )

    def visit(acc, item):
        repeat = F.array_contains(acc["seen"], item["num"]) | (item["num"] == root)
        missing = item["name"].isNull() | (item["name"] == "")
        label = F.when(missing, F.concat(F.lit("<record "), item["num"].cast("string"), F.lit(" not found>"))).otherwise(item["name"])
        skip = acc["stop"] | repeat
        return F.struct(
            F.when(skip, acc["parts"]).otherwise(F.concat(F.array(label), acc["parts"])).alias("parts"),
            F.when(skip, acc["seen"]).otherwise(F.concat(acc["seen"], F.array(item["num"]))).alias("seen"),
            (skip | missing).alias("stop"),
        )

    own = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat(F.lit("record_"), F.col("record_num").cast("string")))
    folded = F.aggregate(chain, empty, visit, lambda acc: acc["parts"])
    return attached.withColumn("path", F.array_join(F.concat(folded, F.array(own)), separator)).select(*records.columns, "path")


# The first entry that is an end or bad-cluster mark.
FAT_END = 0x0FFFFFF7
EXFAT_END = 0xFFFFFFF8


def follow_chain(
    links: DataFrame,
    heads: DataFrame,
    max_clusters: int | None = None,
    keys: Sequence[str] = ("image_id",),
    end_mark: int = FAT_END,
) -> DataFrame:
    """Clusters of each file in chain order: ``(keys, head, pos, cluster)``.

    ``heads`` has ``(keys, head)`` and optionally ``n_clusters`` (how many the file size needs);
    ``links`` has ``(keys, cluster, next_cluster)``. The chain ends at an end mark, at the cluster
    where it would loop, or when the size is met; chains are whole unless ``max_clusters`` asks for the first. Reach doubles every round, so the number of joins
    is logarithmic in the longest chain.
    """
    keys = list(keys)
    need = F.col("n_clusters").cast("long") if "n_clusters" in heads.columns else F.lit(None).cast("long")
    limit = F.coalesce(F.least(need, F.lit(max_clusters).cast("long")), F.lit(1 << 62))
    reached = cut_lineage(
        heads.where(F.col("head") >= 2).select(
            *keys, "head", limit.alias("__limit"), F.lit(0).cast("long").alias("pos"), F.col("head").alias("cluster")
        ).where(F.col("__limit") > 0).distinct()
    )
    longest, count = reached.agg(F.coalesce(F.max("__limit"), F.lit(0)), F.count("*")).first()
    jump = cut_lineage(
        links.where((F.col("next_cluster") >= 2) & (F.col("next_cluster") < end_mark))
        .select(*keys, "cluster", F.col("next_cluster").alias("__to"))
    )
    reach = 1
    while reach < longest:
        ahead = (
            reached.join(jump, [*keys, "cluster"])
            .select(*keys, "head", "__limit", (F.col("pos") + reach).alias("pos"), F.col("__to").alias("cluster"))
            .where(F.col("pos") < F.col("__limit"))
        )
        # A cluster met twice means the chain loops: its first position is the one that counts.
        grown = reached.unionByName(ahead).groupBy(*keys, "head", "__limit", "cluster").agg(F.min("pos").alias("pos"))
        before, reached = count, cut_lineage(grown)
        count = reached.count()
        if count == before:
            break
        reach *= 2
        if reach < longest:
            hop = jump.select(*keys, F.col("cluster").alias("__to"), F.col("__to").alias("__far"))
            jump = cut_lineage(jump.join(hop, [*keys, "__to"]).select(*keys, "cluster", F.col("__far").alias("__to")))
    return reached.select(*keys, "head", "pos", "cluster")


def fragment_runs(chain: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Contiguous runs per file; the step from the first cluster to the second is not counted as a break."""
    keys = list(keys)
    nxt = chain.select(*keys, "head", (F.col("pos") - 1).alias("pos"), F.col("cluster").alias("__next"))
    breaks = chain.join(nxt, [*keys, "head", "pos"], "left")
    broken = (F.col("pos") >= 1) & F.col("__next").isNotNull() & (F.col("__next") != F.col("cluster") + 1)
    return breaks.groupBy(*keys, "head").agg(
        F.count("*").alias("clusters"), (F.count_if(broken) + 1).alias("fragment_count")
    )
