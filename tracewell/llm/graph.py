"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import lookup, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that ``edges`` (a, b) reach, for every node with an edge to another.

    Each round every vertex hooks to its smallest smaller neighbour, hooks are followed to their roots by doubling, and
    the edges between roots go on to the next round. A round leaves at most half of the vertices that had an edge, so
    rounds are logarithmic in the size of a component, whatever its shape. Hubs are salted in every join; the
    minimum of a hub's neighbours is combined before the shuffle. Loops, repeats and null ends are ignored.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = materialise(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*ends).distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        hooks = _roots(edges.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "vertex"))
        labels = materialise(_mapped(labels, hooks, "component", F.col("node")))
        moved = _mapped(_mapped(edges, hooks, "a", F.col("b")), hooks, "b", F.col("a"))
        edges = materialise(moved.where("a <> b").select(*ends).distinct())
    return labels


def _mapped(rows: DataFrame, hooks: DataFrame, column: str, salt: Column) -> DataFrame:
    keyed = hooks.withColumnsRenamed({"vertex": column, "root": "_root"})
    return lookup(rows, keyed, [column], F.xxhash64(salt)).withColumn(column, F.coalesce("_root", column)).drop("_root")


def _roots(hooks: DataFrame) -> DataFrame:
    """(vertex, root) with every root followed to its end; roots are smaller than their vertices, so there is one."""
    hooks = materialise(hooks)
    while True:
        further = hooks.select(F.col("vertex").alias("root"), F.col("root").alias("_next"))
        jumped = lookup(hooks, further, ["root"], F.xxhash64("vertex"))
        hooks = materialise(jumped.select("vertex", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if hooks.where("_moved").isEmpty():
            return hooks.select("vertex", "root")
        hooks = hooks.select("vertex", "root")
