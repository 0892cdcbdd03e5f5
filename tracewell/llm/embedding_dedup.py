"""Embedding near-dedup: sign hashes of random hyperplanes in several tables, exact cosines, connected components.

Equal vectors are one class from the start. Vectors that agree on all signs of a table share a bucket of it. Large
buckets are cut into blocks, and every pair of blocks is a unit of work of its own, so no bucket is a task. A pair that
meets in several tables counts in the first only: both ends' codes in the earlier tables are at hand. Pairs are never
emitted: a unit returns, per vector, how many links it found and the smallest vector of its component in the unit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.llm.graph import components
from tracewell.llm.tables import lookup, materialise

COSINE = 0.9
#: Share of the pairs at the least cosine that the tables are to find; closer pairs are found more often.
RECALL = 0.98
#: Vectors that a bucket of evenly spread vectors holds.
BUCKET = 32
#: Vectors in one block of a bucket.
BLOCK = 512
SEED = 20


def plan_tables(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): bits so that ``n`` spread vectors fill buckets of ``BUCKET``, tables so that recall holds."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / BUCKET)))) if n > BUCKET else 4
    agree = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _planes(bits: int, tables: int, size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, bits * tables))


def _scaled(lists: pa.Array, size: int) -> np.ndarray:
    """Unit vectors in double precision; scaling first keeps the squares of huge and tiny components in range."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``classes`` with dims and codes, the sign code of every table."""
    schema = StructType([*classes.schema.fields, *StructType.fromDDL("dims int, codes array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                signs = _scaled(part.column("embedding"), int(size)) @ _planes(bits, tables, int(size)) >= 0
                codes = signs.reshape(part.num_rows, tables, bits) @ (1 << np.arange(bits))
                ends = pa.array(np.arange(part.num_rows + 1) * tables, pa.int32())
                made = pa.ListArray.from_arrays(ends, pa.array(codes.ravel(), pa.int32()))
                dims = pa.array(np.full(part.num_rows, size), pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, dims, made], names=schema.names)

    return classes.mapInArrow(run, schema)


def _local_roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of ``n`` vertices reaches by the edges a-b."""
    root = ids.copy()
    place = {int(i): k for k, i in enumerate(ids)}
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[[place[int(i)] for i in new]]
        if (new == root).all():
            return root
        root = new


def _unit(rows: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors with links, number of their links, smallest vector they reach) of one unit."""
    first = {c: rows.column(c)[0].as_py() for c in ("t", "dims", "i", "j")}
    block = rows.column("block").to_numpy()
    ids, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
    lists = rows.column("embedding").combine_chunks()
    unit = _scaled(lists, first["dims"])
    codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    left, right = np.flatnonzero(block == first["i"]), np.flatnonzero(block == first["j"])
    close = unit[left] @ unit[right].T >= cosine
    if first["i"] == first["j"]:
        close = np.triu(close, 1)
    a, b = np.nonzero(close)
    a, b = left[a], right[b]
    if first["t"] and len(a):
        fresh = np.ones(len(a), dtype=bool)
        for t in range(first["t"]):
            fresh &= codes[a, t] != codes[b, t]
        a, b = a[fresh], b[fresh]
    n = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    some = np.flatnonzero(n)
    return ids[some], n[some].astype(np.int64), _local_roots(len(ids), a, b, ids)[some]


def _work(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Units of work from rows sorted by unit; the last unit of a batch waits for the next batch."""
    keys, rest = ["t", "dims", "code", "i", "j"], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        whole = np.column_stack([table.column(c).to_numpy() for c in keys])
        cuts = np.flatnonzero((whole[1:] != whole[:-1]).any(axis=1)) + 1
        starts = np.concatenate([[0], cuts])
        yield from _answers([table.slice(s, e - s) for s, e in zip(starts[:-1], starts[1:], strict=True)], cosine)
        rest = table.slice(int(starts[-1])).combine_chunks() if len(starts) else None
    if rest is not None:
        yield from _answers([rest], cosine)


def _answers(units: list[pa.Table], cosine: float) -> Iterator[pa.RecordBatch]:
    found = [_unit(u, cosine) for u in units if u.num_rows > 1]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["rep", "n", "root"])


def link_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding).

    Two rows link if their vectors' cosine, in double precision, is at least ``cosine`` and a table brings them together,
    which for pairs just at ``cosine`` happens with probability ``recall``; equal vectors always link. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths.
    vec_id should be unique: repeats of a row count as vectors of their own that link with each other. A null vec_id
    links with nothing. Other columns are not read. An empty table gives no rows.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))
    hashes = [F.when(sound, F.xxhash64("embedding")).alias("h1"), F.when(sound, F.xxhash64(F.lit(7), "embedding")).alias("h2")]
    keyed = given.select("vec_id", *hashes, F.when(sound, F.col("embedding")).alias("embedding"))
    grouped = keyed.where("h1 IS NOT NULL").groupBy("h1", "h2")
    classes = materialise(grouped.agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    bits, tables = plan_tables(classes.count(), cosine, recall)
    hashed = materialise(_hashed(classes.select("rep", "copies", "embedding"), bits, tables))
    codes = hashed.select("rep", "dims", F.posexplode("codes").alias("t", "code"))
    large = materialise(codes.groupBy("t", "dims", "code").count().where(F.col("count") > BLOCK))
    blocks = large.select("t", "dims", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("g"))
    rows = hashed.select("rep", "copies", "embedding", "dims", "codes", F.posexplode("codes").alias("t", "code"))
    if blocks.isEmpty():
        rows = rows.withColumn("g", F.lit(1))
    else:
        rows = lookup(rows, blocks, ["t", "dims", "code"], F.xxhash64("rep")).withColumn("g", F.coalesce("g", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumns({
        "i": F.least("block", "other").cast("int"), "j": F.greatest("block", "other").cast("int")
    })
    keys = ["t", "dims", "code", "i", "j"]
    units = rows.select(*keys, "block", "rep", "copies", "embedding", "codes").repartition(*keys).sortWithinPartitions(*keys)
    found = materialise(units.mapInArrow(lambda batches: _work(batches, cosine), "rep long, n long, root long"))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    answers = materialise(links.join(joined.withColumnRenamed("node", "rep"), "rep", "left"))
    copied = classes.where("copies > 1").select("h1", "h2", "rep", "copies")
    owned = lookup(keyed.select("vec_id", "h1", "h2"), copied, ["h1", "h2"], F.xxhash64("vec_id"))
    owned = owned.select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"), F.col("h1").isNotNull().alias("sound"))
    whole = lookup(owned, answers, ["rep"], F.xxhash64("vec_id"))
    return whole.select(
        "vec_id",
        F.when(F.col("sound"), F.coalesce("n", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("sound"), F.coalesce("component", "rep")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
