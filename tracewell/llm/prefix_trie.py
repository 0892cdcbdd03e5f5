"""A trie of conversations, turn by turn: compacted nodes hashed at two-fattest depths (a z-fast trie).

A conversation is the row of digests of its beginnings, one for each turn, so that comparing beginnings is comparing
digests. The trie is a table of compacted nodes, each with the digests of the edge that leads to it. It is hashed by
handles: of the depths that an edge covers, the one that the highest power of two divides. A conversation finds the
deepest node that it passes by fat binary search over its depths, a join a step, and leaves the trie somewhere on one of
the edges below. Conversations are inserted in batches: where they leave, edges are cut; what is new is combined by
digest into branches and ends before it becomes edges. In the end every edge is expanded into the nodes it stands for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tracewell.llm.tables import materialise

#: Digest of the empty beginning.
ROOT = bytes(16)
#: Shares of the conversations that the batches hold, smallest first: a small trie takes the hot beginnings off the rest.
BATCHES = (1 / 16, 3 / 16, 12 / 16)


@dataclass
class Trie:
    """``nodes``: one row per distinct beginning. ``members``: (conv_id, key), the node where each conversation ends."""

    nodes: DataFrame
    members: DataFrame


def digest_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, step, n_chars) of (conv_id, turn, role, text): a digest in place of role and text.

    Null role or text reads as empty. Rows without conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    step = F.unhex(F.substring(F.sha2(content, 256), 1, 32))
    return conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", step.alias("step"), F.char_length(text).cast("long").alias("n_chars"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, steps): the digests of each conversation by turn, null first; turns of the same number by digest.

    A conversation is one row of 24 bytes a turn. Texts are never gathered.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "step", "n_chars")))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["step"], t["n_chars"])).alias("steps"))


def _beginnings(rows: DataFrame) -> DataFrame:
    """(conv_id, path, chars): the digests of all beginnings but the empty one, and the lengths of their last texts."""
    kind = rows.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", kind), StructField("path", ArrayType(BinaryType())), StructField("chars", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, chars = [], []
            for steps in batch.column("steps").to_pylist():
                path, last = [], ROOT
                for step in steps:
                    last = hashlib.blake2b(last + step["step"], digest_size=16).digest()
                    path.append(last)
                paths.append(path)
                chars.append([step["n_chars"] for step in steps])
            made = [pa.array(paths, pa.list_(pa.binary())), pa.array(chars, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *made], ["conv_id", "path", "chars"])

    return rows.select("conv_id", "steps").mapInArrow(run, schema)


def two_fattest(low: Column, high: Column) -> Column:
    """Of the whole numbers over ``low`` up to ``high``, the one that the highest power of two divides."""
    power = F.call_function("shiftleft", F.lit(1), F.floor(F.log2(low.bitwiseXOR(high).cast("double"))).cast("int"))
    return (high - high % power).cast("int")


def _locate(trie: DataFrame, batch: DataFrame, rounds: int) -> DataFrame:
    """``batch`` with ``passed``, the depth of the deepest node of the trie that each conversation passes."""
    handle = F.element_at("path", two_fattest(F.col("above"), F.col("depth")) - F.col("above"))
    handles = trie.select(handle.alias("_probe"), F.col("key").alias("_key"), F.col("depth").alias("_depth"))
    rows = batch.withColumns({"passed": F.lit(0), "_high": F.size("path")})
    passed, high = F.col("passed"), F.col("_high")
    for _ in range(rounds):
        rows = rows.withColumn("_at", F.when(passed < high, two_fattest(passed, high)))
        # Whoever is done probes for a digest of its own that nothing has, so that they don't meet in one task.
        rows = rows.withColumn("_probe", F.coalesce(F.get("path", F.col("_at") - 1), F.concat("end", F.lit(b"-"))))
        hit = F.col("_key") == F.get("path", F.col("_depth") - 1)
        met = rows.join(handles, "_probe", "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
        moves = {
            "passed": F.when(F.col("_hit"), F.col("_depth")).otherwise(passed),
            "_high": F.when(F.col("_at").isNotNull() & ~F.col("_hit"), F.col("_at") - 1).otherwise(high),
        }
        rows = met.withColumns(moves).drop("_probe", "_key", "_depth", "_hit", "_at")
    return rows.drop("_high")


def _cut(trie: DataFrame, left: DataFrame) -> DataFrame:
    """The trie with its edges cut where conversations leave them."""
    cuts = left.where("shared > 0").groupBy(F.col("edge_key").alias("key")).agg(F.array_sort(F.collect_set("shared")).alias("cuts"))
    whole = trie.join(cuts, "key", "left")
    bounds = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.size("path")))
    pieces = whole.withColumn("bounds", bounds).select("*", F.posexplode(F.slice("bounds", 2, F.size("path"))).alias("i", "stop"))
    start = F.get("bounds", F.col("i"))
    return pieces.select(
        F.get("path", F.col("stop") - 1).alias("key"),
        (F.col("above") + F.col("stop")).alias("depth"),
        (F.col("above") + start).alias("above"),
        F.when(start == 0, F.col("parent")).otherwise(F.get("path", start - 1)).alias("parent"),
        F.slice("path", start + 1, F.col("stop") - start).alias("path"),
        F.slice("chars", start + 1, F.col("stop") - start).alias("chars"),
    )


def _grown(left: DataFrame) -> DataFrame:
    """The edges of what conversations have beyond the place where they leave the trie."""
    size = F.size("path")
    beyond = F.transform(
        F.sequence(F.col("leaves") + 1, size),
        lambda d: F.struct(
            F.get("path", d - 1).alias("key"), d.alias("depth"), F.when(d > 1, F.get("path", d - 2)).otherwise(F.lit(ROOT)).alias("before"),
            F.get("path", d).alias("next"), F.get("chars", d - 1).alias("n_chars"),
        ),
    )
    rows = left.where(size > F.col("leaves")).select(F.col("conv_id").alias("owner"), F.inline(beyond))
    # One row per beginning. It is a node if conversations part after it or one ends with it; it is owned by the first
    # that has it. What a conversation owns reaches from some depth to its end, and the depth above that is a node.
    combined = rows.groupBy("key").agg(
        F.min("owner").alias("owner"), F.min("depth").alias("depth"), F.min("before").alias("before"), F.min("n_chars").alias("n_chars"),
        (F.bool_or(F.col("next").isNull()) | (F.min("next") < F.max("next"))).alias("node"),
    )
    own = combined.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("depth", "key", "before", "n_chars", "node"))).alias("own"))
    stops = F.filter(F.sequence(F.lit(1), F.size("own")), lambda i: F.get("own", i - 1)["node"])
    edges = own.withColumn("stops", stops).select("own", "stops", F.posexplode("stops").alias("i", "stop"))
    edges = edges.withColumn("start", F.when(F.col("i") > 0, F.get("stops", F.col("i") - 1)).otherwise(0))
    edge = edges.select(F.slice("own", F.col("start") + 1, F.col("stop") - F.col("start")).alias("e"))
    first, last = F.get("e", F.lit(0)), F.element_at("e", -1)
    return edge.select(
        last["key"].alias("key"), last["depth"].alias("depth"), (first["depth"] - 1).alias("above"), first["before"].alias("parent"),
        F.col("e.key").alias("path"), F.col("e.n_chars").alias("chars"),
    )


def insert(trie: DataFrame | None, batch: DataFrame, rounds: int) -> DataFrame:
    """The trie with a batch of distinct conversations (conv_id, end, path, chars) in it.

    A trie is a table of edges: key, depth, above (depth of the parent), parent, path and chars along the edge.
    """
    if trie is None:
        return _grown(batch.withColumn("leaves", F.lit(0)))
    doors = trie.select(F.get("path", F.lit(0)).alias("_door"), F.col("key").alias("edge_key"), F.col("path").alias("edge"))
    placed = _locate(trie, batch, rounds)
    door = F.coalesce(F.get("path", F.col("passed")), F.concat("end", F.lit(b"-")))
    # A digest is equal only if all before it are: digests in common are a common beginning.
    shared = F.size(F.array_intersect("edge", F.slice("path", F.col("passed") + 1, F.size("path"))))
    left = placed.withColumn("_door", door).join(doors, "_door", "left").withColumn("shared", F.when(F.col("edge").isNotNull(), shared).otherwise(0))
    left = materialise(left.withColumn("leaves", F.col("passed") + F.col("shared")).select("conv_id", "path", "chars", "edge_key", "shared", "leaves"))
    return _cut(trie, left).unionByName(_grown(left))


def _expanded(trie: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes of the whole trie with what their subtrees hold."""
    places = ends.select("conv_id", "n_ends", F.explode("path").alias("key"))
    passed = materialise(places.join(trie.select("key", "depth"), "key"))
    held = passed.groupBy("key").agg(F.sum("n_ends").alias("n_convs"), F.min("conv_id").alias("first"))
    kids = trie.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_kids"))
    edges = trie.join(held, "key").join(kids, "key", "left").fillna(0, ["n_kids"])
    edges = materialise(edges.withColumn("saved", (F.col("n_convs") - 1) * F.aggregate("chars", F.lit(0).cast("long"), lambda a, c: a + c)))
    # Each edge belongs to the smallest conversation that passes it; on the path of that one it counts for all above.
    mine = F.col("first") == F.col("conv_id")
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    sums = passed.join(edges.select("key", "first", "saved", "n_kids"), "key").select(
        "key",
        F.sum(F.when(mine, F.col("saved")).otherwise(0)).over(deeper).alias("saved_tokens"),
        F.sum(F.when(mine & (F.col("n_kids") == 0), 1).otherwise(0)).over(deeper).alias("n_leaves"),
    )
    totals = sums.groupBy("key").agg(F.sum("saved_tokens").alias("total"), F.sum("n_leaves").alias("n_leaves"))
    # Children of the root find nothing, each under a key of its own.
    parents = edges.select(F.col("key").alias("_up"), F.col("first").alias("_up_first"))
    up = F.when(F.col("parent") == ROOT, F.concat("key", F.lit(b"-"))).otherwise(F.col("parent"))
    known = materialise(edges.join(totals, "key").withColumn("_up", up).join(parents, "_up", "left").drop("_up"))
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.coalesce(F.sum("n_ends"), F.lit(0)).alias("n_convs")).first()
    at, size = F.col("i"), F.size("path")
    rest = F.aggregate(F.slice("chars", 1, at), F.lit(0).cast("long"), lambda a, c: a + c)
    kind = ends.schema["conv_id"].dataType
    nodes = known.select("*", F.posexplode("path").alias("i", "node")).select(
        F.col("node").alias("key"),
        (F.col("above") + 1 + at).cast("long").alias("depth"),
        F.when(at == 0, F.col("parent")).otherwise(F.get("path", at - 1)).alias("parent_key"),
        F.col("first").alias("conv_id"),
        F.when(at > 0, F.col("first")).otherwise(F.coalesce("_up_first", F.lit(root.conv_id).cast(kind))).alias("parent_conv_id"),
        "n_convs",
        F.when(at < size - 1, 1).otherwise(F.col("n_kids")).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("total") - (F.col("n_convs") - 1) * rest).alias("saved_tokens"),
    )
    top = known.where("above = 0").agg(
        F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent_key"),
        F.lit(root.conv_id).cast(kind).alias("conv_id"), F.lit(None).cast(kind).alias("parent_conv_id"), F.lit(root.n_convs).alias("n_convs"),
        F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("total"), F.lit(0)).alias("saved_tokens"),
    )
    return nodes.unionByName(top.where("n_convs > 0"))


def build(rows: DataFrame, batches: tuple[float, ...] = BATCHES) -> Trie:
    """The trie of ``rows`` (conv_id, steps), which ``sequences`` makes.

    ``nodes``: key, depth, parent_key, conv_id (the smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (characters that members share, counted once less than they occur). ``members``: (conv_id, key).

    The root has depth 0. A conversation without turns ends there. No conversation, no node. Equal conversations
    are combined first, and count as members each. Conversations and beginnings meet in joins and pre-aggregated sums
    only; what one row holds is one conversation's digests. ``batches`` changes the work, not the trie.
    """
    paths = materialise(_beginnings(rows).withColumn("end", F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(ROOT))))
    firsts = paths.groupBy("end").agg(F.count("*").alias("n_ends"), F.min("conv_id").alias("conv_id"))
    ends = materialise(firsts.join(paths.select("conv_id", "path", "chars"), "conv_id"))
    longest = ends.agg(F.max(F.size("path"))).first()[0] or 0
    draw = (F.pmod(F.xxhash64("end"), F.lit(1 << 20)) / float(1 << 20)).alias("draw")
    trie, low = None, 0.0
    for k, share in enumerate(batches):
        high = 2.0 if k == len(batches) - 1 else low + share
        batch = ends.where((draw >= low) & (draw < high)).select("conv_id", "end", "path", "chars")
        trie = materialise(insert(trie, batch, int(longest).bit_length()))
        low = high
    return Trie(_expanded(trie, ends), paths.select("conv_id", F.col("end").alias("key")))


def prefix_trie(conversations: DataFrame) -> Trie:
    """The trie of a table (conv_id, turn, role, text); other columns are not looked at."""
    return build(sequences(digest_turns(conversations)))


def member_digests(members: DataFrame, chunk: int = 4096) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ids of the members that end at each node, ascending, joined by commas.

    Ids (whole numbers) are joined in chunks by range first; chunks are hashed as they come by, sorted.
    """
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    chunks = members.groupBy("key", F.floor(F.col("conv_id") / chunk).alias("part")).agg(ids.alias("ids"))
    ordered = chunks.repartition("key").sortWithinPartitions("key", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(keys: list[bytes], digests: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])

        key, digest = None, hashlib.sha256()
        for batch in batches:
            keys, digests = [], []
            for own, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        keys.append(key)
                        digests.append(digest.hexdigest())
                    key, digest = own, hashlib.sha256()
                digest.update(text.encode())
            yield rows(keys, digests)
        if key is not None:
            yield rows([key], [digest.hexdigest()])

    return ordered.select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")
