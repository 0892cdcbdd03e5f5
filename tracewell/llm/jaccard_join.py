"""N-gram Jaccard join with PartEnum signatures.

Sizes are cut into bands so that sets that can link lie in one band or in neighbouring ones. For every pair of bands
the largest symmetric difference k of two linked sets is known, so if the feature domain is partitioned into a fifth
more than k + 1 parts, linked sets agree on a fifth of k or more. The signature of a part is a hash of what a set holds
in it; sets that can link share so many. Parts empty in both sets would be shared by strangers: sets with too many empty parts sign a second
and a third partition of the domain too, and empty parts only in the last, if the others might still not do.

Signatures travel as packed blocks, one per task and bucket. A bucket returns its signatures that several documents
share. Each document joins the family of the partner that it shares most with. Where a group holds several families,
its documents visit those that come before their own. The sets of a family and its visitors meet in one unit of work,
or in one for every two blocks of a large family, and a unit checks pairs exactly, skipping those that links already
join. Before that a family of very many documents is thinned: every document is checked against its likeliest partner,
and only groups that still hold several components stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.arrow import LOWER, SOLID, U64, flat, hash_spans, map_text, mix, release, slices, windows, words
from tracewell.llm.graph import components
from tracewell.llm.tables import lookup, materialise

N = 5
THRESHOLD = 80
#: Partitions of the domain that are tried before empty parts are signed.
LEVELS = 3
#: Bytes of text in one step of a task.
STEP = 1 << 20
#: Rows of ids that are broadcast: at most some tens of megabytes.
BROADCAST = 1_000_000
#: Shingles and documents of one block of a family, and the blocks from which on a family is thinned first.
BLOCK = 1_000_000
BLOCK_DOCS = 1024
THIN = 8
#: Pairs of one document that meet in one task.
FAN = 256
#: Signatures of one bucket.
BUCKET = 400_000


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct shingles of every text, sorted within it.

    Words are runs of anything but ASCII blanks, A-Z lower-cased. A text of fewer than ``n`` words has one shingle,
    all its words; one without words has none.
    """
    data, offsets = flat(column)
    starts, ends = words(data, offsets, SOLID)
    hashes = hash_spans(LOWER[data], starts, ends)
    counts = np.diff(np.searchsorted(starts, offsets))
    found, first = windows(hashes, counts, n)
    owner = np.repeat(np.arange(len(counts)), counts)[first]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            at = np.searchsorted(starts, offsets[short])
            whole, _ = windows(hashes[(at[:, None] + np.arange(size)).ravel()], np.full(len(short), size), size)
            found, owner = np.concatenate([found, whole]), np.concatenate([owner, short])
    ends = np.cumsum(np.bincount(owner, minlength=len(counts)))
    if len(found) and (np.diff(owner) < 0).any():
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    for a, b in zip(ends - np.diff(np.concatenate([[0], ends])), ends, strict=True):
        found[a:b].sort()
    keep = np.ones(len(found), dtype=bool)
    keep[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[keep], np.bincount(owner[keep], minlength=len(counts))


class Bands:
    """Size bands for a threshold in hundredths, as far as a largest size."""

    def __init__(self, threshold: int, largest: int):
        self.least = [1]
        while self.least[-1] <= largest:
            self.least.append(self.least[-1] * 100 // threshold + 1)
        top = [x - 1 for x in self.least[1:]]
        # Instance i holds bands i - 1 and i. |s| + |t| bounds the difference of linked sets: (1 - J) / (1 + J) of it.
        top = [top[0], *top]
        # By the rule of all others, so that instances do not depend on ``largest``: steps build tables of their own.
        top.append(self.least[-1] * 100 // threshold)
        self.apart = np.array([(100 - threshold) * (a + b) // (100 + threshold) for a, b in zip(top[:-1], top[1:], strict=True)])
        self.parts = self.apart + 1 + (self.apart + 1) // 5
        #: Parts of any one partition that linked sets agree on at least.
        self.spare = self.parts - self.apart
        #: Signatures that they share at least; a quarter of those parts may be empty before another partition is signed.
        self.need = self.spare - self.spare // 4

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.least, sizes, "right") - 1


def _sums(group: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit values by group, modulo 2**64; halves are exact as floats."""
    low = np.bincount(group, (values & U64(0xFFFFFFFF)).astype(float), size)
    high = np.bincount(group, (values >> U64(32)).astype(float), size)
    return low.astype(U64) + (high.astype(U64) << U64(32))


def _parts(found: np.ndarray, sizes: np.ndarray, live: np.ndarray, instance: np.ndarray, parts: np.ndarray, level: int):
    """(base of each live set's parts, part of each shingle counted from there on, hash of each shingle)."""
    base = np.cumsum(parts) - parts
    chosen = np.zeros(len(sizes), dtype=bool)
    chosen[live] = True
    owner = np.repeat(np.arange(len(live)), sizes[live])
    hashes = mix(found[np.repeat(chosen, sizes)] ^ mix(((instance << 2) + level + 1).astype(U64) << U64(20))[owner])
    part = ((hashes >> U64(32)) * parts[owner].astype(U64)) >> U64(32)
    return base, base[owner] + part.astype(np.int64), hashes


def signatures(found: np.ndarray, sizes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all sets; empty sets have none."""
    bands = Bands(threshold, int(sizes.max(initial=1)))
    own = bands.of(np.maximum(sizes, 1))
    sets, signed = [], []
    for up in (0, 1):
        live = np.flatnonzero(sizes > 0)
        sure = np.zeros(len(sizes), np.int64)
        for level in range(LEVELS):
            if not len(live):
                break
            instance = own[live] + up
            parts = bands.parts[instance]
            base, group, hashes = _parts(found, sizes, live, instance, parts, level)
            total = int(parts.sum())
            filled = np.bincount(group, minlength=total)
            place = np.repeat(np.arange(len(live)), parts)
            nth = np.arange(total) - base[place]
            sign = mix(_sums(group, mix(hashes), total) ^ mix((instance.astype(U64)[place] << U64(34)) + (nth.astype(U64) << U64(2)) + U64(level)))
            empty = np.bincount(place[filled == 0], minlength=len(live))
            sure[live] += np.maximum(0, bands.spare[instance] - empty)
            put = filled > 0
            if level == LEVELS - 1:
                put |= (sure[live] < bands.need[instance])[place]
            sets.append(live[place[put]])
            signed.append(sign[put])
            live = live[sure[live] < bands.need[instance]]
    return (np.concatenate(sets), np.concatenate(signed)) if sets else (np.zeros(0, np.int64), np.zeros(0, U64))


def needed(sizes: np.ndarray, threshold: int) -> np.ndarray:
    """How many signatures any set that links with this one shares with it at least.

    In each partition that both sign, linked sets share what they agree on but for parts empty in both. A set stops when
    this alone makes enough, whatever the other set is; if neither does, both sign their empty parts in the last.
    """
    bands = Bands(threshold, int(sizes.max(initial=1)))
    own = bands.of(np.maximum(sizes, 1))
    return np.where(sizes > 0, np.minimum(bands.need[own], bands.need[own + 1]), 1)


def _digests(column: pa.Array, n: int, threshold: int) -> list[pa.Array]:
    found, sizes = shingle_sets(column, n)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    digests = [_sums(owner, mix(found ^ U64(salt)), len(sizes)).view(np.int64) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return [pa.array(sizes, pa.int64()), pa.array(needed(sizes, threshold), pa.int64()), *[pa.array(d, pa.int64()) for d in digests]]


def _blocks(batches: Iterator[pa.RecordBatch], n: int, threshold: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, block): the documents of a bucket, how many signatures each has there, and 48 bits of each signature.

    The other 16 bits chose the bucket. Of documents of one set that a task meets in one step only the first signs: their links are known.
    """
    for batch in batches:
        for part in slices(batch, size=STEP):
            found, sizes = shingle_sets(part.column("text"), n)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            _, first = np.unique(_sums(owner, mix(found), len(sizes)), return_index=True)
            once = np.zeros(len(sizes), dtype=bool)
            once[first] = True
            found, sizes = found[np.repeat(once, sizes)], sizes[once]
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[once]
            sets, signed = signatures(found, sizes, threshold)
            if not len(sets):
                continue
            bucket = (signed & U64(0xFFFFFF)) % U64(buckets)
            order = np.lexsort((sets, bucket))
            sets, signed, bucket = sets[order], signed[order], bucket[order]
            names, starts = np.unique(bucket, return_index=True)
            made = []
            for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
                docs, runs = np.unique(sets[a:b], return_counts=True)
                made.append(_packed(ids[docs], runs, signed[a:b] >> U64(16)))
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(made, pa.binary())], names=["bucket", "block"])
    release()


def _packed(ids: np.ndarray, runs: np.ndarray, signed: np.ndarray) -> bytes:
    """Ids as distances from the least, in the narrowest types that hold them, and 48-bit signatures."""
    base = int(ids.min())
    away = ids.astype(U64) - np.int64(base).astype(U64)
    types = [np.min_scalar_type(int(x.max())).str.encode().ljust(4) for x in (away, runs)]
    head = np.array([len(ids), base], np.int64).tobytes() + b"".join(types)
    return b"".join([
        head, away.astype(types[0].decode().strip()).tobytes(), runs.astype(types[1].decode().strip()).tobytes(),
        (signed >> U64(16)).astype(np.uint32).tobytes(), signed.astype(np.uint16).tobytes(),
    ])


def _unpacked(raw: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) of one block."""
    n, base = np.frombuffer(raw, np.int64, 2).tolist()
    head = bytes(raw[16:24])
    at, parts = 24, []
    for kind in (head[:4], head[4:]):
        parts.append(np.frombuffer(raw, kind.decode().strip(), n, at))
        at += parts[-1].nbytes
    ids, runs = (parts[0].astype(U64) + np.int64(base).astype(U64)).view(np.int64), parts[1].astype(np.int64)
    total = int(runs.sum())
    high, low = np.frombuffer(raw, np.uint32, total, at), np.frombuffer(raw, np.uint16, total, at + 4 * total)
    return np.repeat(ids, runs), high.astype(U64) << U64(16) | low


def _shared(table: pa.Table) -> pa.Table:
    """(g, doc_id, w) of one bucket: the documents of every signature that several share. g hashes the documents, so
    signatures of the same documents are one group, and w counts them."""
    docs, signed = zip(*(_unpacked(block.as_buffer()) for block in table.column("block")), strict=True)
    docs, signed = np.concatenate(docs), np.concatenate(signed)
    order = np.argsort(signed, kind="stable")
    docs, signed = docs[order], signed[order]
    group = np.cumsum(np.concatenate([[True], signed[1:] != signed[:-1]])) - 1
    del order, signed
    several = np.bincount(group)[group] > 1
    docs, group = docs[several], np.unique(group[several], return_inverse=True)[1]
    sums = _sums(group, mix(docs.view(U64) + U64(1)), int(group.max(initial=-1)) + 1)
    _, one, many = np.unique(sums, return_index=True, return_counts=True)
    weight = np.zeros(len(sums), np.int64)
    weight[one] = many
    rows = weight[group] > 0
    out = pa.table({"g": sums[group[rows]].view(np.int64), "doc_id": docs[rows], "w": weight[group[rows]]})
    del docs, group, rows
    release()
    return out


def shared_signatures(docs: DataFrame, sets: DataFrame, n: int, threshold: int) -> DataFrame:
    """(g, doc_id, w): groups of documents with signatures in common, each group once with the number of those."""
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A set of size s has up to some 2.4 (1 - J) / (1 + J) s signatures in either instance.
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(width, int(total * 5 * (100 - threshold) / (100 + threshold)) // BUCKET)
    blocks = docs.select("doc_id", "text").mapInArrow(partial(_blocks, n=n, threshold=threshold, buckets=buckets), "bucket long, block binary")
    found = blocks.groupBy("bucket").applyInArrow(_shared, "g long, doc_id long, w long")
    return found.groupBy("g", "doc_id").agg(F.sum("w").alias("w"))


def _agreeing(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [_similar(_set(x), _set(y), threshold) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _near(df: DataFrame, width: Column | None = None) -> DataFrame:
    """``df``, broadcast if it has at most ``BROADCAST`` narrow rows, or so many of ``width`` in all; a shuffled join
    takes the others."""
    held = df.agg(F.coalesce(F.sum(F.lit(1) if width is None else width), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= BROADCAST else df


def _linked(pairs: DataFrame, docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets are at least as similar as ``threshold`` hundredths.

    Only texts that a pair names are read into sets. A set travels once per pair as ``b``; as ``a`` it travels once for
    every ``FAN`` pairs it has, so a hub's pairs are dealt over many tasks.
    """

    asked = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = docs.join(_near(asked), "doc_id", "left_semi")
    sets = materialise(map_text(texts, partial(_pack, n=n), "packed binary", ["doc_id"], size=STEP))
    fans = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan")))
    dealt = lookup(pairs, fans, ["a"], F.xxhash64("b")).withColumn("part", F.pmod(F.xxhash64("b", F.lit(1)), F.col("fan")).cast("int"))
    dealt = materialise(dealt.select("a", "b", "part"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("packed").alias("y"))
    x = sets.select(F.col("doc_id").alias("a"), F.col("packed").alias("x"))
    x = x.join(_near(fans), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan")
    rows = y.join(_near(dealt), "b").join(x, ["a", "part"])
    return rows.select("a", "b", "x", "y").mapInArrow(partial(_agreeing, threshold=threshold), "a long, b long")


def link_documents(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document that has an id.

    Documents link if the Jaccard similarity of their sets of distinct ``n``-word shingles is at least ``threshold``
    hundredths; component_id is the smallest doc_id that links reach, the document itself included. Null and empty
    texts, and those without words, have an empty set and link with nothing. doc_id must be unique; of repeated rows
    one counts. Rows with a null doc_id have no row here. Other columns are not read; an empty table gives no rows.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialise(
        map_text(docs, partial(_digests, n=n, threshold=threshold), "n_shingles long, need long, d1 long, d2 long", ["doc_id"], size=STEP).dropDuplicates(["doc_id"])
    )
    # Documents of equal sets are one class; its smallest doc_id stands for it.
    classes = sets.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = lookup(sets, classes.drop("n"), ["d1", "d2"], F.xxhash64("doc_id")).where("rep <> doc_id").select("doc_id", "rep")
    copies = materialise(copies)
    shared = lookup(shared_signatures(docs, sets, n, threshold), copies, ["doc_id"], F.xxhash64("g"))
    members = shared.groupBy("g", F.coalesce("rep", "doc_id").alias("doc")).agg(F.max("w").alias("w"))
    sizes = sets.select(F.col("doc_id").alias("doc"), "n_shingles", "need")
    members = _likely(_likely(members, sizes), sizes)
    center = members.groupBy("g").agg(F.min("doc").alias("center"))
    members = materialise(members.join(center, "g"))
    links = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    placed = _families(members, sets, threshold)
    large = materialise(placed.where((F.col("blocks") > THIN) & F.col("own")).select("doc"))
    if not large.isEmpty():
        wide = materialise(members.join(large, "doc", "left_semi"))
        stars = wide.where("doc <> center").groupBy("doc", "center").agg(F.sum("w").alias("n"))
        best = stars.groupBy("doc").agg(F.max_by("center", F.struct("n", "center")).alias("center"))
        thinned = materialise(_linked(materialise(best.select(F.col("center").alias("a"), F.col("doc").alias("b"))), docs, n, threshold))
        links = links.unionByName(thinned)
        rest = materialise(_mixed(wide, components(thinned)))
        placed = placed.where(F.col("blocks") <= THIN).unionByName(_families(rest, sets, threshold))
        # Groups that a large family shares with others, whose documents may visit it.
        shared = members.join(wide.select("g").distinct(), "g", "left_semi").join(large, "doc", "left_anti").select("g").distinct()
        placed = placed.unionByName(_families(members.join(shared, "g", "left_semi"), sets, threshold))
    links = links.unionByName(_checked(placed, docs, n, threshold))
    labels = components(links)
    out = sets.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _likely(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members that share as many signatures with all others as a link takes, in the groups that still hold several."""
    enough = members.groupBy("doc").agg(F.sum("w").alias("n")).join(sizes, "doc").where("n >= need").select("doc")
    left = materialise(members.join(enough, "doc", "left_semi"))
    several = left.groupBy("g").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("g")
    return materialise(left.join(several, "g", "left_semi"))


def _guests(apart: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """(doc, family, n_shingles): the families before its own that a document may link into.

    A document need not ask in the groups where most families meet, as long as fewer signatures than a link takes are
    left out by it; one more is asked for, so that two must be found. Families show the sizes they have in a group.
    """
    known = materialise(apart.join(sizes, "doc"))
    families = known.groupBy("g", F.col("home").alias("family")).agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    families = materialise(families)
    own = Window.partitionBy("doc")
    asking = known.join(families.groupBy("g").agg(F.count("*").alias("met")), "g")
    asking = asking.withColumn("left", F.sum("w").over(own.orderBy(F.desc("met"), "g")))
    asking = asking.withColumn("spare", F.coalesce(F.max(F.when(F.col("left") < F.col("need") - 1, F.col("left"))).over(own), F.lit(0)))
    asking = asking.where("left >= need - 1").drop("left", "met")
    fits = (F.col("n_shingles") * 100 >= F.col("least") * threshold) & (F.col("most") * 100 >= F.col("n_shingles") * threshold)
    found = asking.join(families, "g").where((F.col("family") < F.col("home")) & fits)
    # Signatures shared with a whole family bound those shared with any of it.
    found = found.groupBy("doc", "family").agg(F.sum("w").alias("n"), *[F.first(c).alias(c) for c in ("n_shingles", "need", "spare")])
    return found.where("n + spare >= need").select("doc", "family", "n_shingles")


def _families(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(doc, family, own, n_shingles, blocks): the families a document belongs to (own) or visits.

    Documents that share fewer signatures than linked ones must do neither make a family nor visit.
    """
    sizes = sets.select(F.col("doc_id").alias("doc"), "n_shingles", "need")
    stars = members.where("doc <> center").groupBy("doc", "center").agg(F.sum("w").alias("n")).join(sizes, "doc").where("n >= need")
    best = stars.groupBy("doc").agg(F.max_by("center", F.struct("n", "center")).alias("center"))
    joined = components(best.select(F.col("center").alias("a"), F.col("doc").alias("b")))
    rows = lookup(members, joined.select(F.col("node").alias("doc"), F.col("component").alias("home")), ["doc"], F.xxhash64("g"))
    rows = materialise(rows.select("g", "doc", "w", F.coalesce("home", "doc").alias("home")))
    # Only documents that share enough outside their family can visit another.
    mixed = rows.groupBy("g").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low < high").select("g")
    apart = _likely(materialise(rows.join(mixed, "g", "left_semi")), sizes)
    guests = _guests(apart, sizes, threshold).withColumn("own", F.lit(False))
    homes = rows.select("doc", F.col("home").alias("family"), F.lit(True).alias("own")).distinct()
    sized = guests.unionByName(homes.join(sizes.drop("need"), "doc"))
    need = F.greatest(F.ceil(F.sum("n_shingles") / BLOCK), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int")
    # Most families are one block; only the others are looked up.
    many = lookup(sized, sized.groupBy("family").agg(need.alias("blocks")).where("blocks > 1"), ["family"], F.xxhash64("doc"))
    return materialise(many.withColumn("blocks", F.coalesce("blocks", F.lit(1))))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the groups that several components still meet in."""
    rows = lookup(members, labels.withColumnRenamed("node", "doc"), ["doc"], F.xxhash64("g"))
    rows = rows.withColumn("component", F.coalesce("component", "doc"))
    mixed = rows.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("g")
    return members.join(mixed, "g", "left_semi")


def _checked(placed: DataFrame, docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """Edges (a, b) that join the documents of every family and its visitors as their links do."""
    # Small families share units, which then hold about a block each.
    total = placed.agg(F.sum("n_shingles")).first()[0] or 0
    shared = -1 - F.pmod(F.xxhash64("family"), F.lit(int(total) // BLOCK + 1))
    unit = F.when(F.col("blocks") == 1, shared).otherwise(F.col("family"))
    stays = placed.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct(unit.alias("unit"), "family", "own", "blocks")).alias("stays"))
    texts = docs.join(_near(materialise(stays), F.size("stays")), "doc_id")
    packed = map_text(texts, partial(_pack, n=n), "packed binary", ["doc_id", "stays"], size=STEP)
    rows = packed.select("doc_id", "packed", F.explode("stays").alias("s")).select("doc_id", "packed", "s.*")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({
        "i": F.least("block", "other"), "j": F.greatest("block", "other")
    })
    units = rows.select("unit", "i", "j", "block", "family", "own", "doc_id", "packed")
    return materialise(units.groupBy("unit", "i", "j").applyInArrow(lambda unit: _unit(unit, threshold), "a long, b long"))


def _pack(column: pa.Array, n: int) -> list[pa.Array]:
    """Sets as sorted 48-bit hashes: within a pair of sets that is enough."""
    found, sizes = shingle_sets(column, n)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    high, low = (found >> U64(32)).astype(np.uint32), (found >> U64(16)).astype(np.uint16)
    return [pa.array([high[a:b].tobytes() + low[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())]


def _set(packed: pa.Scalar) -> np.ndarray:
    raw = packed.as_buffer()
    n = raw.size // 6
    return np.frombuffer(raw, np.uint32, n).astype(U64) << U64(16) | np.frombuffer(raw, np.uint16, n, 4 * n)


def _similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if small * 100 < large * threshold:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * 100 >= (small + large - both) * threshold


def _unit(table: pa.Table, threshold: int) -> pa.Table:
    """Links of one unit as edges to the first document of each component found in a family and its visitors."""
    ids, block = table.column("doc_id").to_numpy(), table.column("block").to_numpy()
    family, own = table.column("family").to_numpy(), table.column("own").to_numpy()
    across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    sets = [_set(x) for x in table.column("packed")]
    parent = list(range(len(ids)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    order = np.lexsort((ids, ~own, family))
    for part in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
        members = part.tolist()
        for at, y in enumerate(members):
            for x in members[:at]:
                # Members come first, so two visitors only follow.
                if not own[x]:
                    break
                if (across and block[x] == block[y]) or root(x) == root(y):
                    continue
                if _similar(sets[x], sets[y], threshold):
                    parent[root(y)] = root(x)
    roots = [root(k) for k in range(len(ids))]
    some = [k for k in range(len(ids)) if roots[k] != k]
    return pa.table({"a": ids[[roots[k] for k in some]].astype(np.int64), "b": ids[some].astype(np.int64)})
