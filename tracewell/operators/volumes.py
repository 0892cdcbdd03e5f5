"""File systems of images: geometry, directory trees, and the deleted files that directories and inode tables still name."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.bits import uint
from tracewell.operators.directory import decode_slots, live_slots, pair_long_names
from tracewell.operators.paths import EXFAT_END, FAT_END, follow_chain
from tracewell.plans.joins import materialise
from tracewell.sources.images import by_bytes, image_opener, partition_table, read_ranges
from tracewell.sources.records import exfat_entries, extent_entries, read_fixed_records

VOLUME = ["image_id", "part_no"]
#: Bytes of a volume's head that hold its boot sector or superblock.
HEAD = 2048
#: Bytes of an allocation table that one row of work covers.
TABLE_PIECE = 4 << 20


def list_volumes(images: DataFrame) -> DataFrame:
    """``(image_id, part_no, fs_type, path, size, start, head)``: the file systems of images with their first bytes."""
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("start")) - 1
    parts = partition_table(images).withColumn("part_no", order).join(images.select("image_id", "path", "size"), "image_id")
    heads = read_ranges(parts.withColumns({"offset": F.col("start"), "length": F.least(F.lit(HEAD).cast("long"), F.col("size") - F.col("start"))}), "head")
    return heads.drop("offset", "length")


def fat_geometry(volumes: DataFrame) -> DataFrame:
    """Of FAT32 and exFAT volumes: cluster size, ``heap`` (offset of cluster 2), table, root and number of clusters.

    Volumes whose boot sector contradicts itself are left out.
    """
    head = F.col("head")
    field = lambda at, width: uint(head, at, width)
    exfat = F.col("fs_type") == "exfat"
    power = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.least(field(at, 1), F.lit(32)).cast("int"))
    sector = F.when(exfat, power(108)).otherwise(field(11, 2))
    cluster = F.when(exfat, power(108) * power(109)).otherwise(field(11, 2) * field(13, 1))
    table = F.when(exfat, field(80, 4)).otherwise(field(14, 2)) * sector
    table_bytes = F.when(exfat, field(84, 4)).otherwise(field(36, 4)) * sector
    heap = F.when(exfat, field(88, 4)).otherwise(field(14, 2) + field(16, 1) * field(36, 4)) * sector
    sectors = F.when(field(32, 4) > 0, field(32, 4)).otherwise(field(19, 2))
    held = F.floor((sectors * sector - heap) / F.when(cluster > 0, cluster))
    named = volumes.where(F.col("fs_type").isin("fat32", "exfat")).withColumns({
        "sector_size": sector, "cluster_size": cluster, "fat_offset": F.col("start") + table, "heap": F.col("start") + heap,
        "root_cluster": F.when(exfat, field(96, 4)).otherwise(field(44, 4)),
        "n_clusters": F.least(F.when(exfat, field(92, 4)).otherwise(held), F.floor(table_bytes / 4) - 2).cast("long"),
    })
    sound = F.col("sector_size").isin(512, 1024, 2048, 4096) & (F.col("cluster_size") > 0) & (F.col("n_clusters") > 0)
    return named.where(sound & (exfat | (field(17, 2) == 0))).drop("head")


def read_links(volumes: DataFrame) -> DataFrame:
    """``(image_id, part_no, cluster, next_cluster)`` of every entry of the allocation tables that is not zero."""
    begin = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n_clusters") + 1) * 4, F.lit(TABLE_PIECE).cast("long")))
    rows = volumes.select(*VOLUME, "path", "fs_type", "fat_offset", "n_clusters", begin.alias("at"))
    rows = rows.withColumn("length", F.least(F.lit(TABLE_PIECE).cast("long"), (F.col("n_clusters") + 2) * 4 - F.col("at")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = image_opener()
        for batch in batches:
            for row in batch.to_pylist():
                data = opened(row["path"]).read(row["fat_offset"] + row["at"], row["length"])
                links = np.frombuffer(data[: len(data) // 4 * 4], "<u4").astype(np.int64)
                if row["fs_type"] != "exfat":
                    links = links & 0x0FFFFFFF
                used = np.flatnonzero(links)
                used = used[used + row["at"] // 4 >= 2]
                columns = [pa.array([row[c]] * len(used), t) for c, t in zip(VOLUME, (pa.string(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(used + row["at"] // 4), pa.array(links[used])], [*VOLUME, "cluster", "next_cluster"])

    return by_bytes(rows, F.col("length"), *VOLUME, "at").mapInArrow(read, "image_id string, part_no int, cluster long, next_cluster long")


def cluster_slots(volumes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A reader of directory clusters ``(image_id, part_no, dir_id, pos, cluster)`` as 32-byte slots, numbered along the chain."""
    known = volumes.select(*VOLUME, "path", "cluster_size", "heap")

    def read(clusters: DataFrame) -> DataFrame:
        placed = clusters.join(known, VOLUME).withColumns({
            "offset": F.col("heap") + (F.col("cluster") - 2) * F.col("cluster_size"), "length": F.col("cluster_size")
        })
        data = read_ranges(placed.where("offset >= 0"), "bytes").where(F.octet_length("bytes") >= 32)
        cut = F.transform(F.sequence(F.lit(0), F.expr("octet_length(bytes) div 32 - 1")), lambda i: F.col("bytes").substr(i * 32 + 1, F.lit(32)))
        rows = data.select(*VOLUME, "dir_id", "pos", "offset", "cluster_size", F.posexplode(cut).alias("i", "raw"))
        return rows.select(
            *VOLUME, "dir_id", (F.col("pos") * F.expr("cluster_size div 32") + F.col("i")).alias("slot"), (F.col("offset") + F.col("i") * 32).alias("record_num"), "raw"
        )

    return read


def fat_directory(slots: DataFrame) -> DataFrame:
    """Entries of FAT directories, in use or deleted, by their long names where fragments of one fit."""
    keys = [*VOLUME, "dir_id"]
    places = slots.select(*keys, "slot", "record_num")
    named = pair_long_names(decode_slots(slots.drop("record_num")), keys).where(uint(F.col("raw"), 0, 1) != 0x2E)
    raw = F.col("raw")
    return named.join(places, [*keys, "slot"]).select(
        *keys, "slot", "record_num", "name", "is_deleted", (F.col("attributes").bitwiseAND(F.lit(0x10)) != 0).alias("is_directory"),
        (uint(raw, 20, 2) * 65536 + uint(raw, 26, 2)).alias("first_cluster"), uint(raw, 28, 4).alias("size_bytes"), F.col("is_deleted").alias("contiguous"),
        F.when(F.col("long_name").isNotNull(), F.lit("long name")).otherwise(F.lit("8.3 name only")).alias("name_source"),
        F.when(F.col("long_name").isNotNull(), F.col("verification")).otherwise(F.lit("none")).alias("name_verification"),
    )


def exfat_directory(slots: DataFrame) -> DataFrame:
    """Entries of exFAT directories, in use or deleted; nothing ties a deleted name to its entry but its place."""
    keys = [*VOLUME, "dir_id"]
    live = live_slots(slots.withColumn("first_byte", uint(F.col("raw"), 0, 1).cast("int")), keys)
    return exfat_entries(live, keys).join(live.select(*keys, "slot", "record_num"), [*keys, "slot"]).select(
        *keys, "slot", "record_num", "name", "is_deleted", "is_directory", "first_cluster", F.col("data_length").alias("size_bytes"),
        (F.col("no_fat_chain") | F.col("is_deleted")).alias("contiguous"), F.lit("deleted-directory-entry").alias("name_source"), F.lit("none").alias("name_verification"),
    )


def walk_directories(
    roots: DataFrame,
    links: DataFrame,
    read: Callable[[DataFrame], DataFrame],
    decode: Callable[[DataFrame], DataFrame],
    opening: Callable[[Column], Column],
    end_mark: int = FAT_END,
    cluster_size: DataFrame | None = None,
) -> DataFrame:
    """Every entry of the directory trees below ``roots`` ``(image_id, part_no, dir_id)``, with its ``path``.

    A round reads one level of all trees: the chains of its directories are followed through ``links``, ``read`` gives
    their slots, ``decode`` the entries, and directories not met before are the next level. So rounds follow the depth of
    the deepest tree. A deleted directory has lost its chain: its first cluster is read, and counts only if its first
    slot is one that a directory opens with (``opening``). One that lies in one piece (``contiguous``) has as many
    clusters as its size asks for, if ``cluster_size`` (image_id, part_no, cluster_size) is given. A directory met
    twice, or a loop, is read once, by the first path in order.
    """
    keys = [*VOLUME, "dir_id"]
    level = materialise(roots.select(*keys, F.lit("").alias("path"), F.lit(False).alias("dead"), F.lit(None).cast("long").alias("n_clusters")))
    seen, found = level.select(*keys), []
    while True:
        chained = follow_chain(links, level.where("n_clusters IS NULL").select(*VOLUME, F.col("dir_id").alias("head")), keys=VOLUME, end_mark=end_mark)
        pieces = level.where("n_clusters IS NOT NULL").select(
            *keys, F.posexplode(F.sequence(F.col("dir_id"), F.col("dir_id") + F.col("n_clusters") - 1)).alias("pos", "cluster")
        )
        clusters = chained.withColumnRenamed("head", "dir_id").select(*keys, "pos", "cluster").unionByName(pieces.withColumn("pos", F.col("pos").cast("long")))
        slots = read(clusters)
        if not level.where("dead").isEmpty():
            slots = materialise(slots)
            opened = slots.where((F.col("slot") == 0) & opening(F.col("raw"))).select(*keys)
            trusted = level.where("NOT dead").select(*keys).unionByName(level.where("dead").select(*keys).join(opened, keys, "left_semi"))
            slots = slots.join(trusted, keys, "left_semi")
        entries = decode(slots).join(level.select(*keys, F.col("path").alias("__dir")), keys)
        full = F.when(F.col("__dir") == "", F.col("name")).otherwise(F.concat_ws("\\", "__dir", "name"))
        entries = materialise(entries.withColumn("path", full).drop("__dir"))
        found.append(entries)
        below = entries.where("is_directory AND first_cluster >= 2")
        if cluster_size is None:
            below = below.withColumn("__need", F.lit(1).cast("long"))
        else:
            below = below.join(cluster_size, VOLUME).withColumn("__need", F.greatest(F.lit(1), F.ceil(F.col("size_bytes") / F.col("cluster_size"))))
        one = F.when(F.col("is_deleted"), F.lit(1).cast("long")).when(F.col("contiguous"), F.col("__need"))
        nxt = below.select(*VOLUME, F.col("first_cluster").alias("dir_id"), "path", F.col("is_deleted").alias("dead"), one.alias("n_clusters"))
        # A directory in use wins over a deleted entry that names the same cluster.
        nxt = nxt.groupBy(*keys).agg(F.min(F.struct("dead", "path", "n_clusters")).alias("d")).select(*keys, "d.path", "d.dead", "d.n_clusters")
        level = materialise(nxt.join(seen, keys, "left_anti"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        seen = materialise(seen.unionByName(level.select(*keys)))


def _contiguous(entries: DataFrame, volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(files, spans)`` of deleted entries, each assumed to lie in one piece from its first cluster on."""
    dead = entries.where("is_deleted AND NOT is_directory AND first_cluster >= 2 AND size_bytes > 0")
    placed = dead.join(volumes.select(*VOLUME, "fs_type", "size", "cluster_size", "heap"), VOLUME)
    placed = placed.withColumn("offset", F.col("heap") + (F.col("first_cluster") - 2) * F.col("cluster_size"))
    inside = placed.where(F.col("offset") + F.col("size_bytes") <= F.col("size"))
    files = inside.select(
        "image_id", "part_no", "fs_type", "record_num", "name", "path", "size_bytes", F.lit(None).cast("timestamp").alias("mft_changed"), "name_source",
        "name_verification", F.lit(1).alias("fragment_count"), F.col("offset").alias("first_data_offset"),
    )
    spans = inside.select(
        "image_id", "record_num", F.lit(0).cast("long").alias("file_offset"), F.col("size_bytes").alias("length"), F.lit(False).alias("is_sparse"), "offset"
    )
    return files, spans


def block_groups(volumes: DataFrame) -> DataFrame:
    """Block groups of ext4 volumes: geometry, ``bitmap_block`` and ``table_block``; ``first_block`` and ``n_blocks`` are the group's own."""
    sb = lambda at, width: uint(F.col("head"), 1024 + at, width)
    wide = (sb(96, 4).bitwiseAND(F.lit(0x80).cast("long")) != 0) & sb(254, 2).isin(32, 64)
    known = volumes.where("fs_type = 'ext4'").where((sb(24, 4) <= 6) & (sb(32, 4) > 0) & (sb(40, 4) > 0)).withColumns({
        "block_size": F.call_function("shiftleft", F.lit(1024).cast("long"), F.least(sb(24, 4), F.lit(6)).cast("int")), "per_group": sb(40, 4),
        "inode_size": F.when(sb(88, 2) > 0, sb(88, 2)).otherwise(128), "desc_size": F.when(wide, sb(254, 2)).otherwise(32),
        "groups": F.ceil((sb(4, 4) - sb(20, 4)) / sb(32, 4)), "table": sb(20, 4) + 1, "first_data": sb(20, 4), "blocks": sb(4, 4), "group_blocks": sb(32, 4),
    }).where("inode_size >= 128")
    keep = [*VOLUME, "base", "block_size", "per_group", "inode_size", "desc_size", "first_data", "blocks", "group_blocks"]
    begin = F.col("start") + F.col("table") * F.col("block_size")
    extents = known.withColumn("base", F.col("start")).select(
        *keep, "path", begin.alias("start"), F.least(begin + F.col("groups") * F.col("desc_size"), F.col("size")).alias("end")
    )
    paths = known.select(*VOLUME, "path", "size")
    place = lambda low, high, size: uint(F.col("raw"), low, 4) + (uint(F.col("raw"), high, 4) * F.lit(1 << 32) if size == 64 else 0)
    descriptors = [
        read_fixed_records(extents.where(F.col("desc_size") == size), size, keep[1:]).withColumns(
            {"bitmap_block": place(0, 32, size), "table_block": place(8, 40, size)}
        )
        for size in (32, 64)
    ]
    rows = reduce(DataFrame.unionByName, [d.drop("raw", "offset") for d in descriptors]).withColumnRenamed("record_no", "group")
    rows = rows.withColumn("first_block", F.col("first_data") + F.col("group") * F.col("group_blocks"))
    return rows.withColumn("n_blocks", F.least(F.col("group_blocks"), F.col("blocks") - F.col("first_block"))).join(paths, VOLUME)


def _inode_tables(volumes: DataFrame) -> DataFrame:
    """``(image_id, part_no, path, block_size, group, inode_size, per_group, start, end)`` of ext4 inode tables."""
    rows = block_groups(volumes).where("table_block > 0")
    first = F.col("base") + F.col("table_block") * F.col("block_size")
    return rows.select(
        *VOLUME, "path", "base", "block_size", "group", "inode_size", "per_group", first.alias("start"),
        F.least(first + F.col("per_group") * F.col("inode_size"), F.col("size")).alias("end"),
    )


def deleted_inode_extents(volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(inodes, extents)`` of deleted regular files of ext4 volumes: their fields, and the leaves of their extent trees.

    Trees are read level by level, all files at once; a tree has at most five levels.
    """
    tables = materialise(_inode_tables(volumes))
    sizes = [r[0] for r in tables.select("inode_size").distinct().collect()]
    keep = ["part_no", "base", "block_size", "group", "per_group"]
    tables_of = [read_fixed_records(tables.where(F.col("inode_size") == size), size, keep) for size in sizes]
    if not tables_of:
        tables_of = [read_fixed_records(tables, 128, keep)]
    raw = F.col("raw")
    number = F.col("group") * F.col("per_group") + F.col("record_no") + 1
    inodes = reduce(DataFrame.unionByName, tables_of).withColumns({
        "inode": number, "mode": uint(raw, 0, 2), "dtime": uint(raw, 20, 4), "links": uint(raw, 26, 2), "size_bytes": uint(raw, 4, 4) + uint(raw, 108, 4) * F.lit(1 << 32)
    })
    regular = F.col("mode").bitwiseAND(F.lit(0xF000).cast("long")) == 0x8000
    dead = materialise(
        inodes.where(regular & (F.col("dtime") > 0) & (F.col("links") == 0) & (F.col("size_bytes") > 0) & (F.col("inode") >= 11)).select(
            *VOLUME, "base", "block_size", F.col("offset").alias("record_num"), "inode", "dtime", "size_bytes", raw.substr(41, 60).alias("node")
        )
    )
    owner = [*VOLUME, "record_num"]
    nodes, leaves = dead.select(*owner, "base", "block_size", "node"), []
    paths = volumes.select(*VOLUME, "path", "size")
    for _ in range(6):
        entries = materialise(nodes.select(*owner, "base", "block_size", F.inline(extent_entries(F.col("node")))))
        leaves.append(entries.where("depth = 0 AND count > 0").drop("depth"))
        below = entries.where("depth > 0 AND block > 0")
        if below.isEmpty():
            break
        placed = below.join(paths, VOLUME).withColumns({"offset": F.col("base") + F.col("block") * F.col("block_size"), "length": F.col("block_size")})
        nodes = read_ranges(placed.where(F.col("offset") < F.col("size")), "node").select(*owner, "base", "block_size", "node")
    return dead.drop("node"), reduce(DataFrame.unionByName, leaves)


def _inode_files(volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    inodes, extents = deleted_inode_extents(volumes)
    sized = extents.join(inodes.select(*VOLUME, "record_num", "size_bytes"), [*VOLUME, "record_num"])
    at = F.col("logical") * F.col("block_size")
    length = F.least(F.col("count") * F.col("block_size"), F.col("size_bytes") - at)
    spans = materialise(
        sized.withColumns({"file_offset": at, "length": length}).where("length > 0").select(
            "image_id", "part_no", "record_num", "file_offset", "length", F.col("unwritten").alias("is_sparse"), (F.col("base") + F.col("block") * F.col("block_size")).alias("offset")
        )
    )
    held = spans.groupBy(*VOLUME, "record_num").agg(
        F.count("*").cast("int").alias("fragment_count"), F.min_by("offset", F.when(~F.col("is_sparse"), F.col("file_offset"))).alias("first_data_offset")
    )
    name = F.concat(F.lit("inode_"), F.col("inode").cast("string"))
    files = inodes.join(held, [*VOLUME, "record_num"]).select(
        "image_id", "part_no", F.lit("ext4").alias("fs_type"), "record_num", name.alias("name"), name.alias("path"), "size_bytes",
        F.timestamp_seconds("dtime").alias("mft_changed"), F.lit("inode number only").alias("name_source"), F.lit("none").alias("name_verification"),
        "fragment_count", "first_data_offset",
    )
    return files, spans.drop("part_no")


def recover_volumes(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(files, spans)`` of the deleted files on every FAT32, exFAT and ext4 volume of ``images``.

    ``structure_payloads`` reads them. ``record_num`` is where the entry or inode lies on the medium. A deleted FAT or
    exFAT entry has lost its chain, so its file is assumed to lie in one piece; those that would reach beyond the image
    are left out. Inodes keep their extents. Files are whole, whatever their size; images without such a volume give no
    rows.
    """
    volumes = materialise(list_volumes(images))
    tables = materialise(fat_geometry(volumes))
    links = materialise(read_links(tables))
    sizes = tables.select(*VOLUME, "cluster_size")
    kinds: Sequence[tuple] = (
        ("fat32", fat_directory, lambda raw: uint(raw, 0, 1) == 0x2E, FAT_END),
        ("exfat", exfat_directory, lambda raw: uint(raw, 0, 1).bitwiseAND(F.lit(0x7F).cast("long")) == 0x05, EXFAT_END),
    )
    found = []
    for kind, decode, opening, end_mark in kinds:
        own = tables.where(F.col("fs_type") == kind)
        own_links = links.join(own.select(*VOLUME), VOLUME, "left_semi")
        roots = own.select(*VOLUME, F.col("root_cluster").alias("dir_id"))
        found.append(_contiguous(walk_directories(roots, own_links, cluster_slots(own), decode, opening, end_mark, sizes), own))
    found.append(_inode_files(volumes))
    files, spans = (reduce(DataFrame.unionByName, part) for part in zip(*found, strict=True))
    more = {"resident_data": F.lit(None).cast("binary"), "truncated": F.lit(False)}
    return files.withColumns(more), spans
