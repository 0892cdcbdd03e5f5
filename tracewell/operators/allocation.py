"""Free space read from the images themselves: allocation tables and bitmaps of every volume, less what holds structures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.bits import uint
from tracewell.operators.extents import HALF_OPEN, merge_extents, subtract_extents
from tracewell.operators.freespace import bitmap_to_ranges, free_space
from tracewell.operators.paths import EXFAT_END, FAT_END, follow_chain
from tracewell.operators.volumes import TABLE_PIECE, VOLUME, block_groups, cluster_slots, fat_geometry, list_volumes, read_links
from tracewell.plans.joins import materialise
from tracewell.sources.images import read_ranges
from tracewell.sources.records import apply_fixup, decode_runs, file_attributes

_RANGE = [*VOLUME, "start", "end"]


def _clusters(rows: DataFrame, tables: DataFrame, first: Column, count: Column) -> DataFrame:
    """Half-open byte ranges of runs of clusters, clipped to the heap."""
    known = rows.join(tables.select(*VOLUME, "heap", "cluster_size", "n_clusters"), VOLUME)
    stop = F.least(first + count, F.col("n_clusters") + 2)
    place = lambda c: F.col("heap") + (c - 2) * F.col("cluster_size")
    return known.where((first >= 2) & (stop > first)).select(*VOLUME, place(first).alias("start"), place(stop).alias("end"))


def _words(bits: DataFrame) -> DataFrame:
    """Bitmaps ``(image_id, part_no, path, offset, length, first_unit, n_units, unit_bytes, base)`` in pieces, as read."""
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(TABLE_PIECE).cast("long")))
    cut = bits.where("length > 0 AND n_units > 0").withColumn("at", begin)
    pieces = cut.withColumns({
        "offset": F.col("offset") + F.col("at"), "length": F.least(F.col("length") - F.col("at"), F.lit(TABLE_PIECE).cast("long")),
        "first_unit": F.col("first_unit") + F.col("at") * 8, "n_units": F.col("n_units") - F.col("at") * 8,
    })
    read = read_ranges(pieces.where("n_units > 0"), "bits")
    return read.where(F.octet_length("bits") > 0).withColumn("n_units", F.least("n_units", F.octet_length("bits") * 8))


def fat_free(tables: DataFrame, links: DataFrame) -> DataFrame:
    """Free ranges of FAT32 volumes: clusters whose entry is exactly 0, less the chain of the root directory."""
    own = tables.where("fs_type = 'fat32'")
    heap = _clusters(own.select(*VOLUME), own, F.lit(2).cast("long"), F.lit(1 << 32))
    used = _clusters(links.join(own.select(*VOLUME), VOLUME, "left_semi"), own, F.col("cluster"), F.lit(1))
    root = follow_chain(links, own.select(*VOLUME, F.col("root_cluster").alias("head")), keys=VOLUME, end_mark=FAT_END)
    return subtract_extents(heap, used.unionByName(_clusters(root, own, F.col("cluster"), F.lit(1))), VOLUME, HALF_OPEN)


def exfat_free(tables: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ranges, mapped)`` of exFAT volumes: clear bits of the allocation bitmap that the root directory names, less the
    bitmap, the case table and the root directory, which need not be marked; and the volumes that have a bitmap.

    Clusters beyond the bitmap are unknown, hence not free.
    """
    own = tables.where("fs_type = 'exfat'")
    own_links = links.join(own.select(*VOLUME), VOLUME, "left_semi")
    root = materialise(follow_chain(own_links, own.select(*VOLUME, F.col("root_cluster").alias("head")), keys=VOLUME, end_mark=EXFAT_END))
    slots = cluster_slots(own)(root.withColumnRenamed("head", "dir_id"))
    named = slots.select(
        *VOLUME, "slot", uint(F.col("raw"), 0, 1).alias("kind"), uint(F.col("raw"), 20, 4).alias("first"), uint(F.col("raw"), 24, 8).try_cast("long").alias("bytes")
    ).where("kind IN (129, 130) AND first >= 2 AND bytes > 0")
    named = materialise(named.join(own.select(*VOLUME, "path", "size", "heap", "cluster_size", "n_clusters"), VOLUME).where("first < n_clusters + 2"))
    bitmap = named.where("kind = 129").groupBy(*VOLUME).agg(F.min_by(F.struct(*[c for c in named.columns if c not in VOLUME]), "slot").alias("b")).select(*VOLUME, "b.*")
    offset = F.col("heap") + (F.col("first") - 2) * F.col("cluster_size")
    held = F.least(F.col("bytes"), F.ceil(F.col("n_clusters") / 8), F.col("size") - offset)
    bits = bitmap.select(
        *VOLUME, "path", offset.alias("offset"), held.alias("length"), F.lit(0).cast("long").alias("first_unit"), F.col("n_clusters").alias("n_units"),
        F.col("cluster_size").alias("unit_bytes"), F.col("heap").alias("base"),
    )
    words = materialise(_words(bits))
    clear = bitmap_to_ranges(words).select(*_RANGE)
    parts = named.select(*VOLUME, "first", F.ceil(F.col("bytes") / F.col("cluster_size")).alias("n"))
    fixed = _clusters(parts, own, F.col("first"), F.col("n"))
    structural = fixed.unionByName(_clusters(root, own, F.col("cluster"), F.lit(1)))
    return subtract_extents(clear, structural, VOLUME, HALF_OPEN), words.select(*VOLUME).distinct()


def ext4_free(volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ranges, mapped)`` of ext4 volumes: clear bits of every group's block bitmap, and the volumes all of whose groups
    have a readable one."""
    groups = materialise(block_groups(volumes).where("n_blocks > 0"))
    sound = F.col("bitmap_block").between(1, F.col("blocks") - 1)
    bits = groups.where(sound).select(
        *VOLUME, "path", (F.col("base") + F.col("bitmap_block") * F.col("block_size")).alias("offset"), F.col("block_size").alias("length"),
        F.col("first_block").alias("first_unit"), F.col("n_blocks").alias("n_units"), F.col("block_size").alias("unit_bytes"), "base",
    )
    words = materialise(_words(bits).withColumn("whole", F.octet_length("bits") * 8 >= F.col("n_units")))
    read = words.where("whole").groupBy(*VOLUME).agg(F.sum("n_units").alias("read"))
    # What the groups must cover is known from the superblock, not from the descriptors that could be read.
    asked = groups.groupBy(*VOLUME).agg(F.max(F.col("blocks") - F.col("first_data")).alias("asked"))
    return bitmap_to_ranges(words).select(*_RANGE), asked.join(read, VOLUME).where("read = asked").select(*VOLUME)


def ntfs_geometry(volumes: DataFrame) -> DataFrame:
    """Of NTFS volumes: cluster size, where the file table begins, the size of its records and the number of clusters."""
    field = lambda at, width: uint(F.col("head"), at, width)
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(32)).cast("int"))
    # Values from 128 on are negative powers of two.
    per = F.when(field(13, 1) < 128, field(13, 1)).otherwise(power(256 - field(13, 1)))
    known = volumes.where("fs_type = 'ntfs'").withColumn("cluster_size", field(11, 2) * per).where("cluster_size > 0")
    record = F.when(field(64, 1) < 128, field(64, 1) * F.col("cluster_size")).otherwise(power(256 - field(64, 1)))
    return known.withColumns({
        "table_offset": F.col("start") + (field(48, 8).try_cast("long") * F.col("cluster_size")), "record_size": record,
        "n_clusters": F.floor(field(40, 8).try_cast("long") * field(11, 2) / F.col("cluster_size")).cast("long"),
    }).where("record_size BETWEEN 512 AND 65536 AND n_clusters > 0 AND table_offset < size").drop("head")


def _data_runs(records: DataFrame) -> DataFrame:
    """``runs`` (at, lcn, len, in clusters) and ``real_size`` of the unnamed stream of corrected records in ``raw``."""
    fixed = records.withColumn("fx", apply_fixup("raw")).where(F.col("fx.verified") & (F.hex(F.col("raw").substr(1, 4)) == "46494C45"))
    data = F.filter(file_attributes(F.col("fx.bytes")), lambda a: (a["type"] == 0x80) & a["non_resident"] & (a["name"] == ""))
    named = fixed.withColumn("data", F.get(data, F.lit(0))).where("data IS NOT NULL").withColumn("plain", decode_runs("data.value"))
    start = F.struct(F.array().cast("array<struct<at:bigint,lcn:bigint,len:bigint>>").alias("out"), F.lit(0).cast("long").alias("at"))
    placed = F.aggregate("plain", start, lambda acc, r: F.struct(
        F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), r["lcn"].cast("long").alias("lcn"), r["len"].cast("long").alias("len")))).alias("out"),
        (acc["at"] + r["len"]).cast("long").alias("at"),
    ), lambda acc: acc["out"])
    return named.withColumns({"runs": placed, "real_size": F.col("data.real_size")}).drop("raw", "fx", "data", "plain")


def ntfs_free(volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ranges, mapped)`` of NTFS volumes: clear bits of the stream of file record 6, found through the runs of record 0,
    so that a file table in pieces is no hindrance; and the volumes where that could be read."""
    known = ntfs_geometry(volumes)
    first = read_ranges(known.withColumns({"offset": F.col("table_offset"), "length": F.col("record_size")}), "raw")
    tables = _data_runs(first)
    want = 6 * F.col("record_size")
    run = F.get(F.filter("runs", lambda r: (r["lcn"] >= 0) & (r["at"] * F.col("cluster_size") <= want) & ((r["at"] + r["len"]) * F.col("cluster_size") > want)), F.lit(0))
    at = F.col("start") + (run["lcn"] - run["at"]) * F.col("cluster_size") + want
    placed = tables.withColumn("offset", F.coalesce(at, F.col("table_offset") + want)).withColumn("length", F.col("record_size"))
    bitmaps = materialise(_data_runs(read_ranges(placed.drop("runs", "real_size"), "raw")))
    rows = bitmaps.select("*", F.inline("runs")).where("lcn >= 0")
    bits = rows.select(
        *VOLUME, "path", (F.col("start") + F.col("lcn") * F.col("cluster_size")).alias("offset"),
        F.least(F.col("len") * F.col("cluster_size"), F.col("real_size") - F.col("at") * F.col("cluster_size")).alias("length"),
        (F.col("at") * F.col("cluster_size") * 8).alias("first_unit"), (F.col("n_clusters") - F.col("at") * F.col("cluster_size") * 8).alias("n_units"),
        F.col("cluster_size").alias("unit_bytes"), F.col("start").alias("base"),
    )
    words = materialise(_words(bits))
    return bitmap_to_ranges(words).select(*_RANGE), words.select(*VOLUME).distinct()


def image_free_space(images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(map, notes, ranges)`` of ``images``: what of each image may be searched as free, why, and free ranges by volume.

    Every volume's own allocation structures are read: FAT entries, block bitmaps, the exFAT bitmap and NTFS's. A volume
    of another kind, or without a map that can be trusted, makes the map of its image unreliable, as ``free_space`` says.
    """
    volumes = materialise(list_volumes(images))
    tables = materialise(fat_geometry(volumes))
    links = materialise(read_links(tables))
    whole = lambda ranges, mapped, source: (ranges.withColumn("source", F.lit(source)), mapped)
    found = [
        whole(fat_free(tables, links), tables.where("fs_type = 'fat32'").select(*VOLUME), "FAT32 allocation table"),
        whole(*exfat_free(tables, links), "exFAT allocation bitmap + structural metadata"),
        whole(*ext4_free(volumes), "ext4 block bitmap"),
        whole(*ntfs_free(volumes), "ntfs $Bitmap"),
    ]
    ranges, mapped = (materialise(reduce(DataFrame.unionByName, part)) for part in zip(*found, strict=True))
    parts = volumes.select(*VOLUME, "fs_type", "start", F.col("size").alias("end")).join(mapped.withColumn("reliable", F.lit(True)), VOLUME, "left")
    parts = parts.withColumn("reliable", F.coalesce("reliable", F.lit(False)))
    return *free_space(ranges, parts), merge_extents(ranges, [*VOLUME, "source"], HALF_OPEN)
