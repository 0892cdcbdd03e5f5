"""Raw images as tables of windows, read where they lie.

Image bytes never pass through the driver. A job lists windows as rows, prunes them as rows, and the
task that needs a window opens the image and seeks to it, so only what a job derives from the bytes
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracewell.session import shuffle_width

BLOCK = 8 << 20
OVERLAP = 4 << 10
#: Bytes one read task covers; 100 TB in 256 MiB pieces is some 400 000 tasks.
PARTITION = 256 << 20
#: Bytes of ranges handed over at once.
BATCH = 64 << 20

BLOCK_SCHEMA = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("block_no", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("bytes", T.BinaryType()),
        T.StructField("tail", T.BinaryType()),
    ]
)


class ImageFile:
    """Positioned reads from one image on any file system Arrow can open."""

    def __init__(self, path: str):
        if "://" in path:
            system, inner = pafs.FileSystem.from_uri(path)
        else:
            system, inner = pafs.LocalFileSystem(), path.removeprefix("file:")
        self._file = system.open_input_file(inner)
        self.size = self._file.size()

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset >= self.size or length <= 0:
            return b""
        return self._file.read_at(min(length, self.size - offset), offset)


def image_opener(keep: int = 4):
    """Open images once per task and keep the most recent few."""
    return lru_cache(maxsize=keep)(ImageFile)


def by_bytes(df: DataFrame, size: Column, *columns: str | Column, piece: int = PARTITION) -> DataFrame:
    """Deal rows by ``columns`` over as many tasks as their bytes ask for, at least one for each core of the session."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-int(total) // piece)), *columns)


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """``images(image_id, path, size)`` below a path; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("image_id"), "path", F.col("length").alias("size"))


def block_index(images: DataFrame, block: int = BLOCK, overlap: int = OVERLAP) -> DataFrame:
    """One row per window of each image, without its bytes. The body is ``length`` long, ``tail_len`` follows it."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long")))
    rows = images.where(F.col("size") > 0).select("image_id", "path", "size", starts.alias("offset"))
    length = F.least(F.lit(block).cast("long"), F.col("size") - F.col("offset"))
    rest = F.col("size") - F.col("offset") - length
    return rows.select(
        "image_id", "path", "size", F.expr(f"offset div {block}").alias("block_no"), "offset", length.cast("int").alias("length"),
        F.least(F.lit(overlap).cast("long"), rest).cast("int").alias("tail_len"),
    )


def load_blocks(index: DataFrame) -> DataFrame:
    """Bytes of the indexed windows as ``image_blocks`` rows, for jobs that need them in a column."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = image_opener()
        for batch in batches:
            for row in batch.to_pylist():
                image = opened(row["path"])
                body = image.read(row["offset"], row["length"])
                tail = image.read(row["offset"] + row["length"], row["tail_len"])
                values = [row["image_id"], row["block_no"], row["offset"], len(body), body, tail]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(values, _BLOCK_ARROW.types)], schema=_BLOCK_ARROW
                )

    return index.mapInArrow(load, BLOCK_SCHEMA)


_BLOCK_ARROW = pa.schema(
    [("image_id", pa.string()), ("block_no", pa.int64()), ("offset", pa.int64()), ("length", pa.int32()), ("bytes", pa.binary()), ("tail", pa.binary())]
)


class _BlockPiece(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class ImageBlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.block = int(options.get("block", BLOCK))
        self.overlap = int(options.get("overlap", OVERLAP))
        self.piece = max(self.block, int(options.get("partitionbytes", PARTITION)) // self.block * self.block)

    def partitions(self) -> Sequence[InputPartition]:
        if "://" in self.path:
            system, inner = pafs.FileSystem.from_uri(self.path)
        else:
            system, inner = pafs.LocalFileSystem(), self.path.removeprefix("file:")
        info = system.get_file_info(inner)
        files = [info] if info.type == pafs.FileType.File else [
            f for f in system.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.type == pafs.FileType.File
        ]
        return [_BlockPiece(f.path, at, min(at + self.piece, f.size)) for f in files for at in range(0, f.size, self.piece)]

    def read(self, partition: _BlockPiece) -> Iterator[tuple]:
        image = ImageFile(partition.path)
        for offset in range(partition.start, partition.stop, self.block):
            body = image.read(offset, self.block)
            tail = image.read(offset + len(body), self.overlap)
            yield partition.path, offset // self.block, offset, len(body), body, tail


class ImageBlocks(DataSource):
    """``spark.read.format("image_blocks")``: windows of raw images with their overlap in ``tail``."""

    @classmethod
    def name(cls) -> str:
        return "image_blocks"

    def schema(self) -> T.StructType:
        return BLOCK_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ImageBlockReader(self.options)


def read_image_blocks(spark: SparkSession, path: str, block: int = BLOCK, overlap: int = OVERLAP, partition_bytes: int = PARTITION) -> DataFrame:
    """Image windows through the registered data source."""
    spark.dataSource.register(ImageBlocks)
    reader = spark.read.format("image_blocks").option("block", block).option("overlap", overlap)
    return reader.option("partitionBytes", partition_bytes).load(path)


def read_ranges(ranges: DataFrame, out: str = "bytes", error: str | None = None) -> DataFrame:
    """Read ``length`` bytes at ``offset`` of each row's image.

    Rows are spread by image and 64 MiB region, so neighbouring reads share a task and one big image
    does not. A read cut short by the end of the medium is padded when the range itself crosses it; a
    short read inside is an error (column ``error``) and gives null bytes.
    """
    schema = T.StructType([*ranges.schema.fields, T.StructField(out, T.BinaryType()), T.StructField("__error", T.StringType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = image_opener()
        for batch in batches:
            # Frames of about BATCH bytes, whatever the number of rows; a longer range is a frame of its own.
            frame = (batch["length"].clip(lower=0).cumsum() // BATCH).to_numpy()
            for number in sorted(set(frame)):
                piece = batch[frame == number]
                data, problems = [], []
                for path, offset, length in zip(piece["path"], piece["offset"], piece["length"]):
                    blob = problem = None
                    try:
                        image = opened(path)
                        inside = max(0, min(int(length), image.size - int(offset)))
                        blob = image.read(int(offset), inside)
                        if len(blob) < inside:
                            problem, blob = f"offset {offset}: short read ({len(blob)} of {inside} bytes)", None
                        elif inside < length:
                            blob = blob.ljust(int(length), b"\0") if error is not None else blob
                    except OSError as exc:
                        problem, blob = f"offset {offset}: read failed: {exc}", None
                    data.append(blob)
                    problems.append(problem)
                yield piece.assign(**{out: data, "__error": problems})

    region = F.expr(f"offset div {64 << 20}")
    placed = by_bytes(ranges, F.col("length"), "image_id", region)
    done = placed.mapInPandas(read, schema)
    return done.withColumnRenamed("__error", error) if error is not None else done.drop("__error")


def acquisition_manifest(blocks: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """Per image: bytes, windows, and a digest over the window digests in order (parallel inside an image)."""
    from tracewell.operators.sampling import bad_sector_rollup

    leaves = blocks.select("image_id", "block_no", "length", F.sha2("bytes", 256).alias("d"))
    # 4096 leaves make one node, so no group grows with the image beyond its count of nodes.
    nodes = leaves.groupBy("image_id", F.expr("block_no div 4096").alias("node")).agg(
        F.sum(F.col("length").cast("long")).alias("n"), F.count("*").alias("windows"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "d"))), lambda s: s["d"]), ""), 256).alias("d"),
    )
    manifest = nodes.groupBy("image_id").agg(
        F.sum("n").alias("bytes"), F.sum("windows").alias("windows"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "d"))), lambda s: s["d"]), ""), 256).alias("digest_tree"),
    )
    return manifest if bad is None else manifest.join(bad_sector_rollup(bad), "image_id", "left")


def image_sha256(images: DataFrame, algorithms: Sequence[str] = ("sha256",)) -> DataFrame:
    """Whole-image digests. A digest chain is sequential, so this is one streaming read per image, images in parallel."""
    fields = [T.StructField(a, T.StringType()) for a in algorithms]
    schema = T.StructType([T.StructField("image_id", T.StringType()), *fields])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            rows = []
            for image_id, path in zip(batch["image_id"], batch["path"]):
                image = ImageFile(path)
                hashers = [hashlib.new(a) for a in algorithms]
                for at in range(0, image.size, BLOCK):
                    piece = image.read(at, BLOCK)
                    for h in hashers:
                        h.update(piece)
                rows.append([image_id, *[h.hexdigest() for h in hashers]])
            yield pd.DataFrame(rows, columns=["image_id", *algorithms])

    return images.select("image_id", "path").repartition(shuffle_width(images), "image_id").mapInPandas(digest, schema)


def partition_table(images: DataFrame) -> DataFrame:
    """``(image_id, fs_type, start)`` of each file system: bare medium, MBR entries, else GPT entries, else raw."""
    schema = "image_id string, fs_type string, start long"

    def probe(image: ImageFile, at: int) -> str | None:
        head = image.read(at, 2048)
        if len(head) < 512:
            return None
        if head[3:11] in (b"NTFS    ", b"EXFAT   "):
            return head[3:8].strip().decode().lower()
        if len(head) >= 1082 and head[1080:1082] == b"\x53\xef":
            return "ext4"
        boot = head[510:512] == b"\x55\xaa"
        return "fat32" if boot and (head[82:87] == b"FAT32" or head[54:57] == b"FAT") else None

    def u32(data: bytes, at: int) -> int:
        return int.from_bytes(data[at : at + 4], "little")

    def u64(data: bytes, at: int) -> int:
        return int.from_bytes(data[at : at + 8], "little")

    def starts(image: ImageFile) -> Iterator[int]:
        sector = image.read(0, 512)
        entries = [sector[at : at + 16] for at in (446, 462, 478, 494)] if sector[510:512] == b"\x55\xaa" else []
        plain = [u32(e, 8) * 512 for e in entries if e[4] not in (0, 0xEE) and u32(e, 8) and u32(e, 12)]
        yield from plain
        guarded = any(e[4] == 0xEE for e in entries)
        if guarded or not any(probe(image, at) for at in plain):
            header = image.read(512, 512)
            count, width = u32(header, 80), u32(header, 84)
            if header[:8] == b"EFI PART" and len(header) >= 92 and 0 < count <= 128 and 128 <= width <= 512:
                table = image.read(u64(header, 72) * 512, count * width)
                for at in range(0, len(table) - width + 1, width):
                    if table[at : at + 16] == bytes(16):
                        break
                    if u64(table, at + 32):
                        yield u64(table, at + 32) * 512

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for image_id, path in zip(batch["image_id"], batch["path"]):
                image = ImageFile(path)
                whole = probe(image, 0)
                found = [(whole, 0)] if whole else list(
                    dict.fromkeys((fs, at) for at in starts(image) if (fs := probe(image, at)))
                )
                rows += [(image_id, fs, at) for fs, at in found or [("raw", 0)]]
            yield pd.DataFrame(rows, columns=["image_id", "fs_type", "start"])

    return images.select("image_id", "path").mapInPandas(detect, schema)
