"""Images, records and directories built byte by byte."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from tests import builders as b
from tracewell.operators import directory, filetable
from tracewell.operators.budget import Policy
from tracewell.operators.carve import carve
from tracewell.operators.freespace import bitmap_to_ranges
from tracewell.operators.scan import Matcher, Pattern, Windows, count_needles, scan_blocks
from tracewell.operators.sessions import fingerprint_ranges, image_fingerprint
from tracewell.sources import images as im
from tracewell.sources import records as rec


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    rng = random.Random(5)
    data = bytearray(rng.randbytes(1_200_000))
    first = b.png(rng, 900)
    items = [
        (4096, first, "png"), (70_000, b.bmp(rng, 600), "bmp"), (200_003, b.pdf(), "pdf"), (400_001, b.zipped(1), "zip"),
        (500_000, b.zipped(2), "zip"), (655_355, b.wav(rng), "wav"), (900_000, b.png(rng, 700), "png"),
    ]
    for at, body, _ in [*items, (1_000_000, first, "png")]:
        data[at : at + len(body)] = body
    folder = tmp_path_factory.mktemp("img")
    (folder / "a.img").write_bytes(data)
    return str(folder), items, bytes(data)


@pytest.mark.parametrize("block", [1 << 16, 8 << 20])
def test_planted_files_come_back_byte_exact(spark, planted, block):
    folder, items, data = planted
    result = carve(im.list_images(spark, folder), policy=Policy(), block=block)
    got = {(r.offset, r.extension, bytes(r.payload)) for r in result.recovered.collect()}
    assert got == {(at, ext, body) for at, body, ext in items}
    totals = result.summary.first()
    assert (totals.accepted, totals.duplicates) == (7, 1)
    # The prefilter works inside the scan; only a few of the noise matches become candidates.
    assert totals.candidates < 120 < totals.prefiltered


def test_free_space_session_and_known_hashes_hold_files_back(spark, planted):
    folder, items, _ = planted
    images = im.list_images(spark, folder)
    image_id = images.first().image_id
    free = spark.createDataFrame([(image_id, 0, 450_000)], "image_id string, start long, end long")
    digest = lambda i: F.sha2(F.lit(items[i][1]), 256)
    known = spark.range(1).select(F.lit("sha256").alias("algo"), digest(1).alias("digest"))
    session = spark.range(1).select(digest(2).alias("sha256"))
    result = carve(images, free=free, known=known, session=session, block=1 << 16)
    assert {r.offset for r in result.recovered.collect()} == {items[0][0], items[3][0]}
    totals = result.summary.first()
    assert (totals.suppressed, totals.duplicates) == (1, 1)
    assert totals.allocated_bytes_skipped > 700_000


def test_scan_is_invariant_under_block_size(spark, planted):
    folder, _, data = planted
    patterns = [Pattern(0, b"\x00"), Pattern(1, b"PK\x03\x04"), Pattern(2, b"IHDR", 12), Pattern(3, b"ab")]
    counts = []
    for block in (64, 4096, 8 << 20):
        blocks = im.load_blocks(im.block_index(im.list_images(spark, folder), block, 16))
        hits = scan_blocks(blocks, patterns).groupBy("pattern").agg(F.count("*").alias("n"), F.sum("offset").alias("s"))
        counts.append({r.pattern: (r.n, r.s) for r in hits.collect()})
    assert counts[0] == counts[1] == counts[2]
    assert counts[0][0][0] == data.count(b"\0")


def test_one_pass_finds_what_a_search_for_each_pattern_finds():
    rng = random.Random(3)
    for alphabet in (b"ab\0", b"abcdefgh\0\xff", bytes(range(256))):
        for _ in range(60):
            windows = [bytes(rng.choices(alphabet, k=rng.choice([0, 1, 2, 3, 50, 200]))) for _ in range(rng.randint(1, 6))]
            bodies = [rng.randint(0, len(w)) for w in windows]
            needles = sorted({bytes(rng.choices(alphabet, k=rng.randint(1, 4))) for _ in range(6)})
            found = Windows(windows, bodies).find(Matcher([Pattern(i, n) for i, n in enumerate(needles)]))
            got = sorted((p.number, r, at) for p, rows, places in found for r, at in zip(rows.tolist(), places.tolist()))
            assert got == [
                (i, r, at) for i, n in enumerate(needles) for r, w in enumerate(windows) for at in range(bodies[r]) if w.startswith(n, at)
            ]


def test_field_rules_see_their_own_window_only(spark):
    """A transport header is judged by what its window shows, whether or not other windows are searched with it."""
    good = b"".join(b"G\x00\x00\x10" + bytes(184) for _ in range(8))
    rows = [("a", 0, 0, bytearray(good), None), ("a", 1, len(good), bytearray(b"G"), bytearray(b"\x80" + bytes(300))), ("b", 0, 0, bytearray(b"xG"), None)]
    blocks = spark.createDataFrame(rows, "image_id string, block_no long, offset long, bytes binary, tail binary").coalesce(1)
    hits = scan_blocks(blocks, [Pattern(0, b"G", rule="ts"), Pattern(1, b"x")]).collect()
    placed = {(r.image_id, r.pattern, r.offset) for r in hits if r.offset is not None}
    assert {(i, p, o) for i, p, o in placed if p == 0} == {("a", 0, 188 * i) for i in range(8)} | {("b", 0, 1)}
    assert {(i, o) for i, p, o in placed if p == 1} == {("b", 0)}
    assert [(r.image_id, r.block_no, r.prefiltered) for r in hits if r.offset is None] == [("a", 1, 1)]


def test_needles_are_counted_apart(spark):
    rows = [("a", bytearray(b"aaaa"), bytearray(b"a")), ("a", bytearray(b"aXab"), bytearray(b"ab")), ("b", bytearray(b""), None)]
    blocks = spark.createDataFrame(rows, "image_id string, bytes binary, tail binary").coalesce(1)
    got = {(r.image_id, bytes(r.needle)): r.hits for r in count_needles(blocks, [b"aa", b"ab", b"X", b"none"]).collect()}
    want = {}
    for image, body, tail in rows:
        for needle in (b"aa", b"ab", b"X"):
            n = (bytes(body) + bytes(tail or b"")[: len(needle) - 1]).count(needle)
            if n:
                want[image, needle] = want.get((image, needle), 0) + n
    assert got == want


def test_data_source_reads_the_same_blocks(spark, planted):
    folder, _, data = planted
    rows = im.read_image_blocks(spark, folder, block=1 << 16, overlap=32, partition_bytes=1 << 18).orderBy("block_no").collect()
    assert b"".join(bytes(r.bytes) for r in rows) == data
    assert all(bytes(r.tail) == data[r.offset + r.length : r.offset + r.length + 32] for r in rows)


def test_fingerprint(spark, planted):
    import hashlib

    folder, _, data = planted
    ranges = fingerprint_ranges(im.list_images(spark, folder).select("image_id", "size")).join(im.list_images(spark, folder).select("image_id", "path"), "image_id")
    got = image_fingerprint(im.read_ranges(ranges)).first().fingerprint
    edge = 1 << 20
    want = hashlib.sha256(str(len(data)).encode() + data[:edge] + data[len(data) - edge :])
    assert got == want.hexdigest()


def test_whole_image_digests(spark, planted):
    import hashlib

    folder, _, data = planted
    images = im.list_images(spark, folder)
    assert im.image_sha256(images).first().sha256 == hashlib.sha256(data).hexdigest()
    blocks = im.load_blocks(im.block_index(images, 1 << 16, 0))
    assert im.acquisition_manifest(blocks).first().bytes == len(data)


def test_partition_tables(spark, tmp_path):
    ntfs = bytearray(2048)
    ntfs[3:11] = b"NTFS    "
    disk = bytearray(1 << 20)
    disk[510:512] = b"\x55\xaa"
    disk[446:462] = struct.pack("<BBBBBBBBII", 0, 0, 0, 0, 7, 0, 0, 0, 64, 100)
    disk[64 * 512 : 64 * 512 + 2048] = ntfs
    gpt = bytearray(1 << 20)
    gpt[510:512] = b"\x55\xaa"
    gpt[446 + 4] = 0xEE
    gpt[512:520] = b"EFI PART"
    struct.pack_into("<Q", gpt, 512 + 72, 2)
    struct.pack_into("<II", gpt, 512 + 80, 4, 128)
    gpt[1024 : 1024 + 16] = b"t" * 16
    struct.pack_into("<Q", gpt, 1024 + 32, 200)
    ext = bytearray(2048)
    ext[1080:1082] = b"\x53\xef"
    gpt[200 * 512 : 200 * 512 + 2048] = ext
    for name, body in (("bare", bytes(ntfs)), ("mbr", disk), ("gpt", gpt), ("raw", bytes(4096))):
        (tmp_path / name).write_bytes(body)
    got = {(r.image_id.rsplit("/", 1)[1], r.fs_type, r.start) for r in im.partition_table(im.list_images(spark, str(tmp_path))).collect()}
    assert got == {("bare", "ntfs", 0), ("mbr", "ntfs", 64 * 512), ("gpt", "ext4", 200 * 512), ("raw", "raw", 0)}


def test_journal_resynchronises(spark, tmp_path):
    parts = [b.usn_record(10 * i, i % 4, 0x100 if i % 3 else 0x2000, f"file{i}.txt") for i in range(200)]
    data = b"".join(p + (b"\x07" * 24 if i % 11 == 0 else b"") for i, p in enumerate(parts))
    data += parts[3] + b.usn_record(99999, 1, 0x100, "v4", major=4) + b"\xff" * 40
    (tmp_path / "j").write_bytes(data)
    images = im.list_images(spark, str(tmp_path))
    extents = images.select("image_id", "path", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    rows = rec.read_resync_records(extents).orderBy("usn").collect()
    assert [(r.usn, r.name) for r in rows] == [(10 * i, f"file{i}.txt") for i in range(200)]
    assert rows[0].ts is not None and rows[0].reason_mask == 0x2000


def test_file_table(spark, tmp_path):
    runs = bytes([0x11, 4, 10]) + bytes([0x11, 2, 0xFE]) + bytes([0x01, 3])
    far = bytes([0x11, 5, 40])
    table = [
        b.mft_record(20, [b.attribute(0x30, b.file_name("docs", 5))], in_use=True, directory=True),
        b.mft_record(21, [b.attribute(0x30, b.file_name("gone.txt", 20, 77)), b.attribute(0x80, b"resident data")]),
        b.mft_record(22, [b.attribute(0x30, b.file_name("big.bin", 20)), b.attribute(0x20, b.list_entry(30)),
                     b.stream(runs, 4 * 4096 + 100)]),
        b.mft_record(23, [b.attribute(0x30, b.file_name("live.txt", 20))], in_use=True),
        b.mft_record(24, [b.attribute(0x30, b.file_name("secret", 99)), b.stream(runs, 10, flags=0x4000)]),
        b.mft_record(25, [b.attribute(0x30, b.file_name("torn", 20))], torn=True),
        b.mft_record(30, [b.stream(far, 500, vcn=9)], in_use=True),
    ]
    (tmp_path / "mft").write_bytes(b"".join(table))
    images = im.list_images(spark, str(tmp_path))
    extents = images.select("image_id", "path", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    records = rec.read_file_records(extents)
    assert records.count() == 6 and rec.read_file_records(extents, strict=False).where("NOT fixup_verified").count() == 1
    geometry = images.select("image_id", F.lit(4096).alias("cluster_size"), F.lit(1000).alias("partition_offset"))
    files, spans = filetable.recover_deleted(records, geometry)
    got = {r.record_num: r for r in files.collect()}
    assert set(got) == {21, 22, 24}
    assert got[21].path == "docs\\gone.txt" and bytes(got[21].resident_data) == b"resident data"
    assert got[24].path == "<record 99 not found>\\secret" and "EFS" in got[24].content_caveat
    places = [(r.file_offset, r.length, r.offset, r.is_sparse) for r in spans.where("record_num = 22").orderBy("file_offset").collect()]
    size = 4 * 4096 + 100 + 500
    assert places == [(0, 16384, 10 * 4096 + 1000, False), (16384, size - 16384, 8 * 4096 + 1000, False)]
    assert got[22].recovered_from_satellite


def test_long_names(spark):
    live, dead = b"LONGNA~1TXT", b"OTHER~1 BIN"
    slots = [*b.lfn_slots("a long name.txt", live), b.short_slot(live), *b.lfn_slots("gone for good.bin", dead), b.short_slot(dead, deleted=True)]
    broken = b.lfn_slots("stale.txt", b"X          ")
    slots += [broken[0][:12] + b"\x01" + broken[0][13:], b.short_slot(b"PLAIN   TXT"), bytes(32), b.short_slot(b"AFTER   TXT")]
    rows = [("i", 1, n, raw) for n, raw in enumerate(slots)]
    df = spark.createDataFrame(rows, "image_id string, dir_id long, slot int, raw binary")
    got = {r.short_name: (r.name, r.verification, r.is_deleted) for r in directory.pair_long_names(directory.decode_slots(df)).collect()}
    assert got == {
        "LONGNA~1.TXT": ("a long name.txt", "checksum", False),
        "_THER~1.BIN": ("gone for good.bin", "adjacency-only", True),
        "PLAIN.TXT": ("PLAIN.TXT", "failed", False),
    }


def test_bitmap_runs_cross_words(spark):
    rows = [("i", 0, 0, 8, b"\x0f", 10, 100), ("i", 0, 8, 8, b"\xf0", 10, 100), ("i", 0, 16, 3, b"\x00", 10, 100)]
    df = spark.createDataFrame(rows, "image_id string, part_no int, first_unit long, n_units int, bits binary, unit_bytes long, base long")
    got = sorted((r.start, r.end) for r in bitmap_to_ranges(df).collect())
    assert got == [(140, 220), (260, 290)]


def test_runs_and_checksums(spark):
    blob = bytes([0x21, 5, 0x10, 0x01]) + bytes([0x11, 3, 0xF0]) + bytes([0x01, 9]) + b"\0\xff"
    df = spark.createDataFrame([(blob, b"123456789")], "r binary, d binary")
    row = df.select(rec.decode_runs("r").alias("runs"), rec.crc32c("d").alias("crc")).first()
    assert [(x.lcn, x.len) for x in row.runs] == [(0x110, 5), (0x100, 3), (-1, 9)]
    assert row.crc == 0xE3069283
