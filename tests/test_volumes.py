"""Deleted files of FAT32, exFAT and ext4 volumes built byte by byte."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests import volumes as build
from tracewell.operators.carve import structure_payloads
from tracewell.operators.volumes import fat_geometry, list_volumes, read_links, recover_volumes
from tracewell.sources.images import list_images
from tracewell.sources.records import deleted_exfat_entry, extent_entries

PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n%%EOF"
SECRET = b"CONFIDENTIAL FORENSIC INTELLIGENCE FROM USB STORAGE"
END = 0x0FFFFFFF


def fat_image() -> bytes:
    filler = [build.short(f"LIVE{k:03}.TXT", 40, 5) for k in range(16)]
    long = [build.long_fragment("report of may", deleted=False), build.short("REPORT~1.PDF", 21, len(PDF), deleted=True)]
    directories = {
        2: [build.short("EVIDENCE.TXT", 3, len(SECRET), deleted=True), build.short("DOCS", 10, 0, directory=True), build.short("OLD", 30, 0, deleted=True, directory=True)],
        # A directory of two clusters that do not touch; the second holds a deleted file and a subdirectory.
        10: [build.short(".", 10, 0, directory=True), build.short("..", 0, 0, directory=True), *filler[:14]],
        15: [*long, build.short("SUB", 12, 0, directory=True)],
        12: [build.short(".", 12, 0, directory=True), build.short("LOOP", 10, 0, directory=True), build.short("DEEP.BIN", 50, 1300, deleted=True)],
        30: [build.short(".", 30, 0, directory=True), build.short("GONE.DAT", 60, 20, deleted=True), build.short("AWAY.DAT", 4000, 1 << 20, deleted=True)],
    }
    data = {3: SECRET, 21: PDF, 50: bytes(range(256)) * 5 + b"x" * 20, 60: b"y" * 20}
    return build.fat32(directories, data, {2: END, 10: 15, 15: END, 12: END, 40: END})


def exfat_image() -> bytes:
    root = build.exfat_set("classified_report.pdf", 5, len(PDF)) + build.exfat_set("folder", 8, 8192, deleted=False, directory=True)
    root += build.exfat_set("hostile.bin", 9, (1 << 64) - 1) + build.exfat_set("tree", 20, 4096, deleted=False, directory=True, chained=True)
    # 128 slots, all of the first cluster.
    inner = b"".join(build.exfat_set(f"live{k:05}.txt" + "x" * 5 * (k > 39), 30, 5, deleted=False) for k in range(42))
    more = build.exfat_set("second cluster.txt", 31, len(SECRET))
    return build.exfat({4: root, 8: inner, 9: b"\x85" + bytes(31) + more, 20: build.exfat_set("a.txt", 31, 9)}, {5: PDF, 31: SECRET}, {4: 0xFFFFFFFF, 20: 0xFFFFFFFF})


def ext4_image() -> tuple[bytes, bytes, bytes]:
    whole, split = PDF * 3, bytes(k % 251 for k in range(5000))
    inodes = {
        12: (len(whole), build.extent_node([(0, 60, 1)])), 2: (9, build.extent_node([(0, 60, 1)])),
        # In the second group: a tree of two levels, its leaves out of order on the medium, a hole of unwritten blocks.
        40: (len(split), build.extent_node([(0, 70), (3, 71)], depth=1)),
    }
    blocks = {
        60: whole, 70: build.extent_node([(0, 90, 2), (2, 95, 32768 + 1)]), 71: build.extent_node([(3, 80, 2)]),
        90: split[:2048], 80: split[3072:], 95: b"never written",
    }
    return build.ext4(inodes, blocks, groups=2), whole, split[:2048] + bytes(1024) + split[3072:]


@pytest.fixture(scope="module")
def recovered(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("images")
    mbr = bytearray(512)
    mbr[446:462] = bytes([0, 0, 0, 0, 0x0C, 0, 0, 0]) + (2048).to_bytes(4, "little") + (2048).to_bytes(4, "little")
    mbr[510:512] = b"\x55\xaa"
    image = bytes(mbr).ljust(2048 * 512, b"\0") + fat_image()
    (folder / "fat.img").write_bytes(image)
    (folder / "exfat.img").write_bytes(exfat_image())
    (folder / "ext4.img").write_bytes(ext4_image()[0])
    (folder / "noise.img").write_bytes(b"\x01" * 5000)
    images = list_images(spark, str(folder)).withColumn("image_id", F.element_at(F.split("path", "/"), -1))
    files, spans = recover_volumes(images)
    files, spans = files.cache(), spans.cache()
    payloads = structure_payloads(files, spans, images).collect()
    return images, files.collect(), {(r.image_id, r.original_path): r for r in payloads}


def test_fat32_trees(recovered):
    _, files, payloads = recovered
    own = {r.path: r for r in files if r.image_id == "fat.img"}
    assert set(own) == {"_VIDENCE.TXT", "DOCS\\report of may", "DOCS\\SUB\\_EEP.BIN", "_LD\\_ONE.DAT"}
    assert payloads["fat.img", "_VIDENCE.TXT"].payload == SECRET and own["_VIDENCE.TXT"].name_source == "8.3 name only"
    assert payloads["fat.img", "DOCS\\report of may"].payload == PDF and own["DOCS\\report of may"].name_verification == "adjacency-only"
    assert bytes(payloads["fat.img", "DOCS\\SUB\\_EEP.BIN"].payload) == bytes(range(256)) * 5 + b"x" * 20
    assert payloads["fat.img", "_LD\\_ONE.DAT"].payload == b"y" * 20
    assert all(r.fragment_count == 1 and r.part_no == 0 for r in own.values())


def test_exfat_trees(recovered):
    _, files, payloads = recovered
    own = {r.path: r for r in files if r.image_id == "exfat.img"}
    assert set(own) == {"classified_report.pdf", "folder\\second cluster.txt", "tree\\a.txt"}
    assert payloads["exfat.img", "classified_report.pdf"].payload == PDF and payloads["exfat.img", "classified_report.pdf"].extension == "pdf"
    assert payloads["exfat.img", "folder\\second cluster.txt"].payload == SECRET
    assert payloads["exfat.img", "tree\\a.txt"].payload == SECRET[:9]


def test_ext4_inodes(recovered):
    _, files, payloads = recovered
    own = {r.name: r for r in files if r.image_id == "ext4.img"}
    _, whole, split = ext4_image()
    assert set(own) == {"inode_12", "inode_40"}
    assert payloads["ext4.img", "inode_12"].payload == whole and payloads["ext4.img", "inode_40"].payload == split
    assert own["inode_40"].fragment_count == 3 and own["inode_12"].fragment_count == 1
    assert own["inode_12"].mft_changed.timestamp() == 1690000000
    assert payloads["ext4.img", "inode_12"].provenance.filesystem == "ext4"


def test_geometry_and_links(recovered):
    images, _, _ = recovered
    volumes = list_volumes(images)
    assert {(r.image_id, r.fs_type, r.start) for r in volumes.collect()} == {
        ("fat.img", "fat32", 1 << 20), ("exfat.img", "exfat", 0), ("ext4.img", "ext4", 0), ("noise.img", "raw", 0)
    }
    tables = {r.fs_type: r for r in fat_geometry(volumes).collect()}
    assert (tables["fat32"].cluster_size, tables["fat32"].heap, tables["fat32"].n_clusters) == (512, (1 << 20) + 96 * 512, (1 << 20) // 512 - 96)
    assert (tables["exfat"].cluster_size, tables["exfat"].heap, tables["exfat"].root_cluster) == (4096, 8192, 4)
    links = {(r.image_id, r.cluster, r.next_cluster) for r in read_links(fat_geometry(volumes)).collect()}
    assert links == {("fat.img", c, n) for c, n in ((2, END), (10, 15), (15, END), (12, END), (40, END))} | {("exfat.img", 4, 0xFFFFFFFF), ("exfat.img", 20, 0xFFFFFFFF)}


def test_no_volume_gives_no_rows(spark, tmp_path):
    (tmp_path / "noise.img").write_bytes(b"\x02" * 4096)
    files, spans = recover_volumes(list_images(spark, str(tmp_path)))
    assert files.count() == 0 and spans.count() == 0


def test_hostile_exfat_lengths_and_nodes(spark):
    raw = build.exfat_set("x.bin", 9, (1 << 64) - 1)
    slots = spark.createDataFrame([("i", 1, k, bytearray(raw[32 * k : 32 * k + 32])) for k in range(3)], "image_id string, dir_id long, slot long, raw binary")
    assert deleted_exfat_entry(slots).count() == 0
    nodes = [build.extent_node([(0, 7, 1)]), b"", b"\x0a\xf3\xff\xff" + bytes(8), bytes(60), None]
    got = spark.createDataFrame([(k, None if n is None else bytearray(n)) for k, n in enumerate(nodes)], "k int, n binary").select("k", extent_entries(F.col("n")).alias("e"))
    assert {r.k: [(x.logical, x.block, x["count"]) for x in r.e] for r in got.collect()} == {0: [(0, 7, 1)], 1: [], 2: [], 3: [], 4: []}
