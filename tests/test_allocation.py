"""Free space against maps that are known, and the difference of ranges against single units."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from tests import builders
from tests import volumes as build
from tracewell.operators.allocation import image_free_space
from tracewell.operators.extents import HALF_OPEN, INCLUSIVE, subtract_extents
from tracewell.sources.images import list_images


@pytest.mark.parametrize("mode", [INCLUSIVE, HALF_OPEN])
def test_difference_against_single_units(spark, mode):
    rng = random.Random(8)
    sides = [[(k % 3, s := rng.randrange(300), s + rng.randrange(-1, 25)) for k in range(n)] for n in (60, 45)]
    frames = [spark.createDataFrame(side, "image_id int, start long, end long") for side in sides]
    one = 1 if mode == INCLUSIVE else 0
    units = [{(k, u) for k, s, e in side for u in range(s, e + one)} for side in sides]
    left = units[0] - units[1]
    want = {(k, u) for k, u in left if (k, u - 1) not in left}
    got = subtract_extents(*frames, mode=mode, bucket_bytes=32).collect()
    assert {(r.image_id, r.start) for r in got} == want and len(got) == len(want)
    assert {(r.image_id, u) for r in got for u in range(r.start, r.end + one)} == left


def fat_like(image: bytes, free: list[int]) -> bytes:
    """All clusters of a ``build.fat32`` image in use but these."""
    out = bytearray(image)
    for cluster in range(2, (1 << 20) // 512 - 96 + 2):
        struct.pack_into("<I", out, 32 * 512 + 4 * cluster, 0 if cluster in free else 0x0FFFFFFF)
    return bytes(out)


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("free")
    # The root's own entry is 0 and must not count as free.
    (folder / "fat.img").write_bytes(fat_like(build.fat32({2: []}, {}, {}), [2, 3, 4, 5, 9, 1953]))
    entry = lambda kind, cluster, size: bytes([kind]) + bytes(19) + struct.pack("<IQ", cluster, size)
    root = entry(0x81, 2, 8) + entry(0x82, 6, 4097)
    # 60 clusters; bit 0 is cluster 2. Clusters 10 to 12 are marked; bitmap 2, table 6 and 7, root 4 and 5 are not.
    bits = sum(1 << (c - 2) for c in (10, 11, 12)).to_bytes(8, "little")
    (folder / "exfat.img").write_bytes(build.exfat({4: root.ljust(4096, b"\x01")}, {2: bits}, {4: 5, 5: 0xFFFFFFFF}))
    (folder / "ext4.img").write_bytes(build.with_bitmaps(build.ext4({}, {}, groups=2), {0: list(range(0, 120)), 1: list(range(8, 128))}))
    (folder / "torn.img").write_bytes(build.with_bitmaps(build.ext4({}, {}, groups=2), {0: [1, 2, 3]}))
    used = (1 << 40) - 1
    runs = bytes([0x21, 1]) + (30).to_bytes(2, "little") + bytes([0])
    table = bytes([0x11, 1, 4, 0x11, 2, 36, 0])
    for name, pieces in (("ntfs.img", False), ("pieces.img", True)):
        record = builders.mft_record(0, [builders.stream(table if pieces else bytes([0x11, 4, 4, 0]), 3 * 4096)])
        bitmap = builders.mft_record(6, [builders.stream(runs, 256)])
        (folder / name).write_bytes(build.ntfs(record, bitmap, {30: used.to_bytes(256, "little")}, pieces))
    (folder / "noise.img").write_bytes(b"\x01" * 5000)
    images = list_images(spark, str(folder)).withColumn("image_id", F.element_at(F.split("path", "/"), -1))
    free, notes, ranges = image_free_space(images)
    by = {}
    for r in ranges.collect():
        by.setdefault(r.image_id, set()).add((r.start, r.end))
    return by, {r.image_id: r for r in notes.collect()}, {r.image_id for r in free.select("image_id").distinct().collect()}


def test_fat_entries_that_are_zero_are_free_but_for_the_root(found):
    at = lambda c: 96 * 512 + (c - 2) * 512
    assert found[0]["fat.img"] == {(at(3), at(6)), (at(9), at(10)), (at(1953), at(1954))}
    assert found[1]["fat.img"].reliable and found[1]["fat.img"].free_bytes == 5 * 512


def test_exfat_structures_are_never_free(found):
    at = lambda c: 8192 + (c - 2) * 4096
    assert found[0]["exfat.img"] == {(at(3), at(4)), (at(8), at(10)), (at(13), at(62))}


def test_ext4_bitmaps_by_group(found):
    # Block 0 belongs to no group; the second group is a block short.
    assert found[0]["ext4.img"] == {(121 * 1024, 137 * 1024)} and found[1]["ext4.img"].reliable
    assert not found[1]["torn.img"].reliable


def test_ntfs_bitmap_of_record_six_even_in_pieces(found):
    for name in ("ntfs.img", "pieces.img"):
        assert found[0][name] == {(40 * 4096, 2048 * 4096)} and found[1][name].reliable


def test_images_without_a_map_are_searched_whole(found):
    assert found[2] == {"fat.img", "exfat.img", "ext4.img", "ntfs.img", "pieces.img"}
    assert "whole volume" in found[1]["noise.img"].note and "whole volume" in found[1]["torn.img"].note
