"""Custom signatures, extension filters, resumed sessions, hostile headers and added checks in a carve."""

from __future__ import annotations

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tests import builders as b
from tracewell.functions import chains, structure
from tracewell.operators.carve import carve
from tracewell.operators.scan import signature_patterns
from tracewell.sources import images as im
from tracewell.sources.signatures import signature_table

ALPHA = b"ALPHA-MAGIC" + b"a" * 300 + b"ALPHA-END"
BETA = b"BETA--MAGIC" + b"b" * 9_000 + b"MARKER" + b"b" * 300 + b"BETA-END"


@pytest.fixture(scope="module")
def disks(tmp_path_factory):
    rng = random.Random(9)
    folder = tmp_path_factory.mktemp("disks")
    picture = b.png(rng, 800)
    for name in ("a.img", "b.img"):
        data = bytearray(200_000)
        data[5_000 : 5_000 + len(ALPHA)] = ALPHA
        data[20_000 : 20_000 + len(BETA)] = BETA
        data[60_000 : 60_000 + len(picture)] = picture
        data[100_000 : 100_000 + 6] = b"7z\xbc\xaf\x27\x1c"
        data[100_006 : 100_006 + 40] = b"\xff" * 40
        (folder / name).write_bytes(data)
    custom = [
        {"name": "Alpha", "extension": "alpha", "header": ALPHA[:11].hex(), "footer": b"ALPHA-END".hex(), "min_size": 16},
        {"name": "Beta", "extension": "beta", "header": BETA[:11].hex(), "footer": b"BETA-END".hex(), "min_size": 16,
         "inbuilt": b"MARKER".hex(), "inbuilt_search_window": 12_000},
    ]
    path = tmp_path_factory.mktemp("sig") / "custom.json"
    path.write_text(json.dumps(custom))
    return str(folder), str(path), picture


def test_two_custom_signatures_give_two_files(spark, disks):
    folder, custom, picture = disks
    result = carve(im.list_images(spark, folder + "/a.img"), signature_table(spark, custom), extensions=["png"], block=1 << 16)
    got = {(r.offset, r.extension, bytes(r.payload)) for r in result.recovered.collect()}
    assert got == {(5_000, "alpha", ALPHA), (20_000, "beta", BETA), (60_000, "png", picture)}


def test_hostile_lengths_are_rejections(spark, disks):
    folder, _, _ = disks
    result = carve(im.list_images(spark, folder + "/a.img"), extensions=["7z"], block=1 << 16)
    assert result.recovered.count() == 0
    assert [r.reason for r in result.rejected.collect()] == ["7z next-header offsets implausible"]


def test_a_session_speaks_for_its_own_image(spark, disks):
    folder, _, picture = disks
    images = im.list_images(spark, folder)
    first = next(r.image_id for r in images.collect() if r.image_id.endswith("a.img"))
    session = spark.range(1).select(F.lit(first).alias("image_id"), F.sha2(F.lit(picture), 256).alias("sha256"))
    result = carve(images, session=session, extensions=["png"], block=1 << 16)
    assert [r.image_id.rsplit("/", 1)[1] for r in result.recovered.collect()] == ["b.img"]


def test_signatures_with_one_rank_are_refused(spark):
    table = signature_table(spark)
    with pytest.raises(ValueError):
        signature_patterns(table.unionByName(table.limit(1)))


def test_checks_added_later_are_used(spark, monkeypatch):
    monkeypatch.setattr(structure, "_ADDED", {})
    df = spark.createDataFrame([(b"x" * 40, "foo"), (b"y" * 40, "foo")], "p binary, e string")
    gate = lambda: sorted(r.g.ok for r in df.select(structure.validate_structure(F.col("p"), F.col("e")).alias("g")).collect())
    assert gate() == [True, True]
    structure.register_validator(".foo", lambda data: (data[:1] == b"x", "first byte"))
    assert gate() == [False, True]


def walk(extension: str, data: bytes):
    return chains.walk(extension, lambda at, n: data[at : at + n], 0, len(data))[:2]


def test_walks_by_layout():
    rng = random.Random(2)
    picture = b.png(rng, 3000)
    assert walk("png", picture + b"junk") == (len(picture), "container_walk")
    assert walk("png", picture[:-4])[0] is None
    block = struct.pack("<II", 0x0A0D0D0A, 28) + bytes(16) + struct.pack("<I", 28)
    assert walk("pcapng", block * 3 + b"\1" * 9) == (84, "container_walk")
    assert walk("pcap", b"\xd4\xc3\xb2\xa1" + bytes(20) + (struct.pack("<IIII", 0, 0, 5, 5) + b"hello") * 2) == (24 + 42, "container_walk")
    song = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", 4) + b"\0\xff\x2f\0"
    assert walk("mid", song + b"tail") == (len(song), "container_walk")
    assert walk("mid", song[:14])[0] is None
    box = struct.pack(">I", 16) + b"ftypisom" + bytes(4) + struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 20) + b"abcd"
    assert walk("mp4", box + b"\0\0\0\3none") == (36, "container_walk")
    packets = (b"\x47" + bytes(187)) * 20
    assert walk("ts", packets + b"x") == (len(packets), "sync_run") and walk("ts", packets[: 188 * 9])[0] is None
    hive = bytes(4096) + b"hbin" + struct.pack("<I", 0).ljust(0) + b"" 
    hive = bytes(4096) + (b"hbin" + struct.pack("<II", 0, 0)).ljust(4096, b"\1")
    assert walk("dat", hive)[0] is None


def test_noise_is_no_format_without_a_rule(spark):
    import random

    from pyspark.sql import functions as F

    from tracewell.functions.structure import validate_structure

    noise = bytearray(random.Random(4).randbytes(20_000))
    df = spark.createDataFrame([(ext, noise) for ext in ("jpg", "jpeg", "gz", "mp3", "flac", "xyz")], "ext string, payload binary")
    assert not any(r.g.ok for r in df.select(validate_structure(F.col("payload"), F.col("ext")).alias("g")).collect())


def test_units_are_walked_not_guessed_from_the_ends(spark):
    """Noise between a sound beginning and end is rejected; a bad checksum alone is counted."""
    rng = random.Random(8)
    png, wav, packed = b.png(rng, 3000), b.wav(rng), b.zipped(3)
    torn = png[:200] + rng.randbytes(400) + png[-12:]
    gap = png[:33] + rng.randbytes(300) + png[-12:]
    flipped = png[:60] + bytes([png[60] ^ 1]) + png[61:]
    at = packed.index(b"PK\x01\x02")
    movie = b"RIFF" + struct.pack("<I", 40) + b"AVI LIST" + struct.pack("<I", 4) + b"hdrlLIST" + struct.pack("<I", 8) + b"movi\0\0\0\0"
    cases = {
        "png": ("png", png, True), "torn": ("png", torn, False), "gap": ("png", gap, False), "flipped": ("png", flipped, True),
        "wav": ("wav", wav, True), "unpadded": ("wav", wav[:40] + struct.pack("<I", 499) + wav[44:-1], True),
        "noise": ("wav", wav[:12] + rng.randbytes(300) + b"fmt " + rng.randbytes(40) + b"data" + bytes(20), False),
        "silent": ("wav", wav[:22] + b"\0\0" + wav[24:], False), "no data": ("wav", wav[:36], False),
        "zip": ("zip", packed, True), "no directory": ("zip", packed[:at] + b"PK\x01\x09" + packed[at + 4 :], False),
        "avi": ("avi", movie, True), "word": ("avi", movie.replace(b"movi", b"rec ") + b"movi", False),
        "empty": ("png", b"", False), "null": ("png", None, False),
    }
    rows = [(name, ext, None if data is None else bytearray(data)) for name, (ext, data, _) in cases.items()]
    df = spark.createDataFrame(rows, "name string, ext string, payload binary")
    got = {r.name: r.g for r in df.select("name", structure.validate_structure(F.col("payload"), F.col("ext")).alias("g")).collect()}
    assert {name: bool(g.ok) for name, g in got.items() if name != "null"} == {name: ok for name, (_, _, ok) in cases.items() if name != "null"}
    assert got["png"].reason.endswith(" 0 CRC mismatch)") and got["flipped"].reason.endswith(" 1 CRC mismatch)")
    assert "channels=0" in got["silent"].reason and "central directory header" in got["no directory"].reason
