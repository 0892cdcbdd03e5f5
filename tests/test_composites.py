"""Structure recovery joined with its bytes, and read-back verification of a medium."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests import builders as b
from tracewell.operators import filetable, sampling
from tracewell.operators.carve import combine_recoveries, structure_payloads
from tracewell.operators.timeline import journal_timeline
from tracewell.sources import images as im
from tracewell.sources import records as rec


def test_structure_payloads(spark, tmp_path):
    rng = random.Random(1)
    picture = b.png(rng, 5000)
    clusters = -(-len(picture) // 512)
    disk = bytearray(64 * 512)
    table = [
        b.mft_record(20, [b.attribute(0x30, b.file_name("d", 5))], in_use=True, directory=True),
        b.mft_record(21, [b.attribute(0x30, b.file_name("pic", 20)), b.stream(bytes([0x11, 4, 30]) + bytes([0x11, clusters - 4, 6]), len(picture))]),
        b.mft_record(22, [b.attribute(0x30, b.file_name("note.txt", 20)), b.attribute(0x80, b"resident text")]),
    ]
    disk[: 3 * 1024] = b"".join(table)
    disk[30 * 512 : 34 * 512] = picture[: 4 * 512]
    disk[36 * 512 : 36 * 512 + len(picture) - 4 * 512] = picture[4 * 512 :]
    (tmp_path / "disk").write_bytes(disk)
    images = im.list_images(spark, str(tmp_path))
    extents = images.select("image_id", "path", F.lit(0).cast("long").alias("start"), F.lit(3072).cast("long").alias("end"))
    records = rec.read_file_records(extents)
    geometry = images.select("image_id", F.lit(512).alias("cluster_size"), F.lit(0).alias("partition_offset"))
    files, spans = filetable.recover_deleted(records, geometry)
    got = {r.original_name: r for r in structure_payloads(files, spans, images).collect()}
    assert bytes(got["pic"].payload) == picture and got["pic"].extension == "png" and got["pic"].fragment_count == 2
    assert bytes(got["note.txt"].payload) == b"resident text" and got["note.txt"].original_path == "d\\note.txt"
    assert got["pic"].provenance.path_is_recovered and not got["pic"].provenance.name_is_verified
    again = structure_payloads(files, spans, images).select("image_id", "sha256", "extension").withColumn("ord", F.lit(1).cast("long"))
    assert combine_recoveries(structure_payloads(files, spans, images), again).count() == 2


def test_verify_medium(spark, tmp_path):
    (tmp_path / "clean").write_bytes(bytes(1 << 20))
    (tmp_path / "dirty").write_bytes(b"\x01" * (1 << 20))
    media = im.list_images(spark, str(tmp_path)).withColumn("sector_size", F.lit(512))
    got = {r.image_id.rsplit("/", 1)[1]: r for r in sampling.verify_medium(media, "zero").collect()}
    assert got["clean"].all_samples_match and got["clean"].residual_ppm == 45730
    assert not got["dirty"].all_samples_match and got["dirty"].residual_ppm == 1_000_000


def test_journal_timeline(spark):
    rows = [("v", 1, None, 0x100, 9, 5, 0x20, "a"), ("v", 2, None, 0x2, 8, 5, 0x20, "b")]
    usn = spark.createDataFrame(
        rows, "volume_id string, usn long, ts timestamp, reason_mask long, file_reference long, parent_reference long, file_attributes long, name string"
    )
    names = spark.createDataFrame([("v", "a")], "volume_id string, name string")
    timeline, summary = journal_timeline(usn, names)
    assert [(r.name, r.corroborated) for r in timeline.collect()] == [("a", True)]
    assert summary.first().files_tracked == 2


def test_large_deleted_files_are_whole_unless_a_cap_is_asked_for(spark, tmp_path):
    picture, cell = b.png(random.Random(2), 5000), 1 << 20
    sizes = {21: len(picture), 22: (200 << 20) + 5, 23: 3 << 30}
    table = [
        b.mft_record(n, [b.attribute(0x30, b.file_name(f"f{n}.png", 5)), b.stream(bytes([0x12]) + (-(-size // cell)).to_bytes(2, "little") + bytes([1]), size)])
        for n, size in sizes.items()
    ]
    disk = b"".join(table).ljust(cell, b"\0") + picture
    (tmp_path / "disk").write_bytes(disk)
    images = im.list_images(spark, str(tmp_path))
    extents = images.select("image_id", "path", F.lit(0).cast("long").alias("start"), F.lit(3072).cast("long").alias("end"))
    records = rec.read_file_records(extents)
    geometry = images.select("image_id", F.lit(cell).alias("cluster_size"), F.lit(0).alias("partition_offset"))
    spans = filetable.stream_extents(records.localCheckpoint(), geometry).localCheckpoint()
    assert {r.record_num: (r.length, r.truncated) for r in spans.collect()} == {n: (size, False) for n, size in sizes.items()}
    names = "image_id string, record_num long, name string, path string, resident_data binary, first_data_offset long, fragment_count int, mft_changed timestamp"
    image = images.first().image_id
    files = spark.createDataFrame([(image, n, f"f{n}.png", f"f{n}.png", None, cell, 1, None) for n in (21, 23)], names)
    whole = structure_payloads(files.withColumn("truncated", F.lit(False)), spans.where("record_num <> 22"), images)
    got = {r.original_name: r for r in whole.collect()}
    assert bytes(got["f21.png"].payload) == picture and got["f21.png"].sha256 and not got["f21.png"].too_long
    long = got["f23.png"]
    assert (long.size_bytes, long.payload, long.sha256, long.too_long) == (3 << 30, None, None, True)
    clipped = filetable.stream_extents(records, geometry, max_bytes=len(picture) - 1).localCheckpoint()
    assert all(r.truncated and r.length == len(picture) - 1 for r in clipped.collect())
    cut = structure_payloads(files.where("record_num = 21").withColumn("truncated", F.lit(True)), clipped.where("record_num = 21"), images)
    assert [(bytes(r.payload), r.sha256, r.truncated) for r in cut.collect()] == [(picture[:-1], None, True)]


def test_short_entries_of_large_files_stay(spark):
    slots = spark.createDataFrame([(bytearray(b"\xe5" + bytes(31)), 0, 5, n) for n in (100, 200 << 20)], "raw binary, cluster_high long, cluster_low long, file_size long")
    at = (F.lit(1 << 40), F.lit(0), F.lit(4096))
    assert {r.file_size: (r.data_length, r.truncated) for r in rec.deleted_short_entry(slots, *at).collect()} == {n: (n, False) for n in (100, 200 << 20)}
    assert {r.file_size: (r.data_length, r.truncated) for r in rec.deleted_short_entry(slots, *at, 150).collect()} == {100: (100, False), 200 << 20: (150, True)}


def test_files_without_a_digest_do_not_repeat_each_other(spark):
    rows = [("i", n, None, "bin") for n in (1, 2)] + [("i", n, "d", "bin") for n in (3, 4)]
    structure = spark.createDataFrame(rows, "image_id string, record_num long, sha256 string, extension string")
    signature = spark.createDataFrame([("i", 9, "d", "bin")], "image_id string, ord long, sha256 string, extension string")
    assert sorted(r.record_num for r in combine_recoveries(structure, signature).collect()) == [1, 2, 3]
