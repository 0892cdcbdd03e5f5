"""Journal folding against a sequential walk."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracewell.functions import bits
from tracewell.operators import timeline as tl
from tracewell.operators.paths import build_paths, follow_chain, fragment_runs

SCHEMA = (
    "volume_id string, usn long, ts timestamp, reason_mask long, file_reference long, parent_reference long, file_attributes long, name string"
)


def walk(records):
    """The fold, record by record, for one volume."""
    out = {}
    for _, usn, ts, mask, ref, parent, attrs, name in sorted(records, key=lambda r: (r[1], r[4], r[7])):
        e = out.setdefault(ref, {"name": name, "from": None, "born": None, "dead": None, "reasons": [], "n": 0, "last": 0})
        if e["n"] and mask & bits.RENAME_NEW and name != e["name"]:
            e["from"], e["name"] = e["name"], name
        if e["born"] is None and mask & bits.NAMING_MASK:
            e["born"] = ts
        if mask & bits.FILE_DELETE:
            e["dead"] = ts
        e["last"], e["n"] = max(e["last"], usn), e["n"] + 1
        e["reasons"] += [n for b, n in bits.REASONS.items() if mask & b and n not in e["reasons"]]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_fold_matches_walk(spark, seed):
    rng = random.Random(seed)
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    masks = [0x100, 0x200, 0x2000, 0x1000, 0x2, 0x2200, 0x80000]
    usns = rng.sample(range(5000), 300)
    rows = [
        ("v", u, None if rng.random() < 0.2 else base + timedelta(seconds=u), rng.choice(masks), rng.randrange(12), 5, 0x20, rng.choice("abcd"))
        for u in usns
    ]
    got = {r.file_reference: r for r in tl.fold_timeline(spark.createDataFrame(rows, SCHEMA), bucket_usn=64).collect()}
    want = walk(rows)
    assert set(got) == set(want)
    for ref, e in want.items():
        row = got[ref]
        plain = [x.replace(tzinfo=timezone.utc) if x else None for x in (row.created_at, row.deleted_at)]
        assert (row.name, row.renamed_from, row.last_usn, row.event_count) == (e["name"], e["from"], e["last"], e["n"])
        assert list(row.reasons) == e["reasons"]
        assert plain == [e["born"], e["dead"]]


def test_deletion_time_follows_the_last_delete_even_when_undated(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [("v", 1, at, 0x200, 7, 5, 0, "a"), ("v", 2, None, 0x200, 7, 5, 0, "a")]
    assert tl.fold_timeline(spark.createDataFrame(rows, SCHEMA)).first().deleted_at is None


def test_nt_time(spark):
    values = [0, -1, 2**63 - 1, bits.NT_EPOCH_TICKS, bits.NT_EPOCH_TICKS + 15_000_000, bits.NT_EPOCH_TICKS - 1, 2_700_000_000_000_000_000]
    df = spark.createDataFrame([(v,) for v in values], "t long").select(F.unix_micros(bits.nt_time(F.col("t"))).alias("u"))
    assert [r.u for r in df.collect()] == [None, None, None, 0, 1_500_000, None, None]


def test_paths_stop_at_root_cycle_and_loss(spark):
    rows = [
        ("i", 20, "top", 5), ("i", 21, "mid", 20), ("i", 22, "file", 21), ("i", 30, "a", 31), ("i", 31, "b", 30), ("i", 40, "x", 99),
    ]
    df = spark.createDataFrame(rows, "image_id string, record_num long, name string, parent_record long")
    got = {r.record_num: r.path for r in build_paths(df).collect()}
    assert got == {20: "top", 21: "top\\mid", 22: "top\\mid\\file", 30: "b\\a", 31: "a\\b", 40: "<record 99 not found>\\x"}


def test_deep_path_is_cut_after_32_ancestors(spark):
    rows = [("i", 100 + n, f"d{n}", 99 + n if n else 5) for n in range(60)]
    df = spark.createDataFrame(rows, "image_id string, record_num long, name string, parent_record long")
    got = {r.record_num: r.path for r in build_paths(df).collect()}
    assert got[159] == "\\".join(f"d{n}" for n in range(27, 60))


def test_chain_stops_at_loop_and_size(spark):
    links = spark.createDataFrame(
        [("i", c, n) for c, n in {2: 3, 3: 4, 4: 3, 10: 11, 11: 20, 20: 21, 21: 0x0FFFFFFF}.items()], "image_id string, cluster long, next_cluster long"
    )
    heads = spark.createDataFrame([("i", 2, 50), ("i", 10, 3), ("i", 11, 9)], "image_id string, head long, n_clusters long")
    chain = follow_chain(links, heads, 16384)
    got = {}
    for r in chain.orderBy("head", "pos").collect():
        got.setdefault(r.head, []).append(r.cluster)
    assert got == {2: [2, 3, 4], 10: [10, 11, 20], 11: [11, 20, 21]}
    runs = {r.head: r.fragment_count for r in fragment_runs(chain).collect()}
    assert runs == {2: 1, 10: 2, 11: 1}
