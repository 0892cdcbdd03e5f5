"""What reviews found on odd inputs and larger tables."""

from __future__ import annotations

import datetime
import inspect
import json
import os
import random
import time

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tests.oracle import TABLES, compare, duck
from tracewell.catalog import all_queries, all_sql
from tracewell.catalog import ledger as cl
from tracewell.catalog import streams as cs
from tracewell.functions import canonical, entropy, scoring, structure
from tracewell.operators import certificates as ct
from tracewell.operators import extents as ex
from tracewell.operators import fragments as fr
from tracewell.streaming.ledger import monitor_ledger
from tracewell.streaming.timeline import TimelineFold, latest_rows, stream_timeline

SF = "/root/testdata/sf0.001"


def test_two_places_round_the_exact_value(spark):
    rng = random.Random(4)
    values = [k / 8 for k in range(65)] + [k / 200 for k in range(1601)] + [rng.uniform(0, 8) for _ in range(2000)] + [rng.uniform(0, 0.02) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", scoring.two_places(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in got} == {v: f"{v:.2f}" for v in values}


def test_a_tar_member_larger_than_its_candidate_is_refused(spark):
    head = b"n" * 124
    cases = {head + b"407": False, head + b"00000000007": True, head + b"177\x00junk": True, head + b"400 ": False, head: True, head + b"8": False}
    rows = spark.createDataFrame([(bytearray(k),) for k in cases], "p binary")
    got = rows.select("p", structure.validate_structure(F.col("p"), F.lit("tar")).alias("g")).collect()
    assert {bytes(r.p): r.g.ok for r in got} == cases
    assert next(r.g.reason for r in got if bytes(r.p).endswith(b"407")) == "tar member declares 263 bytes, more than the 127-byte candidate"


def test_canonical_documents_are_worked_on_in_small_runs():
    docs = ['{"b":"%s","a":1}' % ("x" * (3 << 20)), *['{"b":"%s","a":1}' % ("y" * 1000)] * 5000, None, "nope"]
    made = list(canonical._canonical_runs(iter([pa.array(docs)]), None))
    assert sum(map(len, made)) == len(docs) and max(m.field("text").nbytes for m in made) < 4 << 20 and len(made) >= 4
    rows = [r for m in made for r in m.to_pylist()]
    assert rows[0]["text"] == '{"a":1,"b":"%s"}' % ("x" * (3 << 20)) and rows[-2] == {"text": None, "error": None} and rows[-1]["error"]
    assert [len(m) for m in canonical._canonical_runs(iter([pa.array([], pa.string())]), None)] == [0]


def test_only_numbers_that_remain_have_to_be_exact():
    deep = "[" * 64 + "]" * 64
    kept = {
        '{"signature":{"x":1.5,"y":NaN,"z":90071992547409929007},"b":2,"a":"{[1.5"}': '{"a":"{[1.5","b":2}',
        '{"a":1.5,"a":2}': '{"a":2}',
        '{"signature":%s,"a":"%s"}' % ("[" * 80 + "]" * 80, "{" * 70): '{"a":"%s"}' % ("{" * 70),
        deep: deep,
    }
    assert {k: canonical.canonical_text(k, "signature") for k in kept} == kept
    for doc in ('{"a":1.5}', '{"a":[9007199254740992]}', '{"a":-Infinity}', "[[" + deep + "]]", '{"signature":1.5,"a":1e3}'):
        try:
            canonical.canonical_text(doc, "signature")
        except canonical._Refused:
            continue
        raise AssertionError(doc)


def test_samples_cross_to_python_as_one_value(spark):
    texts = [b"", b"ab" * 3072, bytes(range(256)) * 32, b"a" * 8193, random.Random(1).randbytes(9000), None]
    rows = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in enumerate(texts)], "i int, p binary")
    value = entropy.sample_entropy(F.col("p"))
    got = {r.i: r.e for r in rows.select("i", value.alias("e")).collect()}
    noise = texts[4]
    parts = [noise[:2048], noise[4500:6548], noise[-2048:]]
    assert got == {0: 0.0, 1: 1.0, 2: 8.0, 3: 0.0, 4: sum(map(entropy._entropy, parts)) / 3, 5: None}
    assert "array" not in rows.select(value.alias("e"))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_links_and_pages_leave_documents_out_of_the_shuffle(spark):
    whole = cl._chain(spark, SF)
    narrow = cl._chain(spark, SF, ["chain_id", "block_index", "prev_hash", "block_hash", "price"])
    assert "certificate_json" in whole.columns and "certificate_json" not in narrow.columns
    shuffled = [line for line in narrow._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line]
    assert shuffled and not any("certificate_json" in line or "payload#" in line for line in shuffled)
    cols = ["chain_id", "block_index", "prev_hash", "block_hash"]
    assert sorted(map(tuple, narrow.select(*cols).collect())) == sorted(map(tuple, whole.select(*cols).collect()))


def test_a_replay_takes_few_batches_however_many_files(spark, tmp_path):
    spark.range(400).repartition(40).write.parquet(str(tmp_path / "t"))
    replayed = cs._replay(spark, cs._as_stream(spark, str(tmp_path / "t")), "append")
    assert sorted(r.id for r in replayed.select("id").collect()) == list(range(400))
    assert len({f.rsplit("/", 2)[-2] for f in replayed.inputFiles()}) == 4


def test_blocks_out_of_order_are_linked_over_batches(spark, tmp_path):
    blocks = cl._chain(spark, SF).select("chain_id", "block_index", *canonical.BLOCK_STRINGS, "block_hash")
    chain = blocks.groupBy("chain_id").count().orderBy(F.desc("count"), "chain_id").first()
    name, n = chain
    assert n >= 6
    one = blocks.where(F.col("chain_id") == name).withColumn("prev_hash", F.when(F.col("block_index") == 3, F.lit("f" * 64)).otherwise(F.col("prev_hash")))
    for at, which in enumerate([F.col("block_index") >= 3, F.col("block_index").isin(1, 4), F.col("block_index").isin(0, 2)]):
        one.where(which).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        time.sleep(1.1)
    stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    got = cs._replay(spark, monitor_ledger(stream, patience_seconds=None), "append").collect()
    kinds = sorted((r.block_index, r.kind) for r in got)
    assert kinds == [(3, "hash"), (3, "link"), (4, "repeat")]


def test_late_renames_are_folded_over_batches_as_rows(spark, tmp_path):
    schema = "volume_id string, file_reference long, usn long, ts timestamp, reason_mask long, name string"
    for batch in ([("v", 1, 5, None, 0x2000, "c"), ("v", 1, 1, None, 0x100, "a")], [("v", 1, 3, None, 0x2000, "b")], [("v", 1, 9, datetime.datetime(2026, 1, 1), 0x200, "c"), ("v", 2, 2, None, 2, "z")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        time.sleep(1.1)
    updates = stream_timeline(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t")))
    seen = inspect.signature(TimelineFold.handleInputRows).parameters["rows"].annotation
    assert seen == "Iterator[Row]"  # rows, not a pandas frame for every reference
    got = {r.file_reference: (r.name, r.renamed_from, r.was_deleted, r.last_usn, r.event_count) for r in latest_rows(cs._replay(spark, updates, "update")).collect()}
    assert got == {1: ("c", "b", True, 9, 4), 2: ("z", None, False, 2, 1)}


def test_verdicts_need_no_notes_and_chunks_no_second_numbering(spark):
    schema = "set_id int, key long, image_offset long, length long, grp string, key_kind string, key_source string, decode_time long, duration_sum long, label string"
    rows = [(1, k, k, 5, "g", "sequence", "n", k * 10, 10, f"a{k}") for k in (1, 2, 5, 9)] + [(2, k, i, 5, "g", "sequence", "n", None, None, f"b{i}") for i, k in enumerate((1, 2, 2))]
    rows += [(3, k, k, 5, "g", "sequence", "n", k * 10, 11, f"c{k}") for k in (4, 5)] + [(4, 7, 0, 5, "g", "timecode", "n", None, None, "d")]
    table = spark.createDataFrame(rows, schema)
    told, bare = ({r.set_id: r.asDict() for r in fr.reassemble(table, notes=n).collect()} for n in (True, False))
    assert {k: {**v, "notes": None} for k, v in told.items()} == bare and all(v["notes"] for v in told.values())
    assert bare[1]["missing_count"] == 5 and bare[1]["refusal"] == "5 fragment(s) are missing" and bare[2]["refusal"] == "duplicate logical key 2"
    assert bare[3]["refusal"].startswith("c4 ends at decode time 51") and bare[4]["refusal"] is None and bare[4]["complete"]
    runs = spark.createDataFrame([(1, 1, 2)], "track_id int, first_chunk long, samples_per_chunk long")
    sizes = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "track_id int, sample long, size long")
    chunks = spark.createDataFrame([(1, c, 100 * c) for c in (1, 2, 3, 4)], "track_id int, chunk long, offset long")
    extents = fr.chunk_extents(runs, sizes, chunks)
    assert sorted(map(tuple, extents.collect())) == [(1, 1, 100, 3), (1, 2, 200, 7), (1, 3, 300, 5)]
    assert extents._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_repeated_extents_change_nothing(spark):
    rows = [(1, s, s + n) for s in range(0, 2000, 64) for n in (11, 90)] + [(2, 64, 70)]
    once, often = (spark.createDataFrame(rows * n, "image_id int, start long, end long") for n in (1, 6))
    bounds = spark.createDataFrame([(1, 0, 2500), (2, 0, 100), (3, 5, 9)], "image_id int, lo long, hi long")
    for result in (ex.merge_extents, lambda d: ex.complement(d, bounds)):
        assert sorted(map(tuple, result(often).collect())) == sorted(map(tuple, result(once).collect()))


def _agree_with(spark, tmp_path, table: str, replaced: str, *names: str) -> None:
    """Queries and their SQL over the smoke tables, with some columns of one table replaced."""
    for name in TABLES:
        if name != table:
            os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    with duckdb.connect() as con:
        con.execute(f"COPY (SELECT * REPLACE ({replaced}) FROM '{SF}/{table}.parquet') TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    told = {name: compare(duck(str(tmp_path)), all_queries()[name](spark, str(tmp_path)), all_sql()[name]) for name in names}
    assert all(ok for ok, _ in told.values()), told


def _agrees_on_empty_texts(spark, tmp_path, *names: str) -> None:
    _agree_with(spark, tmp_path, "documents", "CASE WHEN doc_id % 23 = 5 THEN '' WHEN doc_id = 7 THEN NULL ELSE text END AS text", *names)


def test_entropy_of_empty_texts_agrees_with_sql(spark, tmp_path):
    _agrees_on_empty_texts(spark, tmp_path, "entropy", "block_profile", "entropy_gate")


def test_sampled_entropy_of_empty_texts_agrees_with_sql(spark, tmp_path):
    _agrees_on_empty_texts(spark, tmp_path, "sample_entropy")


def test_scores_of_empty_texts_agree_with_sql(spark, tmp_path):
    names = ["score_candidates", "ranked_findings", "scored_unknown", "rejection_histogram", "session_totals", "category_counts"]
    _agrees_on_empty_texts(spark, tmp_path, *names)


def test_items_without_a_place_cover_nothing(spark, tmp_path):
    missing = "CASE WHEN l_orderkey % 40 = 3 THEN NULL ELSE l_quantity END AS l_quantity, CASE WHEN l_orderkey % 50 = 7 THEN NULL ELSE l_partkey END AS l_partkey"
    _agree_with(spark, tmp_path, "lineitem", missing, "extent_gaps", "coverage_report", "merge_extents")


def test_sound_certificates_read_as_all_others_do(spark):
    first = cl.shape_orders(spark.read.parquet(f"{SF}/orders.parquet")).select("certificate_json").first()[0]
    doc = json.loads(first)
    odd = ["", "x", "a'b", 'q"r', "b\\c", "é😀 \x7f", "tab\t", "}", ',"signature":{}', '"operator_id":"z"', None, 0, -1, 1.5, 10**15, 10**16, 2**53, True, [], ["n"], {}, "2024-02-30T00:00:00Z", "2024-01-01T00:00:00Z\n", "Purge", "N/A", "BLKDISCARD", "zero", "sha256:" + "a" * 64, "A" * 79, "A" * 80 + "==", "A=" * 50]
    paths = [(*parent, name) for parent, names in [((), [*doc, "notes", "extra"]), *[((k,), [*doc[k], *more]) for k, more in {
        "device": ["model", "sector_size", "serial_number"], "issuer": ["x"], "result": ["errors", "verification"], "tool": ["os_kernel"], "wipe": ["passes", "pattern"], "signature": ["signed_payload_hash"]}.items()]] for name in names]
    docs = [first]
    for path in paths:
        for value in [..., *odd]:
            made = json.loads(first)
            at = made if len(path) == 1 else made[path[0]]
            at.pop(path[-1], None) if value is ... else at.update({path[-1]: value})
            text = json.dumps(made, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            docs.append(text)
            if value in (..., "x", "zero", 0):
                docs += [json.dumps(made), json.dumps(made, separators=(",", ":"), ensure_ascii=False)]
    compact = docs[1]
    docs += [first + " ", first + "}", first + "x", " " + first, first[:-1], first + "\n", first.replace(":1,", ":01,"), first.replace(":1,", ":-0,"), first.replace(":1,", ":1e0,"), first.replace('"name":', '"name":"a","name":'), first.replace("{", "{ "), compact, "", "[]", "null", None]
    rows = spark.createDataFrame(list(enumerate(docs)), "i int, certificate_json string")
    names = ("$.issuer.operator_id", "$.issuer.organization", "$.device.device_id", "$.cert_uuid", "$.issued_at", "$.signature.public_key_fingerprint", "$.signature.signature_base64url", "$.signature.signed_payload_hash")

    def told(df):
        read = ct.validate_certificates(ct.with_payload(df, "payload"))
        return {r.i: r for r in read.select("i", "errors", "payload", *[ct.member(n).alias(n[2:].replace(".", "_")) for n in names]).collect()}

    quick = ct.parsed(rows)
    assert told(quick) == told(rows.withColumn("__sound", F.lit(False)))
    assert quick.where("__sound").count() > 100
    chain = cl._orders(spark, SF)
    assert ct.parsed(chain).where("NOT __sound").count() == 0
