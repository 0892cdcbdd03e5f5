"""Canonical JSON, certificates, ledgers, hash lists, bodyfiles and sessions."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewell.functions import canonical as cj
from tracewell.functions import text
from tracewell.operators import certificates as ct
from tracewell.operators import ledger as lg
from tracewell.operators import sampling, sessions
from tracewell.operators.fragments import sample_table_check
from tracewell.sources import hashlists, signatures, tables

CERT = {
    "schema_version": "1.0.0", "cert_uuid": "6da82f40-ba63-4f06-a2bd-fb7bee6e715a", "issued_at": "2026-01-01T00:00:00Z",
    "issuer": {"organization": "Lab", "operator_id": "op"}, "tool": {"name": "t", "version": "1", "platform": "linux"},
    "device": {"device_id": "d", "device_type": "image_file", "storage_type": "SSD", "capacity_bytes": 10},
    "wipe": {"method": "OVERWRITE_ZERO_1PASS", "nist_category": "Clear", "start_time": "2026-01-01T00:00:00Z", "end_time": "2026-01-01T00:00:00Z", "bytes_processed": 1},
    "result": {"status": "success"},
    "signature": {"algorithm": "Ed25519", "public_key_fingerprint": "sha256:" + "a" * 64, "signature_base64url": "A" * 86},
}


def edited(path: str, value=None, drop: bool = False) -> dict:
    doc = json.loads(json.dumps(CERT))
    *parents, last = path.split(".")
    node = doc
    for p in parents:
        node = node[p]
    if drop:
        del node[last]
    else:
        node[last] = value
    return doc


MUTATIONS = [
    (CERT, []),
    (edited("schema_version", "2"), ["schema_version must be '1.0.0'"]),
    (edited("cert_uuid", "X"), ["cert_uuid: not a lowercase UUID"]),
    (edited("extra", 1), [": unexpected fields ['extra']"]),
    (edited("issuer.operator_id", drop=True), ["issuer: missing ['operator_id']", "issuer.operator_id: non-empty string required"]),
    (edited("issuer", "x"), ["issuer: must be a JSON object"]),
    (edited("tool.platform", "beos"), ["tool.platform: invalid"]),
    (edited("device.capacity_bytes", True), ["device.capacity_bytes: must be a non-negative integer"]),
    (edited("device.capacity_bytes", 1.5), ["device.capacity_bytes: must be a non-negative integer", "$.device.capacity_bytes: float values are forbidden in schema v1"]),
    (edited("device.sector_size", 0), ["device.sector_size: must be a positive integer (minimum 1)"]),
    (edited("wipe.passes", 0), ["wipe.passes: must be an integer >= 1"]),
    (edited("wipe.nist_category", "Destroy"), ["wipe.nist_category 'Destroy' exceeds the tier permitted for method 'OVERWRITE_ZERO_1PASS' per the NIST mapping registry"]),
    (edited("result.verification", {"confidence_percent": 101, "attestation": 3}), ["result.verification.confidence_percent: must be 0-100", "result.verification.attestation: string"]),
    (edited("result.verification", 3), ["result.verification: must be an object"]),
    (edited("notes", ["a", 1]), ["notes: array of strings"]),
    (edited("notes", []), []),
    (edited("signature.signature_base64url", "short"), ["signature.signature_base64url: not a plausible base64url signature"]),
    (edited("signature", drop=True), ["signature: required object"]),
    ([1], ["certificate must be a JSON object"]),
]


def test_certificate_mutations(spark):
    rows = [(i, json.dumps(doc)) for i, (doc, _) in enumerate(MUTATIONS)]
    df = spark.createDataFrame(rows, "i int, certificate_json string")
    got = {r.i: list(r.errors) for r in ct.validate_certificates(df).collect()}
    for i, (_, want) in enumerate(MUTATIONS):
        assert got[i] == want, MUTATIONS[i][0]


def test_canonical_json(spark):
    docs = ['{"b":1,"a":[true,null,{"z":"é","y":"\\u001f\\n"}]}', '{"a":1.0}', '{"a":9007199254740992}', "[" * 70 + "]" * 70, "nope"]
    got = [r.c for r in spark.createDataFrame([(d,) for d in docs], "d string").select(cj.canonicalize("d").alias("c")).collect()]
    assert got[0].text == '{"a":[true,null,{"y":"\\u001f\\n","z":"é"}],"b":1}'
    assert [g.text for g in got[1:]] == [None] * 4 and all(g.error for g in got[1:])


def test_quoting_equals_the_contract_for_every_control_character(spark):
    samples = ["".join(chr(c) for c in range(0x20)), 'a"b\\c', "\\u000B\x0b\\\\u001F\x1f", "", "é\u2028\x7f", "\x00"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r.i: r.q for r in df.select("i", cj.json_quote(F.col("s")).alias("q")).collect()}
    assert got == {i: json.dumps(s, ensure_ascii=False) for i, s in enumerate(samples)}


def _sign(message, fingerprint):
    return F.sha2(F.concat(fingerprint, message), 256)


def _chain(spark, n=5):
    docs = []
    for i in range(n):
        doc = edited("cert_uuid", f"6da82f40-ba63-4f06-a2bd-fb7bee6e7{i:03x}")
        docs.append(("c", "DRIVE_ERASE", json.dumps(doc), i))
    df = spark.createDataFrame(docs, "chain_id string, operation_type string, certificate_json string, at int")
    fp = F.lit(CERT["signature"]["public_key_fingerprint"])
    return lg.append_blocks(None, df, ["at"], sign=lambda h: _sign(h, fp))


def _verify(message, signature, fingerprint):
    # Document signatures of the fixture are placeholders; only block signatures are keyed digests.
    # A block that claims no key may be signed by any trusted one; the fixture has a single key.
    key = F.when(fingerprint == "", F.lit(CERT["signature"]["public_key_fingerprint"])).otherwise(fingerprint)
    return (signature == F.lit("A" * 86)) | (signature == _sign(message, key))


@pytest.fixture(scope="module")
def chain(spark):
    rows = [r.asDict() for r in _chain(spark).collect()]
    return sorted(rows, key=lambda r: r["block_index"])


def _reports(spark, chains, keys=("sha256:" + "a" * 64,), verify=_verify, checkpoints=()):
    """One verdict per named chain, from a single run."""
    rows = [tuple({**r, "chain_id": name}[f.name] for f in lg.BLOCK_SCHEMA) for name, chain in chains.items() for r in chain]
    blocks = spark.createDataFrame(rows, lg.BLOCK_SCHEMA)
    trusted = spark.createDataFrame([(k,) for k in keys], "fingerprint string")
    pins = spark.createDataFrame(list(checkpoints), "chain_id string, tip_index long, tip_hash string, signature string")
    return {r.chain_id: r for r in lg.verify_ledger(blocks, trusted, pins, verify).collect()}


def test_fails_closed(spark, chain):
    assert _reports(spark, {"c": chain}, keys=())["c"].reason.startswith("UNVERIFIABLE")
    r = _reports(spark, {"c": chain}, verify=None)["c"]
    assert not r.is_valid and r.reason.startswith("UNVERIFIABLE")
    assert "not in the trusted key set" in _reports(spark, {"c": chain}, keys=("sha256:" + "b" * 64,))["c"].reason


def _with(chain, index, **change):
    return [{**r, **change} if r["block_index"] == index else r for r in chain]


def test_tampering(spark, chain):
    doc = chain[1]["certificate_json"]
    cases = {
        "edit": (_with(chain, 2, operator_id="x"), 2, "Data tampering"),
        "link": (_with(chain, 2, prev_hash="0" * 64), 2, "Hash chain broken"),
        "gap": ([r for r in chain if r["block_index"] != 2], 3, "expected index 2, found 3"),
        "repeat": (chain + [chain[1]], 1, "expected index 2, found 1"),
        "forged": (_with(chain, 3, block_signature="forged"), 3, "Block signature tampering"),
        "unsigned": (_with(chain, 3, block_signature=""), 3, "is unsigned"),
        "malformed": (_with(chain, 1, certificate_json="{"), 1, "Malformed"),
        "mismatch": (_with(chain, 1, certificate_json=doc.replace('"Lab"', '"Other"')), 1, "organization"),
        "payload": (_with(chain, 1, certificate_json=doc.replace('"success"', '"partial"')), 1, "Payload tampering"),
        "truncated": (chain[:3], 2, "truncation"),
        "replaced": (chain, 4, "mismatch"),
    }
    pins = [("truncated", 4, "", "s"), ("replaced", 4, "zz", "s"), ("sound", 4, chain[4]["block_hash"], "s")]
    chains = {name: rows for name, (rows, _, _) in cases.items()}
    got = _reports(spark, {**chains, "sound": chain, "unpinned": chain}, checkpoints=pins)
    for name, (_, index, reason) in cases.items():
        assert not got[name].is_valid and got[name].broken_block_index == index and reason in got[name].reason, got[name]
    assert got["sound"].is_valid and got["sound"].blocks_verified == 5 and got["sound"].checkpoint_warning is None
    assert got["unpinned"].is_valid and got["unpinned"].checkpoint_warning


def test_append_continues_an_existing_ledger(spark, chain):
    ledger = spark.createDataFrame([tuple(r[f.name] for f in lg.BLOCK_SCHEMA) for r in chain], lg.BLOCK_SCHEMA)
    doc = json.dumps(edited("cert_uuid", "6da82f40-ba63-4f06-a2bd-fb7bee6effff"))
    more = spark.createDataFrame([("c", "DRIVE_ERASE", doc, 9)], "chain_id string, operation_type string, certificate_json string, at int")
    new = lg.append_blocks(ledger, more, ["at"]).first()
    assert new.block_index == 5 and new.prev_hash == chain[4]["block_hash"]


def test_hash_list_shapes(spark, tmp_path):
    md5, sha = "d" * 32, "A" * 64
    lines = [md5, f"SHA-256,\"{sha}\",x.txt", f"{sha}  file name", f"sha1,{md5}", "MD5,,", "zzz", "ab", "# c", "", f"{md5},foo"]
    (tmp_path / "l.txt").write_text("\n".join(lines) + "\n")
    known, skipped = hashlists.read_hash_list(spark, str(tmp_path / "l.txt"))
    assert {(r.algo, r.digest) for r in known.collect()} == {("md5", md5), ("sha256", sha.lower())}
    assert {(r.reason, r.n) for r in skipped.collect()} == {
        ("sha1 digest of the wrong length", 1), ("NSRL row with no digest field", 1), ("unparseable line", 1), ("digest of unrecognised length 2", 1)
    }
    (tmp_path / "e.txt").write_text("zzz\n")
    with pytest.raises(ValueError):
        hashlists.read_hash_list(spark, str(tmp_path / "e.txt"))
    assert hashlists.hash_directory(spark, str(tmp_path), ["SHA-256", "md5"]).count() == 4


def test_bodyfiles(spark, tmp_path):
    (tmp_path / "a").write_text("# x\n0 9\n\n10 19 # t\nbad row\n50 60\n5\n")
    (tmp_path / "b").write_text("55 70\n")
    out = str(tmp_path / "out")
    assert tables.merge_bodyfiles(spark, [str(tmp_path / "a"), str(tmp_path / "b")], out) == (2, 41)
    assert [r.value for r in spark.read.text(out).collect()][-2:] == ["0 19", "50 70"]


def test_sessions(spark, tmp_path):
    doc = {"format": "carve-session", "version": 1, "target_path": "img", "target_size": 5, "fingerprint": "f", "entries": [
        {"offset": 1, "length": 2, "sha256": "s", "extension": "png", "recovered_path": "p"}, {"offset": "x", "length": 1}]}
    (tmp_path / "ok.json").write_text(json.dumps(doc))
    (tmp_path / "new.json").write_text(json.dumps({**doc, "version": 9}))
    found, entries = tables.read_sessions(spark, str(tmp_path / "ok.json"))
    assert found.first().target_size == 5 and [r.offset for r in entries.collect()] == [1]
    with pytest.raises(PySparkException):
        tables.read_sessions(spark, str(tmp_path / "new.json"))[0].collect()
    tables.write_sessions(found, entries, str(tmp_path / "store"))
    images = spark.createDataFrame([("img", 6, "f")], "image_id string, size long, fingerprint string")
    held = found.withColumnRenamed("target_path", "image_id")
    with pytest.raises(PySparkException):
        sessions.check_identity(held, images).collect()
    assert sessions.check_identity(held, images.withColumn("size", F.lit(5))).count() == 1


def test_missing_ledger_reads_empty(spark, tmp_path):
    assert tables.read_ledger(spark, str(tmp_path / "none")).isEmpty()


def test_custom_signatures(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"name": "X", "header": "0x4 1 42", "footer_hex": "ff d9", "category": "odd", "extension": ".XYZ", "min_size": 0}]))
    row = signatures.signature_table(spark, str(tmp_path / "s.json")).where("is_custom").first()
    assert (bytes(row.header), bytes(row.footer), row.category, row.extension, row.min_size) == (b"\x04\x14\x02"[:0] + bytes.fromhex("004142"), b"\xff\xd9", "custom", "xyz", 1)
    assert signatures.signature_table(spark).count() == 65
    (tmp_path / "bad.json").write_text(json.dumps([{"name": "X"}]))
    with pytest.raises(PySparkException):
        signatures.signature_table(spark, str(tmp_path / "bad.json")).collect()


def test_names_and_metadata(spark):
    names = ["../../etc/passwd", "a\x01b", "...", "x" * 300, None, "C:\\dir\\..\\f.txt", "__a__"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = {r.i: r.s for r in df.select("i", text.sanitize_filename(F.col("n")).alias("s")).collect()}
    assert got == {0: "etc_passwd", 1: "a_b", 2: "unnamed", 3: "x" * 200, 4: "unnamed", 5: "C_dir_f.txt", 6: "a"}
    values = ["ok", " ", "a<b", "x" * 129, "a\x1bb", "a\u202eb", None, text.TRUSTED_ORGANISATION]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.p for r in df.select("i", text.metadata_problem(F.col("v"), "organization").alias("p")).collect()}
    assert got[0] is None and got[6] is None and got[7] is None
    assert "empty" in got[1] and "forbidden" in got[2] and "maximum" in got[3] and "U+001B" in got[4] and "U+202E" in got[5]


def test_bounds(spark):
    cases = spark.createDataFrame([(0, 64), (64, 64), (0, 0), (1, 10), (2, 10), (3, 10), (5, 10), (1, 20), (None, 5)], "k long, n long")
    got = [r.p for r in cases.select(sampling.bound_ppm(F.col("k"), F.col("n")).alias("p")).collect()]
    assert got[:3] == [45730, 1000000, 1000000] and got[8] is None
    # Tabulated one-sided 95 % limits.
    assert [round(p / 1e6, 4) for p in got[3:8]] == [0.3942, 0.5069, 0.6066, 0.7776, 0.2161]
    assert spark.range(1).select(sampling.required_sample_size(F.lit(0.95), F.lit(0.0001))).first()[0] == 29956


@pytest.mark.parametrize("confidence", [0.5, 0.9, 0.95, 0.99])
def test_exact_bound_inverts_the_binomial_sum(confidence):
    cases = [(1, 2), (1, 3), (6, 7), (1, 1000), (999, 1000), (500, 1000), (30, 40000), (3, 10**9)]
    bounds = sampling.exact_upper_bound(np.array([k for k, _ in cases]), np.array([n for _, n in cases]), confidence)
    for (k, n), p in zip(cases, bounds):
        terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
        assert sum(map(math.exp, terms)) == pytest.approx(1 - confidence, rel=1e-5)


def test_sample_offsets(spark):
    media = spark.createDataFrame(
        [("big", 1 << 49, 512), ("edge", 4097 * 512, 512), ("small", 4096, 512), ("one", 512, 512), ("tiny", 100, 512), ("none", 0, 512), ("null", None, 512)],
        "image_id string, capacity long, sector_size int",
    )
    rows = sampling.sample_offsets(media, 64, seed=3).collect()
    by = {k: sorted(r.offset for r in rows if r.image_id == k) for k in ("big", "edge", "small", "one", "tiny", "none", "null")}
    for name, capacity in (("big", 1 << 49), ("edge", 4097 * 512)):
        assert len(set(by[name])) == len(by[name]) == 64 and all(o % 512 == 0 and o < capacity for o in by[name])
    assert by["small"] == [i * 512 for i in range(8)] and by["one"] == by["tiny"] == [0]
    assert by["none"] == by["null"] == []
    again = sampling.sample_offsets(media.union(media).repartition(5), 64, seed=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    other = sampling.sample_offsets(media, 64, seed=4).where("image_id = 'big'").collect()
    assert {r.offset for r in other} != set(by["big"])
    assert sampling.sample_offsets(media, 0).count() == 0


def test_permutation_is_one_to_one_and_even():
    for size in (1, 2, 3, 5, 64, 1000, 4097):
        for key in (-7, 0, 12345678901):
            image = sampling.permuted(np.arange(size), np.full(size, size), np.full(size, key))
            assert sorted(image) == list(range(size))
    draws = 20000
    image = sampling.permuted(np.arange(draws), np.full(draws, 1 << 40), np.full(draws, 99))
    assert len(set(image)) == draws
    counts = np.bincount(image * 20 // (1 << 40), minlength=20)
    # Chi-square of 19 degrees of freedom: 43.8 is passed once in a thousand.
    assert ((counts - draws / 20) ** 2 / (draws / 20)).sum() < 43.8


def test_sample_tables(spark):
    tracks = spark.createDataFrame(
        [(1, "vide", 4, 0, 4, 1000), (2, "soun", 4, 0, 5, 1000), (3, "vide", 9, 0, None, 1000), (4, "vide", 4, 0, None, 120)],
        "track_id int, handler string, sample_count long, sample_size long, stts_count long, file_size long",
    )
    runs = spark.createDataFrame([(t, 0, 1, 2) for t in (1, 2, 3, 4)], "track_id int, run int, first_chunk int, samples_per_chunk int")
    sizes = spark.createDataFrame([(t, s, 10) for t in (1, 2, 3, 4) for s in range(1, (10 if t == 3 else 5))], "track_id int, sample int, size long")
    chunks = spark.createDataFrame([(t, c, 100 * c) for t in (1, 2, 3, 4) for c in (1, 2)], "track_id int, chunk int, offset long")
    got = {r.track_id: r.reason for r in sample_table_check(tracks, runs, sizes, chunks).collect()}
    assert got[1] is None and "stts accounts for 5" in got[2]
    assert "describes 4 samples, fewer than the 9" in got[3] and "outside" not in (got[4] or "") and "220" in got[4]
