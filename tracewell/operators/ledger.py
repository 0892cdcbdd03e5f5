"""Hash-chained ledgers: linking, row checks, trust, checkpoints, the verdict per chain, and appending.

A block's hash covers its own columns and the stored previous hash, so every check but appending is
row-parallel: chains are never walked, and one chain of millions of blocks spreads over the cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.canonical import MAX_EXACT, block_hash, json_quote, payload_sha256
from tracewell.operators.certificates import member, parsed, validate_certificates, with_payload
from tracewell.plans.joins import lookup
from tracewell.session import cut_lineage, shuffle_width

#: Tasks that the blocks of one key are dealt over.
_SALT = 64

# The genesis link and marker, and the fingerprint of the public demonstration key.
GENESIS_PREV = "0" * 64
GENESIS_SIGNATURE = "GENESIS_BLOCK_SIGNATURE"
DEMO_FINGERPRINT = "sha256:8396af8c07a7d40f98ba492cf2b61e23fa768e66a9f627b02a9caff464e48c06"

BLOCK_SCHEMA = T.StructType(
    [T.StructField("chain_id", T.StringType()), T.StructField("block_index", T.LongType())]
    + [
        T.StructField(name, T.StringType())
        for name in (
            "timestamp", "operation_type", "target_id", "operator_id", "organization", "cert_uuid", "payload_hash",
            "signature", "prev_hash", "block_hash", "certificate_json", "block_signature",
        )
    ]
)

#: ``verify(message, signature, fingerprint) -> boolean column``, supplied by the caller. An empty
#: fingerprint means the block names no key, so any trusted key may have signed it.
VerifyFn = Callable[[Column, Column, Column], Column]


def ledger_page(blocks: DataFrame, operation_type: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Blocks in index order, optionally of one operation type, one page at a time."""
    rows = blocks if operation_type is None else blocks.where(F.col("operation_type") == operation_type)
    ordered = rows.orderBy("chain_id", "block_index")
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def link_ledger(blocks: DataFrame) -> DataFrame:
    """Each block with ``expected_prev``, the hash its link must name, and ``has_gap``.

    Index 0 links to the genesis value; a block whose predecessor is absent, or that repeats an index,
    has a gap. The lookup is an equi-join on ``(chain_id, block_index)``.
    """
    ahead = blocks.groupBy("chain_id", (F.col("block_index") + 1).alias("block_index")).agg(
        F.min("block_hash").alias("__prev")
    )
    # Indexes are unique in a sound ledger; this window only orders accidental repeats.
    repeat = F.row_number().over(Window.partitionBy("chain_id", "block_index").orderBy("block_hash"))
    joined = blocks.withColumn("__repeat", repeat).join(ahead, ["chain_id", "block_index"], "left")
    first = F.col("block_index") == 0
    gap = (F.col("__repeat") > 1) | (~first & F.col("__prev").isNull()) | (F.col("block_index") < 0)
    expected = F.when(first, F.lit(GENESIS_PREV)).otherwise(F.col("__prev"))
    return joined.select(*blocks.columns, expected.alias("expected_prev"), gap.alias("has_gap"))


def _member(path: str) -> Column:
    return F.get_json_object("certificate_json", path)


def crosscheck(blocks: DataFrame, out: str = "row_mismatch") -> DataFrame:
    """First disagreement between row columns and the embedded document; only fields the document has."""
    if "__sound" not in blocks.columns:
        return crosscheck(parsed(blocks), out).drop("__sound")
    pairs = [
        ("operator_id", "$.issuer.operator_id"),
        ("organization", "$.issuer.organization"),
        ("target_id", "$.device.device_id"),
        ("cert_uuid", "$.cert_uuid"),
        ("timestamp", "$.issued_at"),
    ]
    checks = []
    for column, path in pairs:
        stated = member(path)
        text = F.concat(
            F.lit(f"{column} '"), F.coalesce(F.col(column), F.lit("None")), F.lit("' != certificate '"), stated, F.lit("'.")
        )
        checks.append(F.when(stated.isNotNull() & ~F.col(column).eqNullSafe(stated), text))
    return blocks.withColumn(out, F.coalesce(*checks))


def trust(blocks: DataFrame, keys: DataFrame, out: str = "key_trusted") -> DataFrame:
    """Whether the key fingerprint a block claims is in the trusted set; a block that claims none passes."""
    claimed = F.coalesce(_member("$.signature.public_key_fingerprint"), F.lit(""))
    trusted = keys.select(F.col("fingerprint").alias("claimed_fp"), F.lit(True).alias("__t")).distinct()
    # A handful of keys sign everything, so the blocks of one key are dealt over many tasks.
    joined = lookup(blocks.withColumn("claimed_fp", claimed), trusted, ["claimed_fp"], F.xxhash64(*blocks.columns), _SALT)
    return joined.withColumn(out, F.coalesce("__t", F.lit(False)) | (F.col("claimed_fp") == "")).drop("__t")


def checkpoint_check(tips: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Compare each chain's tip with its highest checkpoint.

    ``tips`` is ``(chain_id, tip_index, tip_hash)``. ``checkpoints`` may hold several rows per chain
    (the ledger's own and the signed sidecar); the highest index counts. Adds ``checkpoint_reason``
    (truncation or mismatch) and ``checkpoint_warning`` (absent or unsigned).
    """
    signed = F.coalesce(F.col("signature"), F.lit("")) != ""
    best = checkpoints.groupBy("chain_id").agg(
        F.max_by(F.struct(F.col("tip_index").alias("i"), F.col("tip_hash").alias("h")), "tip_index").alias("cp"),
        F.bool_or(signed).alias("__signed"),
    )
    joined = tips.join(best, "chain_id", "left")
    at, want = F.col("cp.i"), F.col("cp.h")
    truncated = F.concat(
        F.lit("Ledger truncation detected: checkpoint recorded tip block #"), at.cast("string"),
        F.lit(", but ledger only contains "), (F.col("tip_index") + 1).cast("string"), F.lit(" blocks (tip #"),
        F.col("tip_index").cast("string"), F.lit(")."),
    )
    differs = F.concat(
        F.lit("Ledger tip mismatch: checkpoint recorded tip hash "), want, F.lit(", but ledger tip is "), F.col("tip_hash"),
        F.lit("."),
    )
    reason = F.when(F.col("tip_index") < at, truncated).when(
        (F.col("tip_index") == at) & (want != "") & (want != F.col("tip_hash")), differs
    )
    warning = F.when(
        F.col("__signed").isNull(), F.lit("Checkpoint is absent: tail truncation could not be ruled out.")
    ).when(~F.col("__signed"), F.lit("Checkpoint carries no signature: tail truncation could not be ruled out."))
    return joined.select(
        *tips.columns, at.alias("checkpoint_index"), reason.alias("checkpoint_reason"), warning.alias("checkpoint_warning")
    )


def _number(prefix: str, rest: str | Column) -> Column:
    tail = F.lit(rest) if isinstance(rest, str) else rest
    return F.concat(F.lit(prefix), F.col("block_index").cast("string"), tail)


def _row_verdicts(blocks: DataFrame, verify: VerifyFn | None) -> DataFrame:
    """What each block says about itself, reduced to a narrow row before anything is shuffled.

    ``hash_problem`` is the recomputed-hash check, ``late_problem`` everything between key trust and
    the document's own signature, ``signature_problem`` that signature.
    """
    rows = validate_certificates(crosscheck(with_payload(parsed(blocks), "__payload"))).select(
        "*",
        block_hash().alias("__computed"),
        F.coalesce(member("$.signature.public_key_fingerprint"), F.lit("")).alias("claimed_fp"),
        F.coalesce(member("$.signature.signature_base64url"), F.lit("")).alias("__doc_signature"),
        F.coalesce(member("$.signature.signed_payload_hash"), F.lit("")).alias("__stated"),
    ).withColumn("__payload_hash", F.replace(payload_sha256(F.col("__payload.text")), F.lit("sha256:"), F.lit("")))
    genesis = F.col("operation_type") == "GENESIS"
    has_doc = F.coalesce(F.col("certificate_json") != "", F.lit(False)) & ~genesis
    signature = F.coalesce(F.col("block_signature"), F.lit(""))
    signed = ~genesis & (signature != "") & (signature != GENESIS_SIGNATURE)
    computed, payload_hash = F.col("__computed"), F.col("__payload_hash")
    late = [
        (
            has_doc & ~signed & (F.col("__doc_signature") != ""),
            _number("Block #", " is unsigned: missing required Ed25519 block_signature for signed certificate."),
        ),
        (has_doc & F.array_contains("errors", "certificate is not valid JSON"), _number("Malformed certificate in block #", ": not valid JSON")),
        (
            has_doc & F.col("row_mismatch").isNotNull(),
            _number("Ledger row and certificate mismatch in block #", F.concat(F.lit(": "), F.col("row_mismatch"))),
        ),
        (
            has_doc & (F.size("errors") > 0),
            _number("Invalid certificate structure in block #", F.concat(F.lit(": "), F.array_join("errors", "; "))),
        ),
        (
            has_doc & F.col("__payload.error").isNotNull(),
            _number("Malformed certificate in block #", F.concat(F.lit(": "), F.col("__payload.error"))),
        ),
        (
            has_doc & ~F.col("payload_hash").eqNullSafe(payload_hash),
            _number(
                "Payload tampering detected in block #",
                F.concat(F.lit(": recomputed "), payload_hash, F.lit(" != stored "), F.coalesce("payload_hash", F.lit("None"))),
            ),
        ),
    ]
    own = [
        (
            has_doc & (F.col("__stated") != "") & (F.replace(F.col("__stated"), F.lit("sha256:"), F.lit("")) != payload_hash),
            _number("Certificate signature invalid in block #", ": signed_payload_hash mismatch"),
        )
    ]
    if verify is not None:
        block_ok = F.coalesce(verify(F.col("block_hash"), signature, F.col("claimed_fp")), F.lit(False))
        doc_ok = F.coalesce(verify(F.col("__payload.text"), F.col("__doc_signature"), F.col("claimed_fp")), F.lit(False))
        forged = "Block signature tampering detected in block #"
        late.insert(0, (signed & ~block_ok, _number(forged, ": block_signature does not match block_hash under trusted public keys.")))
        own.insert(0, (has_doc & ~doc_ok, _number("Certificate signature invalid in block #", ": signature does NOT match payload")))
    hash_differs = _number(
        "Data tampering detected in block #",
        F.concat(F.lit(": recomputed hash "), F.coalesce(computed, F.lit("none")), F.lit(" != stored hash "), F.col("block_hash"), F.lit(".")),
    )
    return rows.select(
        "chain_id", "block_index", "prev_hash", "block_hash", "claimed_fp", signed.alias("__signed"), has_doc.alias("__has_doc"),
        F.when(~computed.eqNullSafe(F.col("block_hash")), hash_differs).alias("hash_problem"),
        F.coalesce(*[F.when(bad, why) for bad, why in late]).alias("late_problem"),
        F.coalesce(*[F.when(bad, why) for bad, why in own]).alias("signature_problem"),
    )


def block_failures(blocks: DataFrame, keys: DataFrame, verify: VerifyFn | None = None) -> DataFrame:
    """``(chain_id, block_index, block_hash, claimed_fp, failure)``: the first check each block fails, or null.

    Order: gap, link, hash, key trust, block signature, missing signature, row/document mismatch,
    document structure, payload hash, document signature. A gap's expected index is filled in per
    chain by :func:`verify_ledger`. Documents are examined where the blocks are read; only digests
    and verdicts are shuffled for the link and trust joins.
    """
    rows = link_ledger(_row_verdicts(blocks, verify))
    trusted = keys.select(F.col("fingerprint").alias("claimed_fp"), F.lit(True).alias("__t")).distinct()
    rows = lookup(rows, trusted, ["claimed_fp"], F.xxhash64("chain_id", "block_index"), _SALT)
    untrusted = ~F.coalesce("__t", F.lit(False)) & (F.col("claimed_fp") != "")
    key_text = F.concat(F.lit(" was signed with key fingerprint '"), F.col("claimed_fp"), F.lit("' which is not in the trusted key set."))
    failure = (
        F.when(F.col("has_gap"), F.lit("gap"))
        .when(
            ~F.col("prev_hash").eqNullSafe(F.col("expected_prev")),
            _number("Hash chain broken at block #", ": prev_hash does not match previous block hash."),
        )
        .when(F.col("hash_problem").isNotNull(), F.col("hash_problem"))
        .when(F.col("__signed") & untrusted, _number("Block #", key_text))
        .when(F.col("late_problem").isNotNull(), F.col("late_problem"))
        .when(
            F.col("__has_doc") & untrusted,
            _number("Certificate signature invalid in block #", F.concat(F.lit(": unknown issuer key fingerprint "), F.col("claimed_fp"))),
        )
        .otherwise(F.col("signature_problem"))
    )
    return rows.select("chain_id", "block_index", "block_hash", "claimed_fp", failure.alias("failure"))


def chain_tips(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("chain_id").agg(
        F.max("block_index").alias("tip_index"), F.max_by("block_hash", "block_index").alias("tip_hash")
    )


def verify_ledger(
    blocks: DataFrame, keys: DataFrame, checkpoints: DataFrame, verify: VerifyFn | None = None, demo_key: str = DEMO_FINGERPRINT
) -> DataFrame:
    """One verdict per chain; ``demo_key`` is the fingerprint whose signatures count as demonstrations.

    Without a trusted key, or without a ``verify`` function to check signatures, a chain can never be
    valid: it is UNVERIFIABLE. Blocks before the first failure count as verified.
    """
    failures = block_failures(blocks, keys, verify)
    # One row per chain, read twice below; the block checks behind it must run once.
    per_chain = failures.groupBy("chain_id").agg(
        F.count("*").alias("blocks"),
        F.min(F.when(F.col("failure").isNotNull(), F.struct(F.col("block_index").alias("at"), "failure"))).alias("first"),
        F.max("block_index").alias("tip_index"),
        F.max_by("block_hash", "block_index").alias("tip_hash"),
        F.bool_or(F.col("claimed_fp") == demo_key).alias("is_demo_signed"),
    )
    checked = checkpoint_check(cut_lineage(per_chain), checkpoints)
    # Blocks in front of the first failure are contiguous from 0, so a gap's expected index is the
    # number of distinct indexes below it (or one more, when the block repeats an index).
    gaps = checked.where(F.col("first.failure") == "gap").select("chain_id", F.col("first.at").alias("__at"))
    before = (
        blocks.select("chain_id", "block_index")
        .join(gaps, "chain_id")
        .groupBy("chain_id")
        .agg(
            F.countDistinct(F.when(F.col("block_index") < F.col("__at"), F.col("block_index"))).alias("__below"),
            F.count_if(F.col("block_index") == F.col("__at")).alias("__same"),
        )
    )
    rows = checked.join(before, "chain_id", "left")
    failure, at = F.col("first.failure"), F.col("first.at")
    repeat = (F.col("__same") > 1) & (F.col("__below") == at)
    expected = F.when(repeat, at + 1).otherwise(F.col("__below"))
    gap_text = F.concat(
        F.lit("Block sequence gap detected: expected index "), expected.cast("string"), F.lit(", found "), at.cast("string"), F.lit(".")
    )
    no_key = F.lit(keys.isEmpty())
    unverifiable = F.lit("UNVERIFIABLE: no trusted issuer key is available, so no signature in this ledger can be checked.")
    unchecked = F.lit("UNVERIFIABLE: no signature verifier was supplied, so no signature in this ledger was checked.")
    reason = (
        F.when(no_key, unverifiable)
        .when(failure == "gap", gap_text)
        .when(failure.isNotNull(), failure)
        .when(F.col("checkpoint_reason").isNotNull(), F.col("checkpoint_reason"))
    )
    if verify is None:
        reason = reason.otherwise(unchecked)
    valid = reason.isNull()
    verified = (
        F.when(no_key, F.lit(0))
        .when(failure == "gap", expected)
        .when(failure.isNotNull(), at)
        .otherwise(F.col("blocks"))
    )
    broken = F.when(no_key, F.lit(None)).when(failure.isNotNull(), at).when(
        F.col("checkpoint_reason").isNotNull(), F.col("tip_index")
    )
    passed = F.concat(F.lit("Hash-chained audit chain verified successfully across "), F.col("blocks").cast("string"), F.lit(" blocks."))
    return rows.select(
        "chain_id",
        valid.alias("is_valid"),
        verified.cast("long").alias("blocks_verified"),
        broken.cast("long").alias("broken_block_index"),
        F.coalesce(reason, passed).alias("reason"),
        F.when(valid, F.col("checkpoint_warning")).alias("checkpoint_warning"),
        (valid & F.coalesce("is_demo_signed", F.lit(False))).alias("is_demo_signed"),
    )


def _chain_hashes(batches: Iterator[pa.RecordBatch], tipped: bool) -> Iterator[pa.RecordBatch]:
    """Number and hash rows that arrive grouped by chain and in order; only the tip is remembered.

    Columns that are merely carried along are never turned into Python values.
    """
    chain, prev, index = object(), GENESIS_PREV, -1
    for batch in batches:
        indexes, prevs, hashes = [], [], []
        chains, heads, tails = (batch.column(c).to_pylist() for c in ("chain_id", "__head", "__tail"))
        tips = zip(*(batch.column(c).to_pylist() for c in ("__tip_index", "__tip_hash"))) if tipped else repeat((-1, GENESIS_PREV))
        for chain_id, head, tail, tip in zip(chains, heads, tails, tips):
            if chain_id != chain:
                chain = chain_id
                index, prev = tip
            index += 1
            if index > MAX_EXACT:
                raise ValueError(f"block index {index} is beyond the exact integer range")
            digest = hashlib.sha256(f'{{"block_index":{index}{head}"{prev}"{tail}'.encode()).hexdigest()
            indexes.append(index)
            prevs.append(prev)
            hashes.append(digest)
            prev = digest
        kept = [name for name in batch.schema.names if not name.startswith("__")]
        text = batch.schema.field("chain_id").type
        made = [pa.array(indexes, pa.int64()), pa.array(prevs, text), pa.array(hashes, text)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "block_index", "prev_hash", "block_hash"])


def append_blocks(
    ledger: DataFrame | None, docs: DataFrame, order: list[str], sign: Callable[[Column], Column] | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The next blocks of each chain for ``docs(chain_id, operation_type, certificate_json, <order>)``.

    Linking is sequential inside a chain by definition. Rows are partitioned by chain and sorted, and
    a streaming pass keeps nothing but the current tip, so a long chain needs time but no memory.
    Everything except the link itself is rendered as columns beforehand. A caller that needs only some columns of the
    blocks, or further ones of ``docs``, names them in ``keep``, and the documents stay out of the shuffle.
    """
    text = {
        "timestamp": ("$.issued_at", None),
        "operator_id": ("$.issuer.operator_id", "unknown-operator"),
        "organization": ("$.issuer.organization", "unknown-org"),
        "target_id": ("$.device.device_id", "target-unknown"),
        "cert_uuid": ("$.cert_uuid", "00000000-0000-0000-0000-000000000000"),
        "signature": ("$.signature.signature_base64url", "unsigned"),
    }
    linked = ["chain_id", "block_index", "prev_hash", "block_hash"]
    names = [f.name for f in BLOCK_SCHEMA.fields if f.name != "block_signature"] if keep is None else [n for n in keep if n != "block_signature"]
    made = {"chain_id", "operation_type", "certificate_json", "payload_hash", *text, *linked}
    fields = with_payload(parsed(docs), "__payload").select(
        F.col("chain_id").cast("string").alias("chain_id"), "operation_type", "certificate_json", F.struct(*order).alias("__order"),
        *[n for n in names if n not in made],
        *[F.coalesce(member(path), F.lit(default) if default is not None
                     else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias(name)
          for name, (path, default) in text.items()],
        payload_sha256(F.col("__payload.text")).alias("__hash"), member("$.signature.signed_payload_hash").alias("__stated"),
    )
    hashed = F.coalesce("__hash", "__stated", F.lit("sha256:" + "0" * 64))
    fields = fields.withColumn("payload_hash", F.replace(hashed, F.lit("sha256:"), F.lit(""))).drop("__hash", "__stated")

    def quoted(name: str) -> Column:
        return F.concat(F.lit(f',"{name}":'), json_quote(F.col(name)))

    # Canonical key order: block_index, ..., payload_hash, prev_hash, signature, target_id, timestamp.
    head = F.concat(
        *[quoted(n) for n in ("cert_uuid", "operation_type", "operator_id", "organization", "payload_hash")], F.lit(',"prev_hash":')
    )
    tail = F.concat(*[quoted(n) for n in ("signature", "target_id", "timestamp")], F.lit("}"))
    tips = []
    if ledger is not None:
        fields = fields.join(chain_tips(ledger), "chain_id", "left")
        tips = [F.coalesce("tip_index", F.lit(-1)).cast("long").alias("__tip_index"), F.coalesce("tip_hash", F.lit(GENESIS_PREV)).alias("__tip_hash")]
    ordered = fields.repartition(shuffle_width(docs), "chain_id").sortWithinPartitions("chain_id", "__order")
    carried = list(dict.fromkeys(["chain_id", *[n for n in names if n not in linked]]))
    # Heads and tails repeat other columns, so they are rendered where the rows arrive.
    ready = ordered.select(*carried, *tips, head.alias("__head"), tail.alias("__tail"))
    types_ = {f.name: f for f in [*docs.schema.fields, *BLOCK_SCHEMA.fields]}
    schema = T.StructType([T.StructField(n, types_[n].dataType) for n in [*carried, "block_index", "prev_hash", "block_hash"]])
    tipped = bool(tips)
    chained = ready.mapInArrow(lambda batches: _chain_hashes(batches, tipped), schema).select(*names)
    if keep is not None and "block_signature" not in keep:
        return chained
    signature = sign(F.col("block_hash")) if sign is not None else F.lit("")
    return chained.withColumn("block_signature", signature)
