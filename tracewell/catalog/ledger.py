"""Registered queries over ledgers and certificates built from orders: the customer is the chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog.common import table
from tracewell.functions.canonical import block_hash as hash_of_block
from tracewell.functions.canonical import canonical_payload, canonicalize
from tracewell.operators import certificates as ct
from tracewell.operators import ledger as lg
from tracewell.plans.joins import materialise
from tracewell.session import spread

_UUID = "concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))"
_METHODS = {
    "1-URGENT": ("OVERWRITE_ZERO_1PASS", "Clear"),
    "2-HIGH": ("ATA_SECURE_ERASE", "Purge"),
    "3-MEDIUM": ("BLKDISCARD", "Clear"),
    "4-NOT SPECIFIED": ("NVME_SANITIZE_BLOCK_ERASE", "Purge"),
    "5-LOW": ("SCSI_UNMAP", "Clear"),
}


def _fp(priority: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(priority, 256))


def _sign(message: Column, fingerprint: Column) -> Column:
    """A keyed digest stands in for the caller's signature scheme in these queries."""
    return F.sha2(F.concat(fingerprint, F.lit("|"), message), 256)


def _verify(message: Column, signature: Column, fingerprint: Column) -> Column:
    return signature == F.concat(_sign(message, fingerprint), F.lit("0" * 22))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_orders(spread(table(spark, sf_dir, "orders"), "o_orderkey"))


def shape_orders(orders: DataFrame) -> DataFrame:
    """A valid certificate per order, keyed by customer."""
    pick = F.col("o_orderpriority")
    method = F.coalesce(*[F.when(pick == p, F.lit(m)) for p, (m, _) in _METHODS.items()])
    tier = F.coalesce(*[F.when(pick == p, F.lit(t)) for p, (_, t) in _METHODS.items()])
    issued = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = orders.select(
        F.col("o_custkey").cast("string").alias("chain_id"), "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice",
        "o_orderpriority", issued.alias("issued"), method.alias("method"), tier.alias("tier"), _fp(pick).alias("fp"),
        F.expr(_UUID.format(h="md5(cast(o_orderkey as string))")).alias("uuid"),
    )
    payload = F.concat(
        F.lit('{"cert_uuid":"'), F.col("uuid"), F.lit('","device":{"capacity_bytes":'), F.col("o_totalprice").cast("long").cast("string"),
        F.lit(',"device_id":"disk-'), F.col("o_orderkey").cast("string"),
        F.lit('","device_type":"internal_disk","storage_type":"SSD"},"issued_at":"'), F.col("issued"),
        F.lit('","issuer":{"operator_id":"op-'), F.col("o_orderstatus"), F.lit('","organization":"Lab é"},"result":{"status":"success"},'),
        F.lit('"schema_version":"1.0.0","tool":{"name":"eraser","platform":"linux","version":"1"},"wipe":{"bytes_processed":1,"end_time":"'),
        F.col("issued"), F.lit('","method":"'), F.col("method"), F.lit('","nist_category":"'), F.col("tier"),
        F.lit('","start_time":"'), F.col("issued"), F.lit('"}}'),
    )
    with_payload = fields.withColumn("payload", payload)
    signature = F.concat(_sign(F.col("payload"), F.col("fp")), F.lit("0" * 22))
    doc = F.concat(
        F.expr("substr(payload, 1, length(payload) - 1)"),
        F.lit(',"signature":{"algorithm":"Ed25519","public_key_fingerprint":"'), F.col("fp"),
        F.lit('","signature_base64url":"'), signature, F.lit('"}}'),
    )
    return with_payload.select(
        "chain_id", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus", "fp", "payload",
        doc.alias("certificate_json"), F.lit("DRIVE_ERASE").alias("operation_type"),
    )


def _chain(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    price = F.get_json_object("certificate_json", "$.device.capacity_bytes").cast("long")
    return lg.append_blocks(None, _orders(spark, sf_dir).withColumn("price", price), ["o_orderdate", "o_orderkey"], keep=keep)


def append_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir, ["chain_id", "block_index", "cert_uuid", "payload_hash", "prev_hash", "block_hash"])


_LINKS = ["chain_id", "block_index", "operator_id", "prev_hash", "block_hash"]
_BLOCKS = [f.name for f in lg.BLOCK_SCHEMA.fields]


def _ledger(spark: SparkSession, sf_dir: str, keep: list[str] = _BLOCKS) -> DataFrame:
    """The chained ledger, signed, with tampering where an order's price says so.

    The price is embedded as the device capacity: the top prices mark rows edited after hashing, rows
    deleted, rows with a broken link, and rows whose signature is missing or wrong.
    """
    # A ledger is a stored table: every check below reads the columns it needs, none recomputes the chain.
    chained = materialise(_chain(spark, sf_dir, [*keep, "price", "fp"]))
    price = F.col("price")
    signature = F.concat(_sign(F.col("block_hash"), F.col("fp")), F.lit("0" * 22))
    return (
        chained.where(~price.between(440000, 444999))
        .withColumn("block_signature", F.when(price.between(450000, 452999), F.lit("")).when(
            price.between(455000, 457999), F.lit("forged")).otherwise(signature))
        .withColumn("operator_id", F.when(price.between(460000, 462999), F.lit("intruder")).otherwise(F.col("operator_id")))
        .withColumn("prev_hash", F.when(price.between(470000, 472999), F.lit("f" * 64)).otherwise(F.col("prev_hash")))
        .select(*keep)
    )


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all order priorities but the low one are trusted."""
    return table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select(_fp(F.col("o_orderpriority")).alias("fingerprint")).distinct()


def _keys_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(_fp(F.col("o_orderpriority")).alias("fingerprint")).distinct()


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint per well-funded customer; rich ones pin one block more than their orders."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return customers.join(orders, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").cast("string").alias("chain_id"),
        (F.col("n") - 1 + F.when(F.col("c_acctbal") > 9000, 1).otherwise(0)).cast("long").alias("tip_index"),
        F.lit("").alias("tip_hash"),
        F.when(F.col("c_acctbal") > 2000, F.lit("sig")).alias("signature"),
    )


def block_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(
        "o_orderkey", F.col("o_orderkey").alias("block_index"), F.col("o_orderpriority").alias("timestamp"), "operation_type",
        F.col("chain_id").alias("target_id"), F.col("o_orderstatus").alias("operator_id"), F.lit('Lab "é" \\').alias("organization"),
        F.col("fp").alias("cert_uuid"), F.sha2("payload", 256).alias("payload_hash"), F.lit("unsigned").alias("signature"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("prev_hash"),
    )
    return rows.select("o_orderkey", hash_of_block().alias("block_hash"))


def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = lg.link_ledger(_ledger(spark, sf_dir, _LINKS))
    return linked.select(
        "chain_id", "block_index", "has_gap", F.coalesce(F.col("prev_hash") == F.col("expected_prev"), F.lit(False)).alias("linked")
    )


def trust_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = lg.trust(_orders(spark, sf_dir), _keys(spark, sf_dir))
    return marked.groupBy("claimed_fp", "key_trusted").agg(F.count("*").alias("n"))


def checkpoint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    tips = _orders(spark, sf_dir).groupBy("chain_id").agg((F.count("*") - 1).alias("tip_index"), F.lit("t").alias("tip_hash"))
    return lg.checkpoint_check(tips, _checkpoints(spark, sf_dir)).select(
        "chain_id", "tip_index", "checkpoint_index", "checkpoint_reason", "checkpoint_warning"
    )


def ledger_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.verify_ledger(
        _ledger(spark, sf_dir), _keys_all(spark, sf_dir), _checkpoints(spark, sf_dir), _verify
    )


def ledger_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of five hundred erase operations over all chains."""
    page = lg.ledger_page(_chain(spark, sf_dir, ["chain_id", "block_index", "cert_uuid", "operation_type"]), "DRIVE_ERASE", limit=500)
    return page.select("chain_id", "block_index", "cert_uuid")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates with faults that follow from the order: status F is broken, status P overclaims."""
    doc = F.col("certificate_json")
    urgent = F.replace(doc, F.lit('"capacity_bytes":'), F.lit('"capacity_bytes":-'))
    floaty = F.replace(doc, F.lit('"bytes_processed":1'), F.lit('"bytes_processed":1.5'))
    renamed = F.replace(doc, F.lit('"operator_id"'), F.lit('"operator"'))
    purge = F.replace(doc, F.lit('"nist_category":"Clear"'), F.lit('"nist_category":"Purge"'))
    broken = F.when(F.col("o_orderpriority") == "1-URGENT", urgent).when(
        F.col("o_orderpriority") == "2-HIGH", floaty).when(F.col("o_orderpriority") == "3-MEDIUM", renamed).otherwise(doc)
    return _orders(spark, sf_dir).withColumn(
        "certificate_json", F.when(F.col("o_orderstatus") == "F", broken).when(F.col("o_orderstatus") == "P", purge).otherwise(doc)
    )


def doc_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = ct.validate_certificates(_variants(spark, sf_dir).select("o_orderkey", "certificate_json"))
    return checked.select("o_orderkey", F.array_join("errors", "; ").alias("errors"))


def method_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = _variants(spark, sf_dir)
    method, tier = F.get_json_object("certificate_json", "$.wipe.method"), F.get_json_object("certificate_json", "$.wipe.nist_category")
    shaped = doc.select(method.alias("method"), tier.alias("tier"))
    return shaped.groupBy("method", "tier", ct.tier_permitted(F.col("method"), F.col("tier")).alias("permitted")).agg(
        F.count("*").alias("n")
    )


def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rendered as JSON out of order, canonicalised, and hashed."""
    source = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.to_json(F.struct(F.col("text").alias("text"), F.struct(F.col("source").alias("s"), F.col("lang").alias("l")).alias("meta"),
                           F.col("doc_id").alias("id"))).alias("doc"),
    )
    done = source.select("doc_id", canonicalize("doc").alias("c"))
    return done.select("doc_id", F.sha2("c.text", 256).alias("sha256"), F.col("c.error").alias("error"))


def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _orders(spark, sf_dir).select("o_orderkey", canonical_payload("certificate_json").alias("c"))
    return done.select("o_orderkey", F.sha2("c.text", 256).alias("payload_hash"))


QUERIES = {
    "block_hash": block_hash,
    "append_blocks": append_blocks,
    "chain_links": chain_links,
    "trust_semi": trust_semi,
    "checkpoint_check": checkpoint_check,
    "ledger_report": ledger_report,
    "ledger_page": ledger_page,
    "doc_validation": doc_validation,
    "method_tier": method_tier,
    "canonical_documents": canonical_documents,
    "payload_hashes": payload_hashes,
}

_M = " ".join(f"WHEN '{p}' THEN '{m}'" for p, (m, _) in _METHODS.items())
_T = " ".join(f"WHEN '{p}' THEN '{t}'" for p, (_, t) in _METHODS.items())
_ORD = f"""
o AS (
  SELECT CAST(o_custkey AS VARCHAR) AS chain, o_orderkey AS k, CAST(trunc(o_totalprice) AS BIGINT) AS price, o_orderpriority AS pri,
    o_orderstatus AS st, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts, 'sha256:' || sha256(o_orderpriority) AS fp,
    {_UUID.format(h="md5(CAST(o_orderkey AS VARCHAR))")} AS uuid, CASE o_orderpriority {_M} END AS method, CASE o_orderpriority {_T} END AS tier,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders),
d AS (
  SELECT *, '{{"cert_uuid":"' || uuid || '","device":{{"capacity_bytes":' || price || ',"device_id":"disk-' || k
    || '","device_type":"internal_disk","storage_type":"SSD"}},"issued_at":"' || ts || '","issuer":{{"operator_id":"op-' || st
    || '","organization":"Lab é"}},"result":{{"status":"success"}},"schema_version":"1.0.0","tool":{{"name":"eraser","platform":"linux","version":"1"}},'
    || '"wipe":{{"bytes_processed":1,"end_time":"' || ts || '","method":"' || method || '","nist_category":"' || tier
    || '","start_time":"' || ts || '"}}}}' AS payload FROM o),
p AS (SELECT *, sha256(payload) AS ph, sha256(fp || '|' || payload) || repeat('0', 22) AS sig FROM d),
q AS (SELECT *, '{{"block_index":' || idx || ',"cert_uuid":"' || uuid || '","operation_type":"DRIVE_ERASE","operator_id":"op-' || st
    || '","organization":"Lab é","payload_hash":"' || ph || '","prev_hash":"' AS head,
    '","signature":"' || sig || '","target_id":"disk-' || k || '","timestamp":"' || ts || '"}}' AS tail FROM p),
ch AS (
  SELECT chain, idx, repeat('0', 64) AS prev, sha256(head || repeat('0', 64) || tail) AS h FROM q WHERE idx = 0
  UNION ALL
  SELECT q.chain, q.idx, ch.h, sha256(q.head || ch.h || q.tail) FROM ch JOIN q ON q.chain = ch.chain AND q.idx = ch.idx + 1),
full_ AS (SELECT q.*, ch.prev, ch.h FROM q JOIN ch USING (chain, idx))"""
_LEDGER = f"""WITH RECURSIVE {_ORD},
t AS (
  SELECT chain, idx, h, fp, k, CASE WHEN price BETWEEN 470000 AND 472999 THEN repeat('f', 64) ELSE prev END AS prev, price, head, tail, st,
    CASE WHEN price BETWEEN 450000 AND 452999 THEN 'unsigned' WHEN price BETWEEN 455000 AND 457999 THEN 'forged' ELSE 'ok' END AS bs
  FROM full_ WHERE price NOT BETWEEN 440000 AND 444999),
l AS (SELECT t.*, CASE WHEN t.idx = 0 THEN repeat('0', 64) ELSE b.h END AS want, t.idx > 0 AND b.h IS NULL AS gap
      FROM t LEFT JOIN t b ON b.chain = t.chain AND b.idx = t.idx - 1)"""

SQL = {
    "block_hash": """
SELECT o_orderkey, sha256('{"block_index":' || o_orderkey || ',"cert_uuid":"sha256:' || sha256(o_orderpriority)
  || '","operation_type":"DRIVE_ERASE","operator_id":"' || o_orderstatus || '","organization":"Lab \\"é\\" \\\\","payload_hash":"'
  || sha256(payload) || '","prev_hash":"' || sha256(CAST(o_orderkey AS VARCHAR)) || '","signature":"unsigned","target_id":"' || chain
  || '","timestamp":"' || o_orderpriority || '"}') AS block_hash
FROM (WITH """ + _ORD.split("p AS (SELECT *, sha256(payload)")[0].rstrip().rstrip(",") + """
  SELECT k AS o_orderkey, pri AS o_orderpriority, st AS o_orderstatus, chain, payload FROM d)""",
    "append_blocks": f"""WITH RECURSIVE {_ORD}
SELECT chain AS chain_id, idx AS block_index, uuid AS cert_uuid, ph AS payload_hash, prev AS prev_hash, h AS block_hash FROM full_""",
    "chain_links": _LEDGER + """
SELECT chain AS chain_id, idx AS block_index, gap AS has_gap, coalesce(prev = want, FALSE) AS linked FROM l""",
    "trust_semi": """
SELECT 'sha256:' || sha256(o_orderpriority) AS claimed_fp, o_orderpriority <> '5-LOW' AS key_trusted, count(*) AS n FROM orders GROUP BY 1, 2""",
    "checkpoint_check": """
WITH t AS (SELECT o_custkey AS c, count(*) - 1 AS tip FROM orders GROUP BY 1),
j AS (SELECT c, tip, c_acctbal AS b, CASE WHEN c_acctbal > 0 THEN tip + CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END END AS cp
      FROM t JOIN customer ON c_custkey = c)
SELECT CAST(c AS VARCHAR) AS chain_id, tip AS tip_index, cp AS checkpoint_index,
  CASE WHEN tip < cp THEN 'Ledger truncation detected: checkpoint recorded tip block #' || cp || ', but ledger only contains ' || (tip + 1)
    || ' blocks (tip #' || tip || ').' END AS checkpoint_reason,
  CASE WHEN cp IS NULL THEN 'Checkpoint is absent: tail truncation could not be ruled out.'
       WHEN b <= 2000 THEN 'Checkpoint carries no signature: tail truncation could not be ruled out.' END AS checkpoint_warning
FROM j""",
    "ledger_report": _LEDGER + """,
f AS (SELECT chain, idx, h, CASE
    WHEN gap THEN 'gap'
    WHEN prev <> want THEN 'Hash chain broken at block #' || idx || ': prev_hash does not match previous block hash.'
    WHEN price BETWEEN 460000 AND 462999 THEN 'Data tampering detected in block #' || idx || ': recomputed hash '
      || sha256(replace(head, '"operator_id":"op-' || st, '"operator_id":"intruder') || prev || tail) || ' != stored hash ' || h || '.'
    WHEN price BETWEEN 470000 AND 472999 THEN 'hash'
    WHEN bs = 'forged' THEN 'Block signature tampering detected in block #' || idx || ': block_signature does not match block_hash under trusted public keys.'
    WHEN bs = 'unsigned' THEN 'Block #' || idx || ' is unsigned: missing required Ed25519 block_signature for signed certificate.' END AS fail FROM l),
c AS (SELECT chain, count(*) AS n, min(idx) FILTER (WHERE fail IS NOT NULL) AS pos, max(idx) AS tip,
       arg_min(fail, idx) FILTER (WHERE fail IS NOT NULL) AS fail FROM f GROUP BY chain),
e AS (SELECT c.*, (SELECT count(*) FROM f WHERE f.chain = c.chain AND f.idx < c.pos) AS below FROM c),
cp AS (SELECT CAST(c_custkey AS VARCHAR) AS chain, c_acctbal AS b,
         (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) - 1 + CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END AS i
       FROM customer WHERE c_acctbal > 0),
r AS (SELECT e.*, cp.i, cp.b, CASE WHEN fail = 'gap' THEN 'Block sequence gap detected: expected index ' || below || ', found ' || pos || '.'
    WHEN fail IS NOT NULL THEN fail
    WHEN tip < i THEN 'Ledger truncation detected: checkpoint recorded tip block #' || i || ', but ledger only contains ' || (tip + 1)
      || ' blocks (tip #' || tip || ').' END AS reason FROM e LEFT JOIN cp USING (chain))
SELECT chain AS chain_id, reason IS NULL AS is_valid,
  CAST(CASE WHEN fail = 'gap' THEN below WHEN fail IS NOT NULL THEN pos ELSE n END AS BIGINT) AS blocks_verified,
  CAST(CASE WHEN fail IS NOT NULL THEN pos WHEN reason IS NOT NULL THEN tip END AS BIGINT) AS broken_block_index,
  coalesce(reason, 'Hash-chained audit chain verified successfully across ' || n || ' blocks.') AS reason,
  CASE WHEN reason IS NULL THEN CASE WHEN i IS NULL THEN 'Checkpoint is absent: tail truncation could not be ruled out.'
    WHEN b <= 2000 THEN 'Checkpoint carries no signature: tail truncation could not be ruled out.' END END AS checkpoint_warning,
  FALSE AS is_demo_signed FROM r""",
    "ledger_page": f"""WITH {_ORD.split("p AS (SELECT *, sha256(payload)")[0].rstrip().rstrip(",")}
SELECT chain AS chain_id, idx AS block_index, uuid AS cert_uuid FROM d ORDER BY chain, idx LIMIT 500""",
    "doc_validation": """
WITH e AS (SELECT o_orderkey, o_orderstatus AS st, o_orderpriority AS pri, CAST(trunc(o_totalprice) AS BIGINT) AS price FROM orders)
SELECT o_orderkey, CASE
  WHEN st = 'F' AND pri = '1-URGENT' AND price > 0 THEN 'device.capacity_bytes: must be a non-negative integer'
  WHEN st = 'F' AND pri = '2-HIGH' THEN 'wipe.bytes_processed: non-negative integer required; $.wipe.bytes_processed: float values are forbidden in schema v1'
  WHEN st = 'F' AND pri = '3-MEDIUM' THEN 'issuer: missing [''operator_id'']; issuer: unexpected fields [''operator'']; issuer.operator_id: non-empty string required'
  WHEN st = 'P' AND pri = '1-URGENT' THEN 'wipe.nist_category ''Purge'' exceeds the tier permitted for method ''OVERWRITE_ZERO_1PASS'' per the NIST mapping registry'
  WHEN st = 'P' AND pri = '5-LOW' THEN 'wipe.nist_category ''Purge'' exceeds the tier permitted for method ''SCSI_UNMAP'' per the NIST mapping registry'
  WHEN st = 'P' AND pri = '3-MEDIUM' THEN 'BLKDISCARD claiming Purge requires documented deterministic-read-after-discard justification in notes'
  ELSE '' END AS errors FROM e""",
    "method_tier": f"""
WITH e AS (SELECT CASE o_orderpriority {_M} END AS method, CASE WHEN o_orderstatus = 'P' THEN 'Purge' ELSE CASE o_orderpriority {_T} END END AS tier FROM orders)
SELECT method, tier, NOT (tier = 'Purge' AND method IN ('OVERWRITE_ZERO_1PASS', 'SCSI_UNMAP')) AS permitted, count(*) AS n FROM e GROUP BY ALL""",
    "canonical_documents": r"""
SELECT doc_id, sha256('{"id":' || doc_id || ',"meta":{"l":' || CAST(to_json(lang) AS VARCHAR) || ',"s":' || CAST(to_json(source) AS VARCHAR)
  || '},"text":' || CAST(to_json(text) AS VARCHAR) || '}') AS sha256, NULL AS error FROM documents""",
    "payload_hashes": f"""WITH {_ORD.split("q AS (SELECT *,")[0].rstrip().rstrip(",")} SELECT k AS o_orderkey, ph AS payload_hash FROM p""",
}
