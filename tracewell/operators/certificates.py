"""Erasure certificates: structural validation and the method-to-tier rule, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.canonical import canonical_payload, number_problems

# Schema version, vocabularies and formats of a certificate.
SCHEMA_VERSION = "1.0.0"
METHOD_TIERS = {
    "OVERWRITE_ZERO_1PASS": ["Clear"],
    "OVERWRITE_ZERO_2PASS": ["Clear"],
    "OVERWRITE_ZERO_3PASS": ["Clear"],
    "OVERWRITE_RANDOM_1PASS": ["Clear"],
    "SHRED_RANDOM_1PASS": ["Clear"],
    "SHRED_RANDOM_NPASS": ["Clear"],
    "BLKDISCARD": ["Clear", "Purge"],
    "ATA_SECURE_ERASE": ["Purge"],
    "ATA_SECURE_ERASE_ENHANCED": ["Purge"],
    "NVME_FORMAT_USER_DATA_ERASE": ["Purge"],
    "NVME_FORMAT_CRYPTO_ERASE": ["Purge"],
    "NVME_SANITIZE_BLOCK_ERASE": ["Purge"],
    "NVME_SANITIZE_CRYPTO_ERASE": ["Purge"],
    "WINDOWS_CLEAN_ALL": ["Clear"],
    "WINDOWS_CIPHER_W": ["Clear"],
    "WINDOWS_SED_KEY_DESTROY": ["Purge"],
    "ANDROID_FACTORY_RESET_FBE": ["Purge"],
    "ANDROID_USER_SPACE_OVERWRITE": ["Clear"],
    "FORENSIC_CARVING": ["N/A"],
    "FORENSIC_IMAGING": ["N/A"],
    "FORENSIC_CLONING": ["N/A"],
    "ATA_SANITIZE_BLOCK_ERASE": ["Purge"],
    "ATA_SANITIZE_CRYPTO_SCRAMBLE": ["Purge"],
    "ATA_SANITIZE_OVERWRITE": ["Purge"],
    "NVME_SANITIZE_OVERWRITE": ["Purge"],
    "NVME_SANITIZE_PURGE_REQUIRED": ["Purge"],
    "SCSI_SANITIZE_BLOCK_ERASE": ["Purge"],
    "SCSI_SANITIZE_CRYPTOGRAPHIC_ERASE": ["Purge"],
    "SCSI_SANITIZE_OVERWRITE": ["Purge"],
    "SCSI_UNMAP": ["Clear"],
    "LUKS_KEYSLOT_ERASE": ["Purge"],
    "OPAL_CRYPTO_ERASE": ["Purge"],
    "FDE_KEY_DESTROY": ["Purge"],
    "VENDOR_SECURE_ERASE": ["Purge"],
    "RAID_CONTROLLER_PASSTHROUGH_SANITIZE": ["Purge"],
}
TIERS = ["Clear", "Purge", "Destroy", "N/A"]
PATTERNS = ["zero", "random", "firmware", "key_destruction", "carving", "imaging", "cloning", "not_applicable"]
STATUSES = ["success", "failure", "partial", "reset_triggered"]
DEVICE_TYPES = [
    "internal_disk", "removable_disk", "image_file", "phone", "file", "file_set", "folder", "folder_tree",
    "logical_volume", "virtual_disk", "raid_logical_volume", "cloud_volume",
]
STORAGE_TYPES = [
    "HDD", "SSD", "NVMe", "eMMC", "UFS", "SDCARD", "IMAGE_FILE", "UNKNOWN", "file", "folder_tree", "LOGICAL_VOLUME",
    "VIRTUAL_DISK", "RAID_LOGICAL_VOLUME", "CLOUD_BLOCK",
]
PLATFORMS = ["linux", "windows", "macos", "android"]
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
FINGERPRINT = r"^sha256:[0-9a-f]{64}$"
BASE64URL = r"^[A-Za-z0-9_-]+$"

# Fixed values: (object path, required members, optional members).
OBJECTS = {
    "": (
        ["schema_version", "cert_uuid", "issued_at", "issuer", "tool", "device", "wipe", "result"],
        ["notes", "signature"],
    ),
    "issuer": (["organization", "operator_id"], []),
    "tool": (["name", "version", "platform"], ["os_kernel"]),
    "device": (
        ["device_id", "device_type", "storage_type", "capacity_bytes"],
        ["model", "serial_number", "sector_size"],
    ),
    "wipe": (["method", "nist_category", "start_time", "end_time", "bytes_processed"], ["passes", "pattern"]),
    "result": (["status"], ["errors", "verification"]),
    "result.verification": (
        [],
        [
            "method", "samples_checked", "sample_bytes_each", "all_samples_match_wipe_pattern",
            "planted_pattern_hits_after", "pre_wipe_sample_hash", "sample_strategy", "population_blocks",
            "confidence_percent", "residual_fraction_upper_bound_ppm", "attestation", "smart_delta",
        ],
    ),
    "signature": (["algorithm", "public_key_fingerprint", "signature_base64url"], ["signed_payload_hash"]),
}
VERIFICATION_COUNTS = [
    "samples_checked", "sample_bytes_each", "planted_pattern_hits_after", "population_blocks", "confidence_percent",
    "residual_fraction_upper_bound_ppm",
]


def tier_permitted(method: Column, tier: Column) -> Column:
    """Whether a method may claim a tier; null for an unknown method."""
    flat: list[Column] = []
    for name, tiers in METHOD_TIERS.items():
        flat += [F.lit(name), F.array(*[F.lit(t) for t in tiers])]
    return F.array_contains(F.element_at(F.create_map(*flat), method), tier)


def discard_justified(notes: Column) -> Column:
    """A discard that claims Purge needs a note about deterministic reads after the discard."""
    return F.coalesce(F.lower(notes).rlike("deterministic|drat|rzat"), F.lit(False))


def _typed_paths() -> list[str]:
    """Every member whose JSON kind a check asks for."""
    inner = [f"{obj}.{name}" if obj else name for obj, (need, more) in OBJECTS.items() for name in [*need, *more]]
    return [*inner, "result.verification"]


def _slot(path: str) -> str:
    return path.replace(".", "__") or "root"


class _Document:
    """Access to one parsed document through columns prepared by :func:`validate_certificates`.

    ``maps`` holds each object's members as text (one parse per object), ``kinds`` the JSON type of
    every checked member, read off one variant. Each is a column of its own: fields of a struct would be
    put back into every check that reads them, and parsed as often.
    """

    def __init__(self, text: Column, variant: Column, maps: dict[str, Column], kinds: dict[str, Column]):
        self.text, self.variant, self.maps, self.kinds = text, variant, maps, kinds

    def keys(self, path: str) -> Column:
        return F.coalesce(F.map_keys(self.maps[_slot(path)]), F.array().cast("array<string>"))

    def raw(self, path: str) -> Column:
        parent, _, name = path.rpartition(".")
        return F.try_element_at(self.maps[_slot(parent)], F.lit(name))

    def kind(self, path: str) -> Column:
        """SQL type of the member; null when absent or JSON null."""
        return self.kinds[_slot(path)]

    def is_object(self, path: str) -> Column:
        return F.coalesce(F.startswith(self.kind(path), F.lit("OBJECT")), F.lit(False))

    def is_text(self, path: str) -> Column:
        return F.coalesce(self.kind(path) == "STRING", F.lit(False))

    def absent(self, path: str) -> Column:
        return self.kind(path).isNull()

    def is_int(self, path: str, least: int) -> Column:
        whole = self.kind(path).rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$")
        value = self.raw(path).try_cast("decimal(38,0)")
        return F.coalesce(whole & (value >= least), F.lit(False))

    def among(self, path: str, values: Sequence[str]) -> Column:
        return self.is_text(path) & F.coalesce(self.raw(path).isin(*values), F.lit(False))

    def matches(self, path: str, pattern: str) -> Column:
        return F.coalesce(self.raw(path).rlike(pattern), F.lit(False))

    def text_array(self, path: str) -> Column:
        return F.coalesce((self.kind(path) == "ARRAY<STRING>") | (self.raw(path) == "[]"), F.lit(False))


def _listing(names: Column) -> Column:
    quoted = F.transform(F.array_sort(names), lambda n: F.concat(F.lit("'"), n, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def _members(doc: _Document, path: str) -> list[Column]:
    required, optional = OBJECTS[path]
    keys = doc.keys(path)
    need = F.array(*[F.lit(r) for r in required]) if required else F.array().cast("array<string>")
    allowed = F.array(*[F.lit(a) for a in [*required, *optional]])
    missing, unknown = F.array_except(need, keys), F.array_except(keys, allowed)
    return [
        F.when(F.size(missing) > 0, F.concat(F.lit(f"{path}: missing "), _listing(missing))),
        F.when(F.size(unknown) > 0, F.concat(F.lit(f"{path}: unexpected fields "), _listing(unknown))),
    ]


def _within(doc: _Document, path: str, checks: list[Column]) -> list[Column]:
    """Checks that only apply to a member that is an object, after its own type check."""
    is_object = doc.is_object(path)
    return [
        F.when(~is_object, F.lit(f"{path}: must be a JSON object")),
        *[F.when(is_object, check) for check in [*_members(doc, path), *checks]],
    ]


def _need(good: Column, message: str | Column) -> Column:
    return F.when(~good, F.lit(message) if isinstance(message, str) else message)


def _wipe_checks(doc: _Document) -> list[Column]:
    method, tier = doc.raw("wipe.method"), doc.raw("wipe.nist_category")
    known = doc.among("wipe.method", list(METHOD_TIERS)) & doc.among("wipe.nist_category", TIERS)
    exceeds = F.concat(
        F.lit("wipe.nist_category '"), tier, F.lit("' exceeds the tier permitted for method '"), method,
        F.lit("' per the NIST mapping registry"),
    )
    unjustified = known & (method == "BLKDISCARD") & (tier == "Purge") & ~discard_justified(doc.raw("notes"))
    return [
        _need(doc.among("wipe.method", list(METHOD_TIERS)), "wipe.method: invalid"),
        _need(doc.among("wipe.nist_category", TIERS), "wipe.nist_category: invalid"),
        F.when(known & ~tier_permitted(method, tier), exceeds),
        F.when(
            unjustified,
            F.lit("BLKDISCARD claiming Purge requires documented deterministic-read-after-discard justification in notes"),
        ),
        _need(doc.absent("wipe.pattern") | doc.among("wipe.pattern", PATTERNS), "wipe.pattern: invalid"),
        _need(doc.absent("wipe.passes") | doc.is_int("wipe.passes", 1), "wipe.passes: must be an integer >= 1"),
        *[
            _need(doc.matches(f"wipe.{f}", DATETIME), f"wipe.{f}: must be 'YYYY-MM-DDTHH:MM:SSZ'")
            for f in ("start_time", "end_time")
        ],
        _need(doc.is_int("wipe.bytes_processed", 0), "wipe.bytes_processed: non-negative integer required"),
    ]


def _verification_checks(doc: _Document) -> list[Column]:
    base = "result.verification"
    present, is_object = ~doc.absent(base), doc.is_object(base)
    percent = doc.raw(f"{base}.confidence_percent").try_cast("decimal(38,0)")
    checks = [
        *_members(doc, base),
        *[
            _need(doc.absent(f"{base}.{f}") | doc.is_int(f"{base}.{f}", 0), f"{base}.{f}: non-negative integer")
            for f in VERIFICATION_COUNTS
        ],
        F.when(percent > 100, F.lit(f"{base}.confidence_percent: must be 0-100")),
        *[
            _need(doc.absent(f"{base}.{f}") | doc.is_text(f"{base}.{f}"), f"{base}.{f}: string")
            for f in ("sample_strategy", "attestation")
        ],
        _need(doc.absent(f"{base}.smart_delta") | doc.is_object(f"{base}.smart_delta"), f"{base}.smart_delta: object"),
        _need(
            doc.absent(f"{base}.all_samples_match_wipe_pattern")
            | F.coalesce(doc.kind(f"{base}.all_samples_match_wipe_pattern") == "BOOLEAN", F.lit(False)),
            f"{base}.all_samples_match_wipe_pattern: boolean",
        ),
    ]
    return [
        F.when(present & ~is_object, F.lit(f"{base}: must be an object")),
        *[F.when(is_object, check) for check in checks],
    ]


def _signature_checks(doc: _Document) -> list[Column]:
    is_object = doc.is_object("signature")
    value = F.coalesce(doc.raw("signature.signature_base64url"), F.lit(""))
    plausible = F.regexp_replace(value, "=+$", "").rlike(BASE64URL) & (F.length(value) >= 80)
    checks = [
        *_members(doc, "signature"),
        _need(doc.among("signature.algorithm", ["Ed25519"]), "signature.algorithm: only Ed25519 supported"),
        _need(
            doc.matches("signature.public_key_fingerprint", FINGERPRINT),
            "signature.public_key_fingerprint: must match 'sha256:<64 hex>'",
        ),
        _need(plausible, "signature.signature_base64url: not a plausible base64url signature"),
        _need(
            doc.absent("signature.signed_payload_hash") | doc.matches("signature.signed_payload_hash", FINGERPRINT),
            "signature.signed_payload_hash: must match 'sha256:<64 hex>'",
        ),
    ]
    return [F.when(~is_object, F.lit("signature: required object")), *[F.when(is_object, c) for c in checks]]


def _certificate_errors(doc: _Document, require_signature: bool) -> Column:
    """Every structural problem of a certificate, in report order; empty when it is valid."""
    checks = [
        *_members(doc, ""),
        _need(doc.among("schema_version", [SCHEMA_VERSION]), f"schema_version must be '{SCHEMA_VERSION}'"),
        _need(doc.matches("cert_uuid", UUID), "cert_uuid: not a lowercase UUID"),
        _need(doc.matches("issued_at", DATETIME), "issued_at: must be ISO 8601 UTC 'YYYY-MM-DDTHH:MM:SSZ'"),
        *_within(
            doc,
            "issuer",
            [
                _need(doc.is_text(f"issuer.{f}") & (doc.raw(f"issuer.{f}") != ""), f"issuer.{f}: non-empty string required")
                for f in ("organization", "operator_id")
            ],
        ),
        *_within(doc, "tool", [_need(doc.among("tool.platform", PLATFORMS), "tool.platform: invalid")]),
        *_within(
            doc,
            "device",
            [
                _need(doc.among("device.device_type", DEVICE_TYPES), "device.device_type: invalid"),
                _need(doc.among("device.storage_type", STORAGE_TYPES), "device.storage_type: invalid"),
                _need(
                    doc.absent("device.capacity_bytes") | doc.is_int("device.capacity_bytes", 0),
                    "device.capacity_bytes: must be a non-negative integer",
                ),
                _need(
                    doc.absent("device.sector_size") | doc.is_int("device.sector_size", 1),
                    "device.sector_size: must be a positive integer (minimum 1)",
                ),
            ],
        ),
        *_within(doc, "wipe", _wipe_checks(doc)),
        *_within(
            doc,
            "result",
            [
                _need(doc.among("result.status", STATUSES), "result.status: invalid"),
                _need(doc.absent("result.errors") | doc.text_array("result.errors"), "result.errors: array of strings"),
                *_verification_checks(doc),
            ],
        ),
        _need(doc.absent("notes") | doc.text_array("notes"), "notes: array of strings"),
        *(_signature_checks(doc) if require_signature else []),
    ]
    shaped = F.concat(F.array_compact(F.array(*checks)), F.coalesce(number_problems(doc.text), F.array().cast("array<string>")))
    return (
        F.when(doc.variant.isNull(), F.array(F.lit("certificate is not valid JSON")))
        .when(~doc.is_object(""), F.array(F.lit("certificate must be a JSON object")))
        .otherwise(shaped)
    )


#: Texts of a sound document: any string without an escape, and an integer that every reader takes exactly.
_ANY, _SOME = r'"[^"\\\x00-\x1f]*+"', r'"[^"\\\x00-\x1f]++"'
_COUNT, _POSITIVE = r"(?:0|[1-9]\d{0,14})", r"[1-9]\d{0,14}"


def _one_of(values: Sequence[str]) -> str:
    return '"(?:' + "|".join(re.escape(v) for v in values) + ')"'


def _quoted(pattern: str) -> str:
    return f'"{pattern[1:-1]}"'


_PLAIN = {
    "schema_version": _one_of([SCHEMA_VERSION]), "cert_uuid": _quoted(UUID), "issued_at": _quoted(DATETIME),
    "issuer.organization": _SOME, "issuer.operator_id": _SOME, "tool.platform": _one_of(PLATFORMS),
    "device.device_type": _one_of(DEVICE_TYPES), "device.storage_type": _one_of(STORAGE_TYPES),
    "device.capacity_bytes": _COUNT, "device.sector_size": _POSITIVE, "wipe.pattern": _one_of(PATTERNS), "wipe.passes": _POSITIVE,
    "wipe.start_time": _quoted(DATETIME), "wipe.end_time": _quoted(DATETIME), "wipe.bytes_processed": _COUNT,
    "result.status": _one_of(STATUSES), "signature.algorithm": _one_of(["Ed25519"]),
    "signature.public_key_fingerprint": _quoted(FINGERPRINT), "signature.signed_payload_hash": _quoted(FINGERPRINT),
    "signature.signature_base64url": '"(?=[^"]{80})[A-Za-z0-9_-]++=*+"',
}
#: Members whose presence leaves a document to the checks.
_UNUSUAL = {"notes", "errors", "verification", "signature"}


def _plain_object(path: str) -> str:
    """Pattern of an object as canonical JSON writes it: members in order of name, without white space."""
    required, optional = OBJECTS[path]
    found = ""
    for name in sorted({*required, *optional} - _UNUSUAL):
        inner = f"{path}.{name}" if path else name
        if inner == "wipe.nist_category":
            continue
        one = f'"{name}":' + (_plain_object(inner) if inner in OBJECTS else _PLAIN.get(inner, _ANY))
        if inner == "wipe.method":
            # The next member is the tier that is claimed; a discard that claims Purge needs a note.
            tiers = {t: [m for m, ts in METHOD_TIERS.items() if t in ts and (m, t) != ("BLKDISCARD", "Purge")] for t in TIERS}
            one = "(?:" + "|".join(f'"method":{_one_of(ms)},"nist_category":{_one_of([t])}' for t, ms in tiers.items() if ms) + ")"
        # The first member of every object is a required one.
        found += one if not found else f",{one}" if name in required else f"(?:,{one})?"
        if inner == "schema_version":
            found += _SIGNATURE_IN_ORDER
    return "\\{" + found + "\\}"


def _plain_document() -> str:
    signature = f',"signature":{_plain_object("signature")}'
    body = _plain_object("")
    in_order, last = body.replace(_SIGNATURE_IN_ORDER, signature), body.replace(_SIGNATURE_IN_ORDER, "")
    return rf"\A(?:{in_order}|{last[:-2]}{signature}\}})\z"


_SIGNATURE_IN_ORDER = "<signature>"


def sound(column: str = "certificate_json") -> Column:
    """Whether a document is in canonical form, its signature in order or last, and certainly passes every check.

    Such documents need not be taken apart to look for problems, and their members and payload can be cut out of the text:
    no string in them holds a quote or an escape. All others, valid ones among them (notes, a verification, white space,
    another order), are parsed.
    """
    return F.coalesce(F.col(column).rlike(_plain_document()), F.lit(False))


def parsed(df: DataFrame, column: str = "certificate_json") -> DataFrame:
    """Append ``__sound``, by which the functions below know how to read a document."""
    return df.withColumn("__sound", sound(column))


def member(path: str, column: str = "certificate_json") -> Column:
    """Text of a string member, whose name no other object of a certificate uses, of a :func:`parsed` document."""
    key, doc = f'"{path.rpartition(".")[2]}":"', F.col(column)
    # Forward searches only: substring_index with a negative count compares at every place from the end.
    at = F.instr(doc, F.lit(key))
    found = F.when(at > 0, F.substring_index(F.substr(doc, at + len(key)), '"', 1))
    return F.when(F.col("__sound"), found).otherwise(F.get_json_object(column, path))


def with_payload(df: DataFrame, out: str, column: str = "certificate_json") -> DataFrame:
    """Append ``struct(text, error)``, the canonical form of a :func:`parsed` document without its signature."""
    at = F.instr(F.col(column), F.lit(',"signature":'))
    rest = F.substr(F.col(column), at)
    cut = F.concat(F.substr(F.col(column), F.lit(1), at - 1), F.substr(rest, F.instr(rest, F.lit("}")) + 1))
    made = df.withColumn("__slow", canonical_payload(F.when(~F.col("__sound"), F.col(column))))
    text = F.when(F.col("__sound"), cut).otherwise(F.col("__slow.text"))
    return made.withColumn(out, F.struct(text.alias("text"), F.col("__slow.error").alias("error"))).drop("__slow")


def validate_certificates(
    df: DataFrame, column: str = "certificate_json", require_signature: bool = True, out: str = "errors"
) -> DataFrame:
    """Append the list of structural problems of each JSON document."""
    if "__sound" not in df.columns:
        return validate_certificates(parsed(df, column), column, require_signature, out).drop("__sound")
    members = "map<string,string>"
    # Sound documents have no problems; only the others are taken apart.
    rest = F.when(~F.col("__sound"), F.col(column))
    objects = ("issuer", "tool", "device", "wipe", "signature", "result")
    paths = list(dict.fromkeys(["", *_typed_paths()]))

    def map_name(path: str) -> str:
        return f"__m_{_slot(path)}"

    def kind_name(path: str) -> str:
        return f"__k_{_slot(path)}"

    def below(parent: str, name: str) -> Column:
        return F.from_json(F.try_element_at(F.col(map_name(parent)), F.lit(name)), members)

    def kind(path: str) -> Column:
        found = F.col("__v") if not path else F.try_variant_get("__v", f"$.{path}", "variant")
        return F.nullif(F.schema_of_variant(found), F.lit("VOID"))

    verification = "result.verification"
    staged = (
        df.withColumns({"__v": F.try_parse_json(rest), "__rest": rest, map_name(""): F.from_json(rest, members)})
        .withColumns({map_name(name): below("", name) for name in objects})
        .withColumn(map_name(verification), below("result", "verification"))
        .withColumns({kind_name(path): kind(path) for path in paths})
    )
    maps = {_slot(path): F.col(map_name(path)) for path in ("", *objects, verification)}
    kinds = {_slot(path): F.col(kind_name(path)) for path in paths}
    doc = _Document(F.col("__rest"), F.col("__v"), maps, kinds)
    errors = F.when(F.col("__sound"), F.array().cast("array<string>")).otherwise(_certificate_errors(doc, require_signature))
    checked = staged.withColumn(out, errors)
    return checked.select(*df.columns, out) if out not in df.columns else checked.drop("__v", "__rest", *map(map_name, ("", *objects, verification)), *map(kind_name, paths))
