"""Small binary builders; every answer is known by construction."""

from __future__ import annotations

import io
import random
import struct
import zipfile
import zlib


def png(rng: random.Random, n: int) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 16, 8, 2, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(rng.randbytes(n))) + chunk(b"IEND", b"")


def bmp(rng: random.Random, n: int) -> bytes:
    info = struct.pack("<IiiHHIIiiII", 40, 10, 10, 1, 24, 0, n, 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + n, 0, 0, 54) + info + rng.randbytes(n)


def pdf() -> bytes:
    return b"%PDF-1.4\n1 0 obj<</Root 1 0 R>>endobj\n" + b"text " * 60 + b"\nstartxref\n9\n%%EOF\n"


def zipped(seed: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", f"hello {seed}" * 40)
        z.writestr("b.bin", random.Random(seed).randbytes(80))
    return out.getvalue()


def wav(rng: random.Random) -> bytes:
    data = rng.randbytes(500)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def usn_record(usn: int, ref: int, reason: int, name: str, ticks: int = 133_500_000_000_000_000, major: int = 2) -> bytes:
    text = name.encode("utf-16le")
    size = (0x3C + len(text) + 7) // 8 * 8
    head = struct.pack("<IHHqqqqIIIIHH", size, major, 0, ref, 5, usn, ticks, reason, 0, 0, 0x20, len(text), 0x3C)
    return (head + text).ljust(size, b"\0")


def attribute(kind: int, value: bytes, name: str = "", flags: int = 0) -> bytes:
    text = name.encode("utf-16le")
    at = 0x18 + len(text)
    size = (at + len(value) + 7) // 8 * 8
    head = struct.pack("<IIBBHHHIHH", kind, size, 0, len(name), 0x18, flags, 0, len(value), at, 0)
    return (head + text + value).ljust(size, b"\0")


def stream(runs: bytes, real: int, vcn: int = 0, flags: int = 0) -> bytes:
    size = (0x40 + len(runs) + 1 + 7) // 8 * 8
    head = struct.pack("<IIBBHHH", 0x80, size, 1, 0, 0x40, flags, 0) + struct.pack("<qqHHI", vcn, 0, 0x40, 0, 0) + struct.pack("<qqq", real, real, real)
    return (head + runs + b"\0").ljust(size, b"\0")


def list_entry(record: int) -> bytes:
    entry = bytearray(0x18)
    entry[0] = 0x80
    entry[0x0B:0x11] = record.to_bytes(6, "little")
    return bytes(entry)


def file_name(name: str, parent: int, size: int = 0) -> bytes:
    times = struct.pack("<qqqq", *[133_500_000_000_000_000] * 4)
    return struct.pack("<q", parent | (1 << 48)) + times + struct.pack("<qqII", size, size, 0, 0) + bytes([len(name), 3]) + name.encode("utf-16le")


def mft_record(number: int, parts: list[bytes], in_use: bool = False, directory: bool = False, torn: bool = False) -> bytes:
    body = b"".join(parts) + b"\xff\xff\xff\xff"
    head = bytearray(0x38)
    head[0:4] = b"FILE"
    struct.pack_into("<HH", head, 4, 0x30, 3)
    struct.pack_into("<H", head, 0x0C, 7)
    struct.pack_into("<HH", head, 0x14, 0x38, (1 if in_use else 0) | (2 if directory else 0))
    struct.pack_into("<I", head, 0x2C, number)
    record = bytearray((bytes(head) + body).ljust(1024, b"\0"))
    mark = b"\xaa\x55"
    record[0x30:0x32] = mark
    for i in (1, 2):
        record[0x30 + 2 * i : 0x32 + 2 * i] = record[i * 512 - 2 : i * 512]
        record[i * 512 - 2 : i * 512] = mark if not (torn and i == 2) else b"zz"
    return bytes(record)


def short_checksum(name: bytes) -> int:
    total = 0
    for byte in name:
        total = (((total & 1) << 7) + (total >> 1) + byte) & 0xFF
    return total


def lfn_slots(long_name: str, short: bytes) -> list[bytes]:
    units = long_name + "\0" if len(long_name) % 13 else long_name
    padded = units.encode("utf-16le") + b"\xff\xff" * (-len(units) % 13)
    count = len(padded) // 26
    slots = []
    for seq in range(count, 0, -1):
        part = padded[(seq - 1) * 26 : seq * 26]
        flag = seq | (0x40 if seq == count else 0)
        slots.append(bytes([flag]) + part[:10] + b"\x0f\0" + bytes([short_checksum(short)]) + part[10:22] + b"\0\0" + part[22:])
    return slots


def short_slot(short: bytes, deleted: bool = False, attrs: int = 0x20) -> bytes:
    raw = short + bytes([attrs]) + bytes(8) + struct.pack("<HHHHI", 0, 0, 0, 9, 100)
    return (b"\xe5" + raw[1:] if deleted else raw)[:32].ljust(32, b"\0")
