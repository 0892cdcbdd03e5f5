"""Small file systems built byte by byte, with deleted files whose places are known."""

from __future__ import annotations

import struct


def short(name: str, cluster: int, size: int, deleted: bool = False, directory: bool = False) -> bytes:
    stem, _, suffix = name.partition(".") if not name.startswith(".") else (name, "", "")
    raw = bytearray(32)
    raw[0:11] = stem.encode().ljust(8) + suffix.encode().ljust(3)
    raw[11] = 0x10 if directory else 0x20
    struct.pack_into("<H", raw, 20, cluster >> 16)
    struct.pack_into("<HI", raw, 26, cluster & 0xFFFF, size)
    if deleted:
        raw[0] = 0xE5
    return bytes(raw)


def long_fragment(name: str, deleted: bool = True) -> bytes:
    """The one fragment of a name of up to 13 characters."""
    text = name.encode("utf-16le") + b"\0\0"
    text = text.ljust(26, b"\xff")[:26]
    return bytes([0xE5 if deleted else 0x41]) + text[:10] + b"\x0f\0\x12" + text[10:22] + b"\0\0" + text[22:26]


def fat32(directories: dict[int, list[bytes]], data: dict[int, bytes], links: dict[int, int], at: int = 0, size: int = 1 << 20) -> bytes:
    """512-byte clusters, cluster 2 the root; ``directories`` and ``data`` by their first cluster or any later one."""
    out = bytearray(size)
    out[3:11], out[82:90] = b"MSDOS5.0", b"FAT32   "
    struct.pack_into("<HBHBHH", out, 11, 512, 1, 32, 2, 0, 0)
    struct.pack_into("<III", out, 32, size // 512, 32, 0)
    struct.pack_into("<I", out, 44, 2)
    struct.pack_into("<H", out, 510, 0xAA55)
    for cluster, following in links.items():
        struct.pack_into("<I", out, 32 * 512 + 4 * cluster, following)
    heap = (32 + 2 * 32) * 512
    for cluster, content in {**{c: b"".join(s) for c, s in directories.items()}, **data}.items():
        place = heap + (cluster - 2) * 512
        out[place : place + len(content)] = content
    return bytes(at) + bytes(out)


def exfat_set(name: str, cluster: int, size: int, deleted: bool = True, directory: bool = False, chained: bool = False) -> bytes:
    mask = 0x7F if deleted else 0xFF
    parts = [name[i : i + 15] for i in range(0, len(name), 15)]
    head = bytearray(32)
    head[0], head[1] = 0x85 & mask, 1 + len(parts)
    struct.pack_into("<H", head, 4, 0x10 if directory else 0x20)
    stream = bytearray(32)
    stream[0], stream[1], stream[3] = 0xC0 & mask, 1 if chained else 3, len(name)
    struct.pack_into("<IQ", stream, 20, cluster, size)
    names = b"".join(bytes([0xC1 & mask, 0]) + p.encode("utf-16le").ljust(30, b"\0") for p in parts)
    return bytes(head) + bytes(stream) + names


def exfat(directories: dict[int, bytes], data: dict[int, bytes], links: dict[int, int], root: int = 4) -> bytes:
    """4096-byte clusters from 8192 on."""
    out = bytearray(256 << 10)
    out[3:11] = b"EXFAT   "
    struct.pack_into("<QIIIII", out, 72, 512, 2, 4, 16, 60, root)
    out[108], out[109] = 9, 3
    struct.pack_into("<H", out, 510, 0xAA55)
    for cluster, following in links.items():
        struct.pack_into("<I", out, 1024 + 4 * cluster, following)
    for cluster, content in {**directories, **data}.items():
        place = 8192 + (cluster - 2) * 4096
        out[place : place + len(content)] = content
    return bytes(out)


def extent_node(entries: list[tuple], depth: int = 0) -> bytes:
    """Leaves (logical, block, count) or, with a depth, (logical, block)."""
    head = struct.pack("<HHHHI", 0xF30A, len(entries), 4, depth, 0)
    if depth:
        return head + b"".join(struct.pack("<IIHH", logical, block & 0xFFFFFFFF, block >> 32, 0) for logical, block in entries)
    return head + b"".join(struct.pack("<IHHI", logical, count, block >> 32, block & 0xFFFFFFFF) for logical, block, count in entries)


def ext4(inodes: dict[int, tuple[int, bytes]], blocks: dict[int, bytes], groups: int = 1) -> bytes:
    """1 KiB blocks, 32 inodes of 256 bytes a group, inode tables from block 5 on; inodes are (size, extent node)."""
    out = bytearray(groups * 128 * 1024)
    struct.pack_into("<II", out, 1024, 32 * groups, 128 * groups)
    for at, value in ((20, 1), (24, 0), (32, 128), (40, 32)):
        struct.pack_into("<I", out, 1024 + at, value)
    struct.pack_into("<HH", out, 1024 + 56, 0xEF53, 1)
    struct.pack_into("<H", out, 1024 + 88, 256)
    for group in range(groups):
        struct.pack_into("<I", out, 2048 + 32 * group + 8, 5 + group * 128)
    for number, (size, node) in inodes.items():
        group, k = divmod(number - 1, 32)
        place = (5 + group * 128) * 1024 + k * 256
        struct.pack_into("<HHI", out, place, 0x81A4, 0, size & 0xFFFFFFFF)
        struct.pack_into("<I", out, place + 20, 1690000000)
        struct.pack_into("<I", out, place + 108, size >> 32)
        out[place + 40 : place + 40 + len(node)] = node
    for block, content in blocks.items():
        out[block * 1024 : block * 1024 + len(content)] = content
    return bytes(out)


def with_bitmaps(image: bytes, used: dict[int, list[int]], blocks: int = 128) -> bytes:
    """An ext4 image of ``ext4`` whose groups have block bitmaps: the used blocks of each group, by their place in it."""
    out = bytearray(image)
    for group, places in used.items():
        block = 50 + group
        struct.pack_into("<I", out, 2048 + 32 * group, block)
        bits = bytearray(1024)
        for k in places:
            bits[k >> 3] |= 1 << (k & 7)
        out[block * 1024 : block * 1024 + 1024] = bits
    return bytes(out)


def ntfs(record: bytes, bitmap_record: bytes, bitmap: dict[int, bytes], pieces: bool, clusters: int = 2048) -> bytes:
    """4 KiB clusters, the file table at cluster 4; with ``pieces`` record 6 lies in a second piece at cluster 40."""
    out = bytearray(clusters * 4096)
    out[3:11] = b"NTFS    "
    struct.pack_into("<HB", out, 11, 512, 8)
    struct.pack_into("<QQ", out, 40, clusters * 8, 4)
    out[64] = 0xF6
    out[510:512] = b"\x55\xaa"
    out[4 * 4096 : 4 * 4096 + 1024] = record
    place = 40 * 4096 + 2 * 1024 if pieces else 4 * 4096 + 6 * 1024
    out[place : place + 1024] = bitmap_record
    for cluster, content in bitmap.items():
        out[cluster * 4096 : cluster * 4096 + len(content)] = content
    return bytes(out)
