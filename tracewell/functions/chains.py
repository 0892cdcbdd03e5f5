"""Where length-prefixed formats end: one walker over a table of unit layouts.

A file of such a format is a run of units. A unit states its length in a field, or always has the same one; the file
ends with a closing unit, or where units stop. A walk reads a few bytes per unit, so sizing a gigabyte costs little.
Formats that a row of the table cannot describe have no rule here and stay undetermined.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

Read = Callable[[int, int], bytes]
Verdict = tuple[int | None, str, str]

WALK, FOOTER, SYNC, DECLARED = "container_walk", "footer_anchored", "sync_run", "declared_size"
NONE = "undetermined"


class Units(NamedTuple):
    """Layout of a format's units.

    ``skip`` bytes come before the first unit. A unit is ``len_width`` bytes of length at ``len_off`` (none: constant)
    plus ``addend``, padded to ``align``. It begins with ``magic`` at ``magic_off``, the first one with ``first`` there;
    ``text`` bytes there are printable. ``closing`` (bytes, offset, length) ends the file and has that length, or its
    own if 0; without it the file ends where units stop. ``echo``: the length is repeated in the last bytes of the unit.
    ``wide``: a length of 1 stands for a 64-bit one at this offset. ``least``: units that make a file.
    """

    skip: int = 0
    len_off: int = 0
    len_width: int = 0
    endian: str = "little"
    addend: int = 0
    align: int = 1
    magic: bytes = b""
    magic_off: int = 0
    first: bytes = b""
    text: int = 0
    closing: tuple[bytes, int, int] | None = None
    echo: bool = False
    wide: int = 0
    least: int = 1
    method: str = WALK


# The layouts as their format descriptions give them.
LAYOUTS: dict[str, Units] = {
    "png": Units(skip=8, len_width=4, endian="big", addend=12, magic_off=4, first=b"IHDR", text=4, closing=(b"IEND", 4, 0)),
    "pcapng": Units(len_off=4, len_width=4, first=b"\x0a\x0d\x0d\x0a", echo=True),
    "pcap": Units(skip=24, len_off=8, len_width=4, addend=16),
    "mid": Units(len_off=4, len_width=4, endian="big", addend=8, first=b"MThd", magic=b"MTrk", least=2),
    "evtx": Units(skip=4096, addend=65536, magic=b"ElfChnk\x00"),
    "dat": Units(skip=4096, len_off=4, len_width=4, magic=b"hbin", closing=(bytes(4), 0, 4)),
    "wav": Units(skip=12, len_off=4, len_width=4, addend=8, align=2, text=4),
    "webp": Units(skip=12, len_off=4, len_width=4, addend=8, align=2, text=4),
    "avi": Units(skip=12, len_off=4, len_width=4, addend=8, align=2, text=4),
    "mp4": Units(len_width=4, endian="big", magic_off=4, first=b"ftyp", text=4, wide=8),
    "mov": Units(len_width=4, endian="big", magic_off=4, first=b"ftyp", text=4, wide=8),
    "m4a": Units(len_width=4, endian="big", magic_off=4, first=b"ftyp", text=4, wide=8),
    "ts": Units(addend=188, magic=b"\x47", least=16, method=SYNC),
}
_HEAD = 32


def _unit(layout: Units, head: bytes, nth: int) -> int | None:
    """The length of the unit with this head; None if it is not one."""
    mark = head[layout.magic_off :]
    wanted = layout.first if nth == 0 and layout.first else layout.magic
    if not mark.startswith(wanted) or any(not 0x20 <= c < 0x7F for c in mark[: layout.text]) or len(mark) < layout.text:
        return None
    size = int.from_bytes(head[layout.len_off : layout.len_off + layout.len_width], layout.endian)
    least = layout.len_off + layout.len_width
    if len(head) < least:
        return None
    if layout.wide and size == 1:
        size, least = int.from_bytes(head[layout.wide : layout.wide + 8], layout.endian), layout.wide + 8
    size += layout.addend
    size += -size % layout.align
    return size if size >= max(1, least) else None


def units(extension: str, data: bytes) -> list[dict]:
    """Offset, length and tag of a payload's units, up to the closing one or to where they stop.

    Padding behind the last unit may be missing.
    """
    layout = LAYOUTS[extension]
    found: list[dict] = []
    pos = layout.skip
    while pos < len(data):
        head = data[pos : pos + _HEAD]
        size = _unit(layout, head, len(found))
        if size is None or pos + size >= len(data) + layout.align:
            break
        tag = head[layout.magic_off : layout.magic_off + layout.text]
        found.append({"offset": pos, "length": size, "tag": tag.decode("latin-1")})
        if layout.closing is not None and head.startswith(layout.closing[0], layout.closing[1]):
            break
        pos += size
    return found


def walk(extension: str, read: Read, start: int, limit: int) -> Verdict:
    """``(end, method, note)`` of the file of a known format at ``start``; ``end`` is None if its units do not close."""
    layout = LAYOUTS[extension]
    pos, n, held, at = start + layout.skip, 0, b"", 0
    while pos < limit:
        if not at <= pos <= at + len(held) - _HEAD:
            # Short units are many: one read serves those that follow closely.
            held, at = read(pos, _HEAD if layout.len_width else 1 << 16), pos
        head = held[pos - at : pos - at + _HEAD][: limit - pos]
        closes = layout.closing is not None and head.startswith(layout.closing[0], layout.closing[1])
        size = layout.closing[2] if closes and layout.closing[2] else _unit(layout, head, n)
        if size is None or pos + size > limit:
            break
        if layout.echo and int.from_bytes(read(pos + size - layout.len_width, layout.len_width), layout.endian) != size:
            break
        pos, n = pos + size, n + 1
        if closes:
            return pos, layout.method, f"{n} unit(s) up to the closing one"
    if layout.closing is not None:
        return None, NONE, f"no closing unit behind {n} unit(s)"
    if n < layout.least:
        return None, NONE, f"{n} unit(s) found, at least {layout.least} needed"
    return pos, layout.method, f"{n} unit(s) up to where they stop"
