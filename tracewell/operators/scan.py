"""Pattern search over image windows: file signatures, footers and planted needles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.sources.images import by_bytes, image_opener

TS_PACKET = 188
TS_PREFILTER_PACKETS = 8

HIT_SCHEMA = "image_id string, block_no long, pattern int, offset long, prefiltered long"


@dataclass(frozen=True)
class Pattern:
    """What to look for: ``number`` identifies it in the result, ``shift`` is the magic's offset in the file."""

    number: int
    needle: bytes
    shift: int = 0
    rule: str = ""


def signature_patterns(signatures: DataFrame) -> list[Pattern]:
    """Patterns of a signature table. The table is configuration: a few dozen built-in rows plus the caller's own."""
    rows = signatures.select("sig_rank", "header", "header_offset", "extension").orderBy("sig_rank").collect()
    if len({r.sig_rank for r in rows}) < len(rows):
        raise ValueError("signatures share a sig_rank; each needs its own")
    return [Pattern(r.sig_rank, bytes(r.header), r.header_offset, r.extension) for r in rows]


def _field(view: np.ndarray, starts: np.ndarray, at: int, width: int) -> np.ndarray:
    """Little-endian integers at ``starts + at``; callers make sure they lie inside the window."""
    value = np.zeros(len(starts), dtype=np.int64)
    for i in range(width):
        value |= view[starts + at + i].astype(np.int64) << (8 * i)
    return value


def _judge(view: np.ndarray, starts: np.ndarray, span: int, test) -> np.ndarray:
    """Implausible starts among those with ``span`` bytes in the window; the others are left to later checks."""
    bad = np.zeros(len(starts), dtype=bool)
    known = starts + span <= len(view)
    if known.any():
        bad[known] = ~test(starts[known])
    return bad


def ts_packet_ok(view: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Valid transport packet header: sync byte, no error bit, no reserved scrambling or adaptation value."""
    b1, b3 = view[starts + 1], view[starts + 3]
    adaptation = (b3 >> 4) & 3
    fits = (adaptation < 2) | (view[starts + 4] <= TS_PACKET - 5)
    return (view[starts] == 0x47) & (b1 & 0x80 == 0) & ((b3 >> 6) != 1) & (adaptation != 0) & fits


def _ts_implausible(view: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fewer than eight valid packets in a row, as far as the window shows."""
    bad = np.zeros(len(starts), dtype=bool)
    for packet in range(TS_PREFILTER_PACKETS):
        at = starts + packet * TS_PACKET
        judged = ~bad & (at + TS_PACKET <= len(view))
        bad[judged] = ~ts_packet_ok(view, at[judged])
    return bad


def _mp3_implausible(view: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Not a frame header: reserved version, layer, bitrate or sample rate."""

    def ok(at: np.ndarray) -> np.ndarray:
        b1, b2, b3 = view[at + 1], view[at + 2], view[at + 3]
        bitrate = b2 >> 4
        known = (((b1 >> 3) & 3) != 1) & (((b1 >> 1) & 3) != 0) & (((b2 >> 2) & 3) != 3)
        return known & (bitrate != 0) & (bitrate != 15) & ((b3 & 3) != 2)

    return _judge(view, starts, 4, ok)


def _bmp_implausible(view: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Declared size, reserved words and pixel offset must fit together."""

    def ok(at: np.ndarray) -> np.ndarray:
        size, reserved, pixels = _field(view, at, 2, 4), _field(view, at, 6, 4), _field(view, at, 10, 4)
        return (size >= 26) & (size <= 1 << 31) & (reserved == 0) & (pixels >= 26) & (pixels <= size)

    return _judge(view, starts, 14, ok)


def _exe_implausible(view: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The DOS header must point at a PE signature, or at least at a sensible distance."""

    def ok(at: np.ndarray) -> np.ndarray:
        jump = _field(view, at, 60, 4)
        good = (jump >= 64) & (jump <= 1 << 22)
        seen = good & (at + jump + 4 <= len(view))
        good[seen] = _field(view, (at + jump)[seen], 0, 4) == 0x4550
        return good

    return _judge(view, starts, 64, ok)


#: Field rules for the one- and two-byte magics; longer magics are selective enough by themselves.
PREFILTERS = {
    "ts": _ts_implausible, "mp3": _mp3_implausible, "bmp": _bmp_implausible, "exe": _exe_implausible, "dll": _exe_implausible,
}


def _anchor(needle: bytes) -> int:
    """Where the byte pair to look for begins: the first without filler bytes or a repeated byte, if there is one."""
    plain = [i for i in range(len(needle) - 1) if needle[i] != needle[i + 1] and not {needle[i], needle[i + 1]} & {0x00, 0xFF, 0x20}]
    mixed = [i for i in range(len(needle) - 1) if needle[i] != needle[i + 1]]
    return (plain or mixed or [0])[0]


class Matcher:
    """All patterns at once: one table of the 65,536 byte pairs tells where any of them may lie, and only those places are verified."""

    #: Pairs looked up at a time, which bounds the scratch memory.
    STEP = 1 << 18

    def __init__(self, patterns: Sequence[Pattern]):
        self.single = [p for p in patterns if len(p.needle) == 1]
        self.marks = np.zeros(1 << 16, dtype=bool)
        self.anchored: dict[int, list[tuple[Pattern, int]]] = {}
        for pattern in patterns:
            if len(pattern.needle) > 1:
                at = _anchor(pattern.needle)
                pair = pattern.needle[at] | pattern.needle[at + 1] << 8
                self.marks[pair] = True
                self.anchored.setdefault(pair, []).append((pattern, at))

    def _marked(self, data: bytes) -> np.ndarray:
        """Sorted positions of marked byte pairs, read as 16-bit words from even and from odd positions."""
        places = []
        for odd in (0, 1):
            pairs = np.frombuffer(data, dtype="<u2", count=(len(data) - odd) // 2, offset=odd)
            for lo in range(0, len(pairs), self.STEP):
                places.append((np.flatnonzero(self.marks[pairs[lo : lo + self.STEP]]) + lo) * 2 + odd)
        return np.sort(np.concatenate(places))

    def find(self, data: bytes, view: np.ndarray) -> Iterator[tuple[Pattern, np.ndarray]]:
        """Every pattern that occurs, with its positions in order; occurrences may overlap."""
        for pattern in self.single:
            at = np.flatnonzero(view == pattern.needle[0])
            if len(at):
                yield pattern, at
        if not self.anchored or len(data) < 2:
            return
        places = self._marked(data)
        pairs = view[places].astype(np.uint16) | view[places + 1].astype(np.uint16) << 8
        order = np.argsort(pairs, kind="stable")
        present, firsts = np.unique(pairs[order], return_index=True)
        for pair, lo, hi in zip(present.tolist(), firsts, [*firsts[1:], len(order)]):
            group = places[order[lo:hi]]
            for pattern, anchor in self.anchored[pair]:
                at = group - anchor
                at = at[(at >= 0) & (at + len(pattern.needle) <= len(view))]
                for i, byte in enumerate(pattern.needle):
                    if not anchor <= i <= anchor + 1:
                        at = at[view[at + i] == byte]
                if len(at):
                    yield pattern, at


class Windows:
    """Windows laid end to end, so that many small ones cost one search; no match crosses from one to the next."""

    def __init__(self, windows: Sequence[bytes], bodies: Sequence[int]):
        self.data = windows[0] if len(windows) == 1 else b"".join(windows)
        self.view = np.frombuffer(self.data, dtype=np.uint8)
        self.edges = np.cumsum([0, *map(len, windows)])
        self.bodies = np.asarray(bodies, dtype=np.int64)

    def find(self, matcher: Matcher) -> Iterator[tuple[Pattern, np.ndarray, np.ndarray]]:
        """``(pattern, window, position)`` of matches that begin in a window's body and end before the window does."""
        if not self.data:
            return
        for pattern, at in matcher.find(self.data, self.view):
            row = np.searchsorted(self.edges, at, "right") - 1
            local = at - self.edges[row]
            whole = (local < self.bodies[row]) & (at + len(pattern.needle) <= self.edges[row + 1])
            if whole.any():
                yield pattern, row[whole], local[whole]

    def implausible(self, rule, row: np.ndarray, local: np.ndarray) -> np.ndarray:
        """What a field rule says of each match, seeing no more than the match's own window."""
        bad = np.zeros(len(row), dtype=bool)
        rows, firsts = np.unique(row, return_index=True)
        for r, lo, hi in zip(rows, firsts, [*firsts[1:], len(row)]):
            bad[lo:hi] = rule(self.view[self.edges[r] : self.edges[r + 1]], local[lo:hi])
        return bad


def _matcher(patterns: Sequence[Pattern]) -> Matcher:
    return Matcher([p for p in patterns if p.needle])


#: Hits gathered before a result batch is handed over.
BATCH_HITS = 100_000

#: Bytes of small windows that are searched together.
JOINED_BYTES = 1 << 20


class _Hits:
    """Gathers windows until they are worth a search, and hits until they are worth a result frame."""

    def __init__(self, matcher: Matcher):
        self.matcher, self.parts, self.size = matcher, [], 0
        self.waiting, self.bytes = [], 0

    def add(self, image_id: str, block_no: int, window: bytes, body: int, base: int) -> None:
        self.waiting.append((image_id, block_no, window, body, base))
        self.bytes += len(window)
        if self.bytes >= JOINED_BYTES:
            self.search()

    def search(self) -> None:
        if not self.waiting:
            return
        images, blocks, windows, bodies, bases = zip(*self.waiting)
        self.waiting, self.bytes = [], 0
        images, blocks = np.array(images, dtype=object), np.array(blocks, dtype=np.int64)
        bases = np.array(bases, dtype=np.int64)
        joined = Windows(windows, bodies)
        for pattern, row, local in joined.find(self.matcher):
            starts = local + bases[row] - pattern.shift
            row, local, starts = row[starts >= 0], local[starts >= 0], starts[starts >= 0]
            rule = PREFILTERS.get(pattern.rule)
            # A rule reads the candidate's own start, which a shifted magic may put in an earlier window.
            if rule is not None and pattern.shift == 0 and len(row):
                bad = joined.implausible(rule, row, local)
                gone, counts = np.unique(row[bad], return_counts=True)
                self._put(images[gone], blocks[gone], pattern.number, None, counts)
                row, starts = row[~bad], starts[~bad]
            self._put(images[row], blocks[row], pattern.number, starts, 0)

    def _put(self, images: np.ndarray, blocks: np.ndarray, number: int, offsets: np.ndarray | None, dropped) -> None:
        if not len(images):
            return
        places = pd.array([None] * len(images), dtype="Int64") if offsets is None else pd.array(offsets, dtype="Int64")
        self.parts.append(pd.DataFrame({
            "image_id": images, "block_no": blocks, "pattern": np.int32(number), "offset": places, "prefiltered": np.int64(0) + dropped,
        }))
        self.size += len(images)

    def frames(self, least: int) -> Iterator[pd.DataFrame]:
        """What was found, once there are ``least`` rows of it."""
        if self.parts and self.size >= least:
            found, self.parts, self.size = self.parts, [], 0
            yield pd.concat(found, ignore_index=True)


def scan_blocks(blocks: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Hits in ``image_blocks`` rows that carry their bytes."""
    matcher = _matcher(patterns)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = _Hits(matcher)
        for batch in batches:
            for row in batch.itertuples(index=False):
                hits.add(row.image_id, row.block_no, bytes(row.bytes) + bytes(row.tail or b""), len(row.bytes), row.offset)
                yield from hits.frames(BATCH_HITS)
        hits.search()
        yield from hits.frames(0)

    return blocks.select("image_id", "block_no", "offset", "bytes", "tail").mapInPandas(scan, HIT_SCHEMA)


def scan_images(index: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Hits in the windows of a block index. The task that scans a window reads it, so only hits leave."""
    matcher = _matcher(patterns)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = image_opener()
        hits = _Hits(matcher)
        for batch in batches:
            for row in batch.itertuples(index=False):
                window = opened(row.path).read(row.offset, row.length + row.tail_len)
                hits.add(row.image_id, row.block_no, window, row.length, row.offset)
                yield from hits.frames(BATCH_HITS)
        hits.search()
        yield from hits.frames(0)

    placed = by_bytes(index, F.col("length"), "image_id", F.expr("block_no div 8"))
    return placed.select("image_id", "path", "block_no", "offset", "length", "tail_len").mapInPandas(scan, HIT_SCHEMA)


def signature_candidates(hits: DataFrame, signatures: DataFrame) -> DataFrame:
    """Hits with their signature's columns and their place in a sequential scan."""
    named = hits.where(F.col("offset").isNotNull()).drop("prefiltered")
    named = named.join(signatures.withColumnRenamed("sig_rank", "pattern"), "pattern")
    return named.withColumnRenamed("pattern", "sig_rank").withColumn("scan_order", scan_order())


def prefiltered_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("image_id").agg(F.sum("prefiltered").alias("prefiltered"))


def scan_order() -> Column:
    """A value that sorts candidates like a sequential scan: window, then signature, then offset."""
    return F.struct("block_no", "sig_rank", "offset")


def _apart(row: np.ndarray, local: np.ndarray, needle: bytes) -> np.ndarray:
    """Which matches, taken from the left of each window, do not overlap one taken before."""
    keep = np.ones(len(row), dtype=bool)
    if not any(needle[:k] == needle[-k:] for k in range(1, len(needle))):
        return keep
    window, free = -1, 0
    for i, (r, at) in enumerate(zip(row.tolist(), local.tolist())):
        if r != window:
            window, free = r, 0
        keep[i] = at >= free
        if keep[i]:
            free = at + len(needle)
    return keep


def count_needles(blocks: DataFrame, needles: Sequence[bytes], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Occurrences of each needle per image, one that straddles two windows counted once.

    Occurrences inside a window do not overlap each other. The overlap must be at least as long as
    the longest needle less one.
    """
    wanted = sorted({bytes(n) for n in needles if n})
    matcher = _matcher([Pattern(i, needle) for i, needle in enumerate(wanted)])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = [bytes(body) for body in batch["bytes"]]
            windows = [body + bytes(tail or b"") for body, tail in zip(bodies, batch["tail"])]
            images = batch["image_id"].to_numpy(dtype=object)
            sizes = np.cumsum([len(w) for w in windows])
            # Small windows are searched together, about a mebibyte at a time.
            cuts = np.flatnonzero(np.diff(sizes // JOINED_BYTES, prepend=0, append=-1))
            for lo, hi in zip([0, *cuts[:-1]], cuts):
                if lo == hi:
                    continue
                found = []
                for pattern, row, local in Windows(windows[lo:hi], [len(b) for b in bodies[lo:hi]]).find(matcher):
                    row = row[_apart(row, local, pattern.needle)]
                    rows, n = np.unique(row, return_counts=True)
                    found.append(pd.DataFrame({"image_id": images[lo:hi][rows], "needle": [pattern.needle] * len(rows), "n": n}))
                if found:
                    yield pd.concat(found, ignore_index=True)

    counted = blocks.select("image_id", "bytes", "tail").mapInPandas(count, "image_id string, needle binary, n long")
    return counted.groupBy(*keys, "needle").agg(F.sum("n").alias("hits"))
