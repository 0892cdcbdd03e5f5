"""Byte-level BPE: padded matrices of pieces, each row merging its leftmost minimum-rank pair each round.

A text is split by the tokenizer's pattern. Distinct pieces of a task's step that are not tokens themselves are
bucketed by length and laid out as rows of byte tokens. A hashed table gives the rank of each adjacent pair; every
round each row merges its best pair, closes the gap, and only the two pairs beside it are looked up again. Rows without
a pair leave the matrix. Ids are ranks.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from tracewell.llm.arrow import gather, map_text, release, U64

_NONE = np.int64(1 << 40)
_EMPTY = U64((1 << 64) - 1)
#: A text is cut into runs of about so many characters, where no piece can reach across.
SEGMENT = 1 << 20
#: Cells of one matrix.
_CELLS = 1 << 20
#: Longer pieces merge by a heap: rounds over a row cost the square of its length.
_ROW_BYTES = 512
#: Pieces that a worker remembers.
_REMEMBERED = 100_000
#: Bytes of text in one step.
_STEP = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Tokens by rank, and the hashed table of pairs: which two tokens make which."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.ranks = pattern, ranks
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {
            (ranks[token[:i]], ranks[token[i:]]): rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        keys = np.array([a << 32 | b for a, b in pairs], U64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, _EMPTY), np.zeros(1 << self.bits, np.int64)
        values, slots = np.array(list(pairs.values()), np.int64), self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] == _EMPTY)
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that two tokens make, or _NONE; a negative token makes nothing."""
        out = np.full(left.shape, _NONE)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[at].astype(U64) << U64(32) | right.ravel()[at].astype(U64)
        slots = self._slots(keys)
        while len(at):
            got = self.keys[slots]
            same = got == keys
            out.ravel()[at[same]] = self.values[slots[same]]
            go = ~same & (got != _EMPTY)
            at, keys, slots = at[go], keys[go], (slots[go] + 1) & ((1 << self.bits) - 1)
        return out

    def _rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Tokens of pieces of similar length, by rounds over one matrix."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        tokens = np.full((len(pieces), width), -1, np.int64)
        tokens[np.arange(width) < lengths[:, None]] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width), _NONE)
        ranks[:, :-1] = self.merge(tokens[:, :-1], tokens[:, 1:])
        out: list[np.ndarray] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            best = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            made = ranks[each, best]
            for k in np.flatnonzero(made == _NONE):
                out[rows[k]] = tokens[k, : lengths[k]].copy()
            go = made != _NONE
            rows, lengths, best, made = rows[go], lengths[go] - 1, best[go], made[go]
            if not len(rows):
                break
            width = int(lengths.max())
            # Compaction: the cells right of the merged pair move one to the left.
            source = np.arange(width) + (np.arange(width) > best[:, None])
            tokens = np.take_along_axis(tokens[go], source, axis=1)
            ranks = np.take_along_axis(ranks[go], source, axis=1)
            each = np.arange(len(rows))
            tokens[each, best] = made
            right = np.where(best + 1 < width, tokens[each, np.minimum(best + 1, width - 1)], -1)
            ranks[each, best] = self.merge(made, right)
            left = np.maximum(best - 1, 0)
            ranks[each, left] = np.where(best > 0, self.merge(np.where(best > 0, tokens[each, left], -1), made), ranks[each, left])
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """Tokens of one long piece by a heap of pairs over a linked list; the order of merges is the same."""
        tokens = self.bytes[np.frombuffer(piece, np.uint8)]
        first = self.merge(tokens[:-1], tokens[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != _NONE)]
        heapq.heapify(heap)
        tokens, n = tokens.tolist(), len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                made = self._one(tokens[i], tokens[j])
                if made is not None:
                    heapq.heappush(heap, (made, i))

        while heap:
            made, i = heapq.heappop(heap)
            if tokens[i] < 0 or after[i] >= n or self._one(tokens[i], tokens[after[i]]) != made:
                continue
            j = after[i]
            tokens[i], tokens[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([t for t in tokens if t >= 0], np.int64)

    def _one(self, left: int, right: int) -> int | None:
        key = left << 32 | right
        slot = (key * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)) >> (64 - self.bits)
        while (got := int(self.keys[slot])) != key:
            if got == int(_EMPTY):
                return None
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return int(self.values[slot])

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The tokens of each piece."""
        out: list[np.ndarray] = [None] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank], np.int64)
            elif len(piece) > _ROW_BYTES:
                out[i] = self._long(piece)
            else:
                rest.append(i)
        rest.sort(key=lambda i: len(pieces[i]))
        at = 0
        while at < len(rest):
            # A bucket: lengths within a factor of about 1.5, and no more cells than a matrix may have.
            most = len(pieces[rest[at]]) * 3 // 2 + 1
            end = at
            while end < len(rest) and len(pieces[rest[end]]) <= most and (end - at) * most < _CELLS:
                end += 1
            for i, tokens in zip(rest[at:end], self._rows([pieces[i] for i in rest[at:end]]), strict=True):
                out[i] = tokens
            at = end
        return out


def segments(text: str) -> Iterator[str]:
    """Runs of a text, cut before a blank or line end that stands between two solid characters.

    Patterns of this family never match across such a place.
    """
    at = 0
    while len(text) - at > SEGMENT:
        cut = regex.compile(r"(?<=\S)[ \n](?=\S)").search(text, at + SEGMENT)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Encoder:
    """Texts to ids in a worker, which remembers the pieces it met last."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.find = vocabulary, regex.compile(vocabulary.pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        made = self.vocabulary.pieces([p.encode() for p in new])
        lengths = np.array([len(m) for m in made], np.int64)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, *made])

    def _group(self, runs: list[str]) -> list[np.ndarray]:
        if len(self.index) > _REMEMBERED:
            self._forget()
        found = [self.find(run) for run in runs]
        if new := list({piece: None for pieces in found for piece in pieces if piece not in self.index}):
            self._learn(new)
        out = []
        for pieces in found:
            at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
            out.append(self.ids[gather(self.starts[at], self.lengths[at])].astype(np.int32))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        counts, ids, group, owners, size = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)], [], [], 0

        def close() -> None:
            for d, run in zip(owners, self._group(group), strict=True):
                counts[d] += len(run)
                ids.append(run)
            group.clear()
            owners.clear()

        for d, text in enumerate(texts):
            for run in segments(text):
                group.append(run)
                owners.append(d)
                size += len(run)
                if size > _STEP:
                    close()
                    size = 0
        close()
        return np.concatenate(ids), counts


@lru_cache(maxsize=1)
def _encoder(shared) -> Encoder:
    return Encoder(shared.value)


def _listed(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``, an array of int: the tokens of the whole text, without special tokens.

    Each match of ``pattern`` is encoded by itself; what the pattern skips is not encoded. Null and empty texts have no
    ids. ``keep`` names the columns to carry (default all); ``ids`` replaces one of this name. Every repeated row is
    encoded. The rank file is read on the driver and broadcast: its size is that of a vocabulary, whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path), pattern))

    def run(column: pa.Array) -> list[pa.Array]:
        return [_listed(*_encoder(shared).encode(column.fill_null("").to_pylist()))]

    def done() -> None:
        # The pieces that an encoder remembers serve one task.
        _encoder.cache_clear()
        release()

    return map_text(docs, run, "ids array<int>", keep, size=_STEP, done=done)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that the ids stand for; null ids are no ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path), pattern))
    names = [c for c in encoded.columns if c != "decoded"]
    schema = StructType([*[StructField(c, encoded.schema[c].dataType, True) for c in names], StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum(np.nan_to_num(batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)))])
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + _STEP // 4, "right")) - 1)
                part = batch.slice(i, j - i)
                i = j
                lists = part.column("ids")
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                data = words.blob[gather(words.starts[ids], words.lengths[ids])]
                ends = np.concatenate([[0], np.cumsum(words.lengths[ids])])[np.cumsum(counts)]
                where = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
                made = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, where, pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], made.cast(pa.binary())], [*names, "decoded"])
        release()

    return encoded.mapInArrow(run, schema)
