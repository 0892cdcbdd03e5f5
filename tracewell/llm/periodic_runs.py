"""Periodic runs of words: suffix trees answer how far two places agree, Lyndon roots say where to ask.

A run is a stretch of words with smallest period q, long enough, that no neighbouring word extends. Every run that holds
its period twice contains, for one of the two orders of the alphabet, a Lyndon root that is the longest Lyndon word at
its place. So the longest Lyndon word at each place is a candidate, and two longest-common-extension queries (to the
right in the tree of the words, to the left in the tree of the reversal) make it a run.

A word of a run of exponent k stands in that run at least k times. A stretch is therefore cut at every word that it
holds fewer times, again and again until nothing changes; what is left are the stretches that trees are built of. No run
crosses such a cut, so the rows are those of trees of whole texts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm.arrow import SOLID, U64, flat, hash_spans, map_text, mix, words

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Entries of the Euler tour in a block whose minima are looked up by the pattern of its steps.
_BLOCK = 8


class SuffixTree:
    """Ukkonen's tree of a sequence of positive numbers, closed by a terminator (0) below all of them."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        self.symbols, n = s, len(s)
        start, stop, link, kids, suffix = [0], [0], [0], [{}], [-1]
        node = at = length = rest = 0
        for i, c in enumerate(s):
            rest += 1
            last = 0
            while rest:
                if not length:
                    at = i
                child = kids[node].get(s[at])
                if child is None:
                    parent = node
                    if last:
                        link[last] = node
                        last = 0
                else:
                    size = min(stop[child], i + 1) - start[child]
                    if length >= size:
                        at += size
                        length -= size
                        node = child
                        continue
                    if s[start[child] + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    parent = len(start)
                    start.append(start[child])
                    stop.append(start[child] + length)
                    link.append(0)
                    suffix.append(-1)
                    kids.append({s[start[child] + length]: child})
                    kids[node][s[at]] = parent
                    start[child] += length
                    if last:
                        link[last] = parent
                    last = parent
                kids[parent][c if child is not None else s[at]] = len(start)
                start.append(i)
                stop.append(n)
                link.append(0)
                kids.append(None)
                suffix.append(i - rest + 1)
                rest -= 1
                if not node and length:
                    length -= 1
                    at = i - rest + 1
                elif node:
                    node = link[node]
        self.start, self.stop, self.kids, self.suffix = start, stop, kids, suffix

    def leaves(self, descending: bool) -> np.ndarray:
        """The suffixes in the order of the alphabet or its reverse; the terminator comes first in both."""
        out, stack = [], [0]
        while stack:
            v = stack.pop()
            kids = self.kids[v]
            if kids is None:
                out.append(self.suffix[v])
            else:
                # The last one pushed comes first.
                ordered = sorted(kids, reverse=not descending)
                if 0 in kids:
                    ordered.remove(0)
                    ordered.append(0)
                stack.extend(kids[c] for c in ordered)
        return np.array(out)

    def extensions(self) -> "Extensions":
        """The Euler tour: every node when it is entered and after each of its children, with levels a step apart."""
        tour, level, depth, first = [], [], [0] * len(self.start), np.zeros(len(self.symbols), np.int64)
        stack = [(0, 0, iter(self.kids[0].values()))]
        tour.append(0)
        level.append(0)
        while stack:
            v, here, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
                if stack:
                    tour.append(stack[-1][0])
                    level.append(here - 1)
                continue
            depth[child] = depth[v] + self.stop[child] - self.start[child]
            if self.kids[child] is None:
                first[self.suffix[child]] = len(tour)
                tour += (child, v)
                level += (here + 1, here)
            else:
                tour.append(child)
                level.append(here + 1)
                stack.append((child, here + 1, iter(self.kids[child].values())))
        return Extensions(np.array(depth)[tour], np.array(level), first)


@lru_cache(maxsize=1)
def _minima() -> np.ndarray:
    """[pattern of steps, from, to] -> place of the lowest level in a block."""
    patterns = np.arange(1 << (_BLOCK - 1))
    steps = np.where(patterns[:, None] >> np.arange(_BLOCK - 1) & 1, 1, -1)
    levels = np.concatenate([np.zeros((len(patterns), 1), np.int64), np.cumsum(steps, axis=1)], axis=1)
    out = np.zeros((len(patterns), _BLOCK, _BLOCK), np.int8)
    for a in range(_BLOCK):
        for b in range(a, _BLOCK):
            out[:, a, b] = a + np.argmin(levels[:, a : b + 1], axis=1)
    return out


class Extensions:
    """How many symbols two suffixes share: the depth of the lowest common ancestor of their leaves.

    The lowest level between two places of the tour is found in constant time: inside blocks by the pattern of their
    steps, between blocks by minima over powers of two.
    """

    def __init__(self, depth: np.ndarray, level: np.ndarray, first: np.ndarray):
        pad = -len(level) % _BLOCK
        level = np.concatenate([level, level[-1] + 1 + np.arange(pad)])
        self.depth, self.level, self.first = depth, level, first
        steps = np.diff(level.reshape(-1, _BLOCK), axis=1) > 0
        self.pattern = steps @ (1 << np.arange(_BLOCK - 1))
        places = _minima()[self.pattern, 0, _BLOCK - 1] + np.arange(len(steps)) * _BLOCK
        self.sparse = [places]
        while 2 * (half := 1 << (len(self.sparse) - 1)) <= len(places):
            row = self.sparse[-1]
            self.sparse.append(self._lower(row[:-half], row[half:]))

    def _lower(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self.level[a] <= self.level[b], a, b)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of different suffixes."""
        a, b = self.first[a], self.first[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        inside, block, other = _minima(), a // _BLOCK, b // _BLOCK
        low = inside[self.pattern[block], a % _BLOCK, np.where(block == other, b % _BLOCK, _BLOCK - 1)] + block * _BLOCK
        low = self._lower(low, np.where(block == other, low, inside[self.pattern[other], 0, b % _BLOCK] + other * _BLOCK))
        gap = other - block - 1
        power = np.where(gap > 0, np.frexp(np.maximum(gap, 1))[1] - 1, -1)
        for k, row in enumerate(self.sparse):
            at = np.flatnonzero(power == k)
            if len(at):
                between = self._lower(row[block[at] + 1], row[other[at] - (1 << k)])
                low[at] = self._lower(low[at], between)
        return self.depth[low]


def _next_smaller(order: np.ndarray) -> np.ndarray:
    """For each suffix but the empty one, the next suffix of the text that stands before it in ``order``."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rank, out, stack = rank.tolist(), [0] * (len(order) - 1), [len(order) - 1]
    for i in range(len(order) - 2, -1, -1):
        here = rank[i]
        while rank[stack[-1]] > here:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return np.array(out)


def sequence_runs(symbols: list[int], exponent: int = 4, least: int = 6) -> np.ndarray:
    """Rows (start, length, period) of a sequence of positive numbers, by start, then period."""
    n = len(symbols)
    if n < max(least, 2):
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree(symbols)
    right, left = tree.extensions(), SuffixTree(symbols[::-1]).extensions()
    place, found = np.arange(n), []
    for descending in (False, True):
        # The longest Lyndon word at a place ends where the next smaller suffix begins.
        end = _next_smaller(tree.leaves(descending))
        start = place - left.shared(n - place, n - end)
        stop = end + right.shared(place, end)
        period = end - place
        keep = stop - start >= np.maximum(least, exponent * period)
        found.append(np.stack([start, stop - start, period], axis=1)[keep])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _stretches(hashes: np.ndarray, counts: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the stretches that may hold runs. ``counts``: words of each text.

    Equal hashes of different words only leave more to look at.
    """
    at, part = np.arange(len(hashes)), np.repeat(np.arange(len(counts)), counts)
    while len(at):
        _, inverse, times = np.unique(hashes[at] ^ mix(part.astype(U64) + U64(1)), return_inverse=True, return_counts=True)
        kept = times[inverse] >= exponent
        whole = bool(kept.all())
        at, part = at[kept], part[kept]
        if not len(at):
            break
        fresh = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(part) != 0)])
        begin = np.flatnonzero(fresh)
        sizes = np.diff(np.append(begin, len(at)))
        long = sizes >= least
        if whole and long.all():
            return at[begin], sizes
        at, part = at[np.repeat(long, sizes)], np.repeat(np.arange(int(long.sum())), sizes[long])
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def text_runs(texts: pa.Array, exponent: int = 4, least: int = 6) -> tuple[list[np.ndarray], list[bytes]]:
    """Of each text its runs and the text less what its runs repeat, words joined by one space."""
    data, offsets = flat(texts)
    starts, ends = words(data, offsets, SOLID)
    edge = np.searchsorted(starts, offsets)
    runs = [np.zeros((0, 3), np.int64)] * len(texts)
    first, sizes = _stretches(hash_spans(data, starts, ends), np.diff(edge), exponent, least)
    owner = np.searchsorted(edge, first, "right") - 1
    raw = data.tobytes()
    for k in range(len(first)):
        known: dict[bytes, int] = {}
        span = slice(first[k], first[k] + sizes[k])
        symbols = [known.setdefault(raw[a:b], len(known) + 1) for a, b in zip(starts[span].tolist(), ends[span].tolist(), strict=True)]
        rows = sequence_runs(symbols, exponent, least)
        if len(rows):
            rows[:, 0] += first[k] - edge[owner[k]]
            runs[owner[k]] = np.concatenate([runs[owner[k]], rows])
    collapsed = []
    for k, rows in enumerate(runs):
        own = raw[offsets[k] : offsets[k + 1]].split()
        if len(rows):
            change = np.zeros(len(own) + 1, np.int64)
            np.add.at(change, rows[:, 0] + rows[:, 2], 1)
            np.add.at(change, rows[:, 0] + rows[:, 1], -1)
            own = [own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        collapsed.append(b" ".join(own))
    return runs, collapsed


def find_runs(docs: DataFrame, keep: list[str] | None = None, exponent: int = 4, least: int = 6) -> DataFrame:
    """Columns ``runs`` (start, length and period in words, by start, then period), ``n_words`` and ``collapsed``.

    Words are runs of anything outside ``[\\x20\\x09-\\x0D]``, compared as they are. A run holds its period ``exponent``
    times (2 at least) and ``least`` words. ``collapsed`` is the text without the words that stand in any run after its
    first period. Nothing is shuffled; a row needs memory in proportion to its longest repetitive stretch.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Repeated rows, null ids and other columns
    stay as they are; columns of the new names are replaced. An empty table gives an empty one.
    """
    if exponent < 2:
        raise ValueError("a run holds its period twice at least")

    def made(texts: pa.Array) -> list[pa.Array]:
        runs, collapsed = text_runs(texts, exponent, least)
        rows = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
        places = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        structs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
        n_words = np.array([len(t.split()) if t else 0 for t in texts.cast(pa.large_binary()).to_pylist()], np.int64)
        return [pa.ListArray.from_arrays(places, structs).cast(_RUN_TYPE), pa.array(n_words), pa.array(collapsed, pa.binary()).cast(pa.string())]

    return map_text(docs, made, f"runs {RUNS}, n_words bigint, collapsed string", keep)
