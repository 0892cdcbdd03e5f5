"""Benchmark decontamination: documents against a broadcast hash set of test n-grams.

Words are runs of ASCII letters (lower-cased), ASCII digits and everything outside ASCII. A test item yields all its
windows of ``n`` words, or is one window itself if it has fewer. Documents are scanned once; window hashes meet the set,
and a hit counts only if its words are those of the window.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracewell.llm.arrow import LOWER, U64, WORD, flat, hash_spans, map_text, slices, windows, words

#: Bytes of test items in one broadcast set, which takes some 70 times as much in a worker. A larger benchmark is scanned
#: in so many more passes, each with its own set.
BLOCK_BYTES = 2 << 20
N = 13
_FIELDS = "n_words long, ranges array<struct<first:int,last:int>>, items array<string>"


class NgramSet:
    """The windows of some test items: sorted hashes by window length, and the items of each window's words."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.items = [i for i, _ in items]
        self.owners: dict[bytes, list[int]] = defaultdict(list)
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            low, starts, ends, hashes, counts = _words(pa.array([text], pa.string()))
            size = min(n, len(hashes))
            if not size:
                continue
            found[size].append(windows(hashes, counts, size)[0])
            for i in range(len(hashes) - size + 1):
                owners = self.owners[_phrase(low, starts, ends, i, size)]
                if not owners or owners[-1] != k:
                    owners.append(k)
        self.hashes = {size: np.unique(np.concatenate(h)) for size, h in found.items()}
        self.filters = {}
        for size, hashes in self.hashes.items():
            bits = max(16, int(len(hashes) * 16 - 1).bit_length())
            seen = np.zeros(1 << bits, dtype=bool)
            seen[hashes >> U64(64 - bits)] = True
            self.filters[size] = (U64(64 - bits), seen)

    def hits(self, low, starts, ends, hashes, counts) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, number of words, items) of every window that occurs in the texts."""
        for size, known in self.hashes.items():
            own, first = windows(hashes, counts, size)
            shift, seen = self.filters[size]
            maybe = np.flatnonzero(seen[own >> shift])
            if len(maybe):
                place = np.minimum(np.searchsorted(known, own[maybe]), len(known) - 1)
                for i in first[maybe[known[place] == own[maybe]]]:
                    if owners := self.owners.get(_phrase(low, starts, ends, i, size)):
                        yield int(i), size, owners


def _words(column: pa.Array):
    data, offsets = flat(column)
    starts, ends = words(data, offsets, WORD)
    low = LOWER[data]
    counts = np.diff(np.searchsorted(starts, offsets))
    return low, starts, ends, hash_spans(low, starts, ends), counts


def _phrase(low, starts, ends, i: int, size: int) -> bytes:
    return b" ".join(low[s:e].tobytes() for s, e in zip(starts[i : i + size], ends[i : i + size], strict=True))


def _scan(column: pa.Array, grams: NgramSet) -> list[pa.Array]:
    low, starts, ends, hashes, counts = _words(column)
    before = np.concatenate([[0], np.cumsum(counts)])
    marks, owned = np.zeros(len(starts) + 1, np.int64), defaultdict(set)
    for i, size, owners in grams.hits(low, starts, ends, hashes, counts):
        marks[i] += 1
        marks[i + size] -= 1
        owned[int(np.searchsorted(before, i, "right")) - 1].update(owners)
    hit = np.cumsum(marks)[:-1] > 0
    ranges: list[list[dict]] = [[] for _ in counts]
    for d in owned:
        own = np.concatenate([[0], hit[before[d] : before[d + 1]].astype(np.int8), [0]])
        step = np.diff(own)
        ranges[d] = [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
    items = [sorted(grams.items[k] for k in owned.get(d, ()) if grams.items[k] is not None) for d in range(len(counts))]
    return [
        pa.array(counts, pa.int64()),
        pa.array(ranges, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        pa.array(items, pa.list_(pa.string())),
    ]


def _covered(ranges: Column) -> Column:
    """Words in any of the ranges, which may overlap."""
    return F.aggregate(
        F.array_sort(ranges),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("upto")),
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(acc["upto"], r["first"] - 1))).alias("n"),
            F.greatest(acc["upto"], r["last"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) // block_bytes) or 1
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, ranges, items and contaminated, which replace columns of these names.

    ``ranges`` are the runs of hit words (first and last, counted from 0), ``items`` the sorted item_ids that occur. A
    document is contaminated if hit words come to a twentieth of its words or more. Null and empty texts have no words;
    items without words never occur; items without an item_id hit words, but are not named; items that share an id count
    as one. Rows of ``docs`` are judged each by itself, whatever their doc_id. An empty benchmark leaves every document
    clean; empty ``docs`` give no rows. ``keep`` names the columns to carry (default all). The benchmark is read to the
    driver in blocks of about ``block_bytes``; a text passes the sets of all blocks in one task.
    """
    sc = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, block_bytes)
    carried = docs.columns if keep is None else keep
    names = [c for c in carried if c not in _MADE]
    out = docs.select(*dict.fromkeys([*names, "text"]))
    for block in blocks:
        grams = sc.broadcast(NgramSet([tuple(r) for r in block.collect()], n))
        first = "ranges" not in out.columns
        before = out if first else out.withColumnsRenamed({"ranges": "_ranges", "items": "_items"})
        out = map_text(before, lambda column, grams=grams: _scan(column, grams.value), _FIELDS)
        if not first:
            joined = {"ranges": F.concat("_ranges", "ranges"), "items": F.concat("_items", "items")}
            out = out.withColumns(joined).drop("_ranges", "_items")
    out = out.select(*names, "n_words", "ranges", "items")
    hit = _covered(F.col("ranges"))
    return out.withColumns({"items": F.array_sort(F.array_distinct("items")), "n_hit": hit}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    )


_MADE = ["n_words", "ranges", "items", "n_hit", "contaminated"]


def _own(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its own columns out of the way of the new ones, and how to name them back."""
    away = {c: f"_own_{c}" if c in _MADE else c for c in docs.columns}
    return docs.withColumnsRenamed(away), [F.col(new).alias(old) for old, new in away.items()]


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The documents that are not contaminated, whole and with their own columns."""
    away, back = _own(docs)
    return find_contamination(away, benchmark, n).where(~F.col("contaminated")).select(*back)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with every run of hit words cut from ``text``, blanks and marks between hit words included."""
    away, back = _own(docs)
    found = find_contamination(away, benchmark, n).select(*back, F.col("ranges").alias("_hit_ranges"))
    schema = StructType([StructField(c, docs.schema[c].dataType, True) for c in docs.columns])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat(part.column("text"))
                starts, ends = words(data, offsets, WORD)
                texts = part.column("text").to_pylist()
                for d, ranges in enumerate(part.column("_hit_ranges").to_pylist()):
                    if ranges:
                        base, raw = int(np.searchsorted(starts, offsets[d])), []
                        at = offsets[d]
                        for r in sorted(ranges, key=lambda r: r["first"]):
                            if starts[base + r["first"]] > at:
                                raw.append(data[at : starts[base + r["first"]]].tobytes())
                            at = max(at, ends[base + r["last"]])
                        raw.append(data[at : offsets[d + 1]].tobytes())
                        texts[d] = b"".join(raw).decode()
                made = {"text": pa.array(texts, part.column("text").type)}
                yield pa.RecordBatch.from_arrays([made.get(c, part.column(c)) for c in schema.names], schema.names)

    return found.mapInArrow(cut, schema)
