"""Language ID by bit-sliced Bloom filters: one table whose slots hold a bit for every language.

A lookup ands the slots of an n-gram and so returns all languages whose filter holds it. A document's n-grams are
counted per language; counts are corrected for the share of n-grams that a filter of that fill lets through by chance.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.arrow import LOWER, U64, flat, map_text, mix

#: The most labelled documents a language's filter is learnt from, the first by a hash of doc_id.
DOCUMENTS = 5_000
#: N-grams of so many bytes, within words with one blank at either side.
SIZE = 5
#: An n-gram enters a language's filter from this share of its documents on, and if its share there is at least
#: ``DISTINCT`` of its greatest share in any language.
SHARE = 0.002
DISTINCT = 0.1
#: The most n-grams of one language, slots (a power of two), and slots an n-gram sets.
GRAMS = 20_000
SLOT_BITS = 20
PROBES = 2

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of every n-gram, repeats included. Runs of other characters read as one blank."""
    data, offsets = flat(column)
    owner = np.repeat(np.arange(len(column)), np.diff(offsets))
    letter = _LETTER[data]
    # Of a run of other bytes only the first stays; every text begins with one.
    keep = letter | np.concatenate([[True], letter[:-1]])
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    low, owner = np.where(letter, LOWER[data], 32)[keep], owner[keep]
    if len(low) < SIZE:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    n = len(low) - SIZE + 1
    code = np.zeros(n, U64)
    for k in range(SIZE):
        code = code << U64(8) | low[k : k + n].astype(U64)
    # Blanks only at the ends: an n-gram lies in one word.
    inner = np.ones(n, dtype=bool)
    for k in range(1, SIZE - 1):
        inner &= low[k : k + n] != 32
    whole = np.flatnonzero(inner & (owner[:n] == owner[SIZE - 1 :]))
    return owner[whole], mix(code[whole])


class Filters(NamedTuple):
    """``slots``: the languages' bits, a row of 64-bit words for every 64 languages; ``chance``: how likely an n-gram outside passes each language's filter."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray

    @staticmethod
    def probes(grams: np.ndarray) -> list[np.ndarray]:
        mask = U64((1 << SLOT_BITS) - 1)
        return [((grams >> U64(20 * k)) & mask).astype(np.int64) for k in range(PROBES)]

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For every n-gram the languages whose filters hold it, as bits of as many words as slots have."""
        first, *rest = self.probes(grams)
        out = self.slots[:, first]
        for at in rest:
            out = out & self.slots[:, at]
        return out

    def decide(self, column: pa.Array) -> tuple[list[str | None], np.ndarray]:
        """The language of every text and the share of it in the corrected counts; no n-gram: the first, and 0."""
        owner, grams = _grams(column)
        masks = self.masks(grams)
        total = np.bincount(owner, minlength=len(column)).astype(float)
        counts = np.zeros((len(self.languages), len(column)))
        for k in range(len(self.languages)):
            hit = np.bincount(owner[(masks[k // 64] >> U64(k % 64)) & U64(1) > 0], minlength=len(column))
            counts[k] = np.maximum(0, hit - self.chance[k] * total) / (1 - self.chance[k])
        if not self.languages:
            return [None] * len(column), np.zeros(len(column))
        best, whole = counts.argmax(axis=0), counts.sum(axis=0)
        share = np.where(whole > 0, counts.max(axis=0) / np.maximum(whole, 1e-12), 0.0)
        return [self.languages[k] for k in best], np.clip(share, 0, 1)


def fit(docs: DataFrame, documents: int = DOCUMENTS) -> Filters:
    """Fit on text and lang of ``docs``; pass only the rows that may be learnt from.

    Languages, however many, are put in order of their documents, most first, then by name. Rows with a null text or lang are not learnt from; without any, no language is known.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r["lang"] for r in sizes]
    slots = np.zeros((-(-len(languages) // 64), 1 << SLOT_BITS), U64)
    if not languages:
        return Filters([], slots, np.zeros(0))
    # Of each language the first documents by hash; ids alone are ranked, and tasks cut them down before they meet.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.select("lang", "doc_id").withColumn("rank", rank).where(F.col("rank") <= documents).select("doc_id")
    sample = known.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")

    def distinct(column: pa.Array) -> list[pa.Array]:
        owner, grams = _grams(column)
        pairs = np.unique(np.rec.fromarrays([owner, grams]))
        ends = np.searchsorted(pairs.f0, np.arange(len(column) + 1))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs.f1.view(np.int64), pa.int64()))]

    held = map_text(sample, distinct, "grams array<long>", ["lang"])
    read = {r["lang"]: r["count"] for r in sizes}
    counts = held.select("lang", F.explode("grams").alias("gram")).groupBy("gram").agg(
        *[F.sum((F.col("lang") == lang).cast("long")).alias(f"n{k}") for k, lang in enumerate(languages)]
    )
    shares = [F.col(f"n{k}") / float(min(documents, read[lang])) for k, lang in enumerate(languages)]
    greatest = F.greatest(*shares, F.lit(0.0))
    rows = counts.where(greatest >= SHARE).orderBy(F.desc(greatest), "gram").limit(GRAMS * len(languages)).collect()
    grams = np.array([r["gram"] for r in rows], np.int64).view(U64)
    table = np.array([[r[f"n{k}"] for k in range(len(languages))] for r in rows], float).reshape(len(rows), len(languages))
    table /= [min(documents, read[lang]) for lang in languages]
    for k in range(len(languages)):
        own = np.flatnonzero((table[:, k] >= SHARE) & (table[:, k] >= DISTINCT * table.max(axis=1)))
        own = own[np.argsort(-table[own, k], kind="stable")][:GRAMS]
        for at in Filters.probes(grams[own]):
            slots[k // 64, at] |= U64(1 << k % 64)
    fill = np.array([((slots[k // 64] >> U64(k % 64)) & U64(1)).mean() for k in range(len(languages))])
    return Filters(languages, slots, fill**PROBES)


def predict(docs: DataFrame, filters: Filters, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), which replace columns of these names.

    A null text, or one without a letter, is ``und`` with score 0. Where no filter holds any n-gram, or no language is
    known, the answer is the most common language, or ``und`` if there is none, with score 0. An empty table gives an empty one. Only the text counts;
    repeated rows answer alike. ``keep`` names the columns to carry (default all).
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(column: pa.Array) -> list[pa.Array]:
        languages, share = shared.value.decide(column)
        return [pa.array(languages, pa.string()), pa.array(share, pa.float64())]

    lettered = docs.withColumn("_lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    carried = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    found = map_text(lettered, run, "lang_pred string, score double", [*carried, "_lettered"])
    und = ~F.col("_lettered") | F.col("lang_pred").isNull()
    return found.withColumns({
        "lang_pred": F.when(und, "und").otherwise(F.col("lang_pred")), "score": F.when(und, 0.0).otherwise(F.col("score"))
    }).drop("_lettered")
