"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else in the sample is unlabelled. A numpy classifier over word
features minimises the class-prior-corrected risk: pi * R+(positive) + max(0, R-(unlabelled) - pi * R-(positive)).
When the corrected term falls below zero the step reverses it, so the model cannot memorise unlabelled text as clean.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrow import LOWER, U64, WORD, flat, hash_spans, map_text, mix, words, release

#: The most documents a fit reads: positives, and unlabelled.
POSITIVES = 6_000
UNLABELLED = 12_000
#: Word features of a model, and in how many positives a feature has to occur.
FEATURES = 4096
LEAST = 3
#: The least log likelihood ratio of a feature.
EVIDENCE = 6.0
PREFIXES = (4, 5, 6)


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and word beginning in the texts, repeats included.

    A beginning counts only where the word goes on: stems with many endings are one feature.
    """
    data, offsets = flat(column)
    low = LOWER[data]
    starts, ends = words(data, offsets, WORD)
    owner = np.searchsorted(offsets, starts, "right") - 1
    found, owners = [hash_spans(low, starts, ends)], [owner]
    for k in PREFIXES:
        longer = np.flatnonzero(ends - starts > k)
        found.append(mix(hash_spans(low, starts[longer], starts[longer] + k) + U64(k)))
        owners.append(owner[longer])
    return np.concatenate(owners), np.concatenate(found)


class Model(NamedTuple):
    """Sorted feature hashes, their weights, and the offset."""

    features: np.ndarray
    weights: np.ndarray
    offset: float

    def scores(self, column: pa.Array) -> np.ndarray:
        owner, found = _features(column)
        total = np.full(len(column), self.offset)
        if len(self.features) and len(found):
            bits = U64(48)
            seen = np.zeros(1 << 16, dtype=bool)
            seen[self.features >> bits] = True
            maybe = np.flatnonzero(seen[found >> bits])
            place = np.minimum(np.searchsorted(self.features, found[maybe]), len(self.features) - 1)
            same = self.features[place] == found[maybe]
            pairs = np.unique(owner[maybe[same]] * len(self.features) + place[same])
            total += np.bincount(pairs // len(self.features), self.weights[pairs % len(self.features)], len(column))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def nnpu_fit(
    rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, width: int, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear model under the non-negative PU risk with the logistic loss, by full-batch Adam.

    (rows, columns): which document has which feature; ``positive``: which documents are confirmed, the others being
    unlabelled. With no positives, nothing unlabelled or no features, the model is the prior alone.
    """
    offset = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u or not width:
        return np.zeros(width), offset
    theta = np.concatenate([np.zeros(width), [offset]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        f = np.bincount(rows, theta[columns], len(positive)) + theta[-1]
        clean, score = np.logaddexp(0, f), 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        if clean[~positive].mean() >= prior * clean[positive].mean():
            step = np.where(positive, prior * (score - 1 - score) / n_p, score / n_u)
        else:  # the estimate of the clean part's risk is below zero: climb back
            step = np.where(positive, prior * score / n_p, -score / n_u)
        grad = np.concatenate([np.bincount(columns, step[rows], width) + decay * theta[:-1], [step.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _sampled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct texts of at most so many documents as ``ids`` names, which is bounded."""
    return docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi").dropDuplicates(["text"])


def _counts(columns: np.ndarray, rows: np.ndarray, chosen: np.ndarray, width: int, step: int = 1 << 20) -> np.ndarray:
    """How many of the chosen rows have each column, a piece at a time."""
    out = np.zeros(width, np.int64)
    for i in range(0, len(columns), step):
        out += np.bincount(columns[i : i + step][chosen[rows[i : i + step]]], minlength=width)
    return out


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on documents of ``docs`` that ``labels`` (doc_id, toxic) confirms, and on others whatever their label.

    Pass only the rows that may be learnt from. Both samples are the first by a hash of doc_id. The class prior is the
    share of toxic rows among the labelled ones. Rows with a null doc_id, text or label are not learnt from. Without
    positives or unlabelled texts the model is the prior alone.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = min(max(share or 0.0, 1e-4), 0.9)
    first = lambda ids, n: ids.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    p = _sampled(docs.where("text IS NOT NULL"), first(known.where("toxic = 1"), positives))
    u = _sampled(docs.where("text IS NOT NULL"), first(docs, unlabelled))

    def distinct(column: pa.Array) -> list[pa.Array]:
        owner, found = _features(column)
        pairs = np.unique(np.rec.fromarrays([owner, found]))
        ends = np.searchsorted(pairs.f0, np.arange(len(column) + 1))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs.f1.view(np.int64), pa.int64()))]

    counted = map_text(p, distinct, "found array<long>", ["doc_id"]).select(F.explode("found").alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    often = counted.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "f").limit(16 * FEATURES)
    candidates = np.sort(np.array([r.f for r in often.select("f").collect()], np.int64).view(U64))
    if not len(candidates):
        return Model(candidates, np.zeros(0), float(np.log(prior / (1 - prior))))
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def places(column: pa.Array) -> list[pa.Array]:
        owner, found = _features(column)
        at = np.minimum(np.searchsorted(shared.value, found), len(shared.value) - 1)
        same = shared.value[at] == found
        pairs = np.unique(owner[same] * len(shared.value) + at[same])
        ends = np.searchsorted(pairs // len(shared.value), np.arange(len(column) + 1))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs % len(shared.value), pa.int32()))]

    both = p.withColumn("is_p", F.lit(True)).unionByName(u.withColumn("is_p", F.lit(False)))
    sample = map_text(both, places, "at array<int>", ["is_p"]).toArrow()
    positive = sample.column("is_p").to_numpy(zero_copy_only=False).astype(bool)
    lists = sample.column("at").combine_chunks()
    columns = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(positive), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    del sample, lists
    in_p = _counts(columns, rows, positive, len(candidates)) / max(1, positive.sum())
    in_u = (_counts(columns, rows, ~positive, len(candidates)) + 0.5) / max(1, (~positive).sum())
    # Features that tell the samples apart, in either direction, those first that tell most; chance ones stay out.
    far_p, far_u = np.clip(1 - in_p, 1e-12, 1), np.clip(1 - in_u, 1e-12, 1)
    telling = in_p * np.log(np.maximum(in_p, 1e-12) / in_u) + far_p * np.log(far_p / far_u)
    telling = np.where(telling * positive.sum() > EVIDENCE, telling, 0)
    best = np.sort(np.argsort(-telling, kind="stable")[:FEATURES])
    best = best[telling[best] > 0]
    new = np.full(len(candidates), -1, np.int32)
    new[best] = np.arange(len(best))
    columns = new[columns]
    kept = columns >= 0
    rows, columns = rows[kept], columns[kept]
    release()
    weights, offset = nnpu_fit(rows, columns, positive, len(best), prior)
    return Model(candidates[best], weights, offset)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier), which replaces a column of this name.

    Only the text counts. Null and empty texts score what no feature at all scores. ``keep`` names the columns to carry
    (default all). Repeated rows score alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, lambda column: [pa.array(shared.value.scores(column))], "score double", keep)
