"""Quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are its own, its neighbours' and whether it ends the text; transitions tie
neighbours together. Forward-backward marginals of the good state, weighted by line length, are the document's score.
Labels are of documents, so in training every line of a document carries the document's label.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrow import SOLID, flat, hash_spans, map_text, words

#: The most labelled documents of each label that a fit reads, the first by a hash of doc_id.
DOCUMENTS = 4_000

_UPPER, _LETTER, _DIGIT, _SYMBOL = (np.zeros(256, dtype=bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_SYMBOL[33:127] = ~(_LETTER | _DIGIT)[33:127]
_BAR = np.zeros(256, dtype=bool)
_BAR[124] = True
OWN = 11


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines by features, line lengths in bytes and one more, lines of each text). An empty text is one empty line."""
    data, offsets = flat(column)
    breaks = np.flatnonzero(data == 10)
    per_text = np.searchsorted(breaks, offsets)
    counts = np.diff(per_text) + 1
    # Lines begin with their text or behind a line end, and stop before a line end or with their text.
    owner = np.repeat(np.arange(len(column)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    behind = per_text[owner] + nth
    padded = np.concatenate([[-1], breaks, [-1]])
    starts = np.where(nth == 0, offsets[owner], padded[behind] + 1)
    stops = np.where(nth == counts[owner] - 1, offsets[owner + 1], padded[behind + 1])
    length = stops - starts

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[stops] - sums[starts]

    same = np.zeros(len(data), dtype=bool)
    same[1:] = data[1:] == data[:-1]
    symbol = _SYMBOL[data]
    w_starts, w_ends = words(data, offsets, SOLID)
    hashes = hash_spans(data, w_starts, w_ends)
    line = np.searchsorted(starts, w_starts, "right") - 1
    n_words = np.bincount(line, minlength=len(starts))
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[again], minlength=len(starts))
    letters = count(_LETTER[data])
    chars, each = np.maximum(1, length), np.maximum(1, n_words)
    own = np.column_stack([
        np.log1p(length),
        letters / chars,
        count(_UPPER[data]) / np.maximum(1, letters),
        count(_DIGIT[data]) / chars,
        count(symbol) / chars,
        np.sqrt(count(symbol) / each),
        count(symbol & same) / each,
        np.minimum(count(_BAR[data]) / each, 1),
        np.log1p(length / each),
        repeats / each,
        np.sqrt(repeats / each),
    ])
    first, last = nth == 0, nth == counts[owner] - 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    x = np.column_stack([own, before, after, first, last]).astype(np.float32)
    return x, (length + 1).astype(float), counts


def _steps(counts: np.ndarray):
    """Texts by their number of lines, most first, with the place of the first line of each and how many go on at step t."""
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    active = np.searchsorted(-counts[order], -np.arange(1, (counts.max() if len(counts) else 0) + 1), "right")
    return starts, active


def forward_backward(u: np.ndarray, t: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the good state given the lines up to here (a), and what the later lines add (b).

    ``u``: log odds of each line by itself; ``t``: 2 x 2 transition scores, from row to column, good being 1. The
    logistic function of a + b is the marginal. Texts advance side by side; finished ones drop out.
    """
    starts, active = _steps(counts)
    a, b = u.copy(), np.zeros_like(u)
    for k in range(1, len(active)):
        at = starts[: active[k]] + k
        before = a[at - 1]
        a[at] += np.logaddexp(before + t[1, 1], t[0, 1]) - np.logaddexp(before + t[1, 0], t[0, 0])
    for k in range(len(active) - 1, 0, -1):
        at = starts[: active[k]] + k
        after = u[at] + b[at]
        b[at - 1] = np.logaddexp(after + t[1, 1], t[1, 0]) - np.logaddexp(after + t[0, 1], t[0, 0])
    return a, b


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model(NamedTuple):
    """Standardisation, weights with the offset last, and transitions."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        x, length, counts = line_features(column)
        u = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        a, b = forward_backward(u, self.transitions, counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        good = np.bincount(owner, _logistic(a + b) * length, len(counts))
        return np.clip(good / np.bincount(owner, length, len(counts)), 0, 1)


def crf_fit(x: np.ndarray, counts: np.ndarray, good: np.ndarray, rounds: int = 150, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Maximise the conditional likelihood, each document weighing the same, by full-batch Adam."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    owner = np.repeat(np.arange(len(counts)), counts)
    y, weight = good[owner].astype(float), 1.0 / (counts[owner] * len(counts))
    inner = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    theta = np.zeros(z.shape[1] + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        t = theta[-4:].reshape(2, 2)
        u = z @ theta[: z.shape[1]] + theta[z.shape[1]]
        a, b = forward_backward(u, t, counts)
        step = (_logistic(a + b) - y) * weight
        grad_t = np.zeros((2, 2))
        if len(inner):
            before, after = a[inner - 1], u[inner] + b[inner]
            pair = np.stack([t[0, 0] + 0 * before, t[0, 1] + after, t[1, 0] + before, t[1, 1] + before + after])
            pair = np.exp(pair - pair.max(axis=0))
            expected = (pair / pair.sum(axis=0) * weight[inner]).sum(axis=1).reshape(2, 2)
            seen = np.diag([(weight[inner] * (1 - y[inner])).sum(), (weight[inner] * y[inner]).sum()])
            grad_t = expected - seen
        grad = np.concatenate([z.T @ step, [step.sum()], grad_t.ravel()]) + decay * np.concatenate([theta[: z.shape[1]], [0], theta[-4:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Model(mean, scale, theta[: z.shape[1] + 1], theta[-4:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, documents: int = DOCUMENTS) -> Model:
    """Fit on documents of ``docs`` with ``labels`` (doc_id, quality 0 or 1); pass only rows that may be learnt from.

    At most ``documents`` of each label are read. Rows with a null doc_id, text or label are not learnt from; without
    any, every text scores one half. Distinct texts count once.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    each = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents) for q in (0, 1)]
    ids = each[0].unionByName(each[1]).dropDuplicates(["doc_id"])
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["text"])
    width = OWN * 3 + 2

    def features(column: pa.Array) -> list[pa.Array]:
        x, _, counts = line_features(column)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts) * width]), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(x.ravel(), pa.float32()))]

    read = map_text(texts, features, "x array<float>", ["quality"]).toArrow()
    if not read.num_rows:
        return Model(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)))
    lists = read.column("x").combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) // width
    return crf_fit(x, counts, read.column("quality").to_numpy(zero_copy_only=False))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: good likelier), which replaces a column of this name.

    Only the text counts. Null and empty texts are one empty line. ``keep`` names the columns to carry (default all).
    Repeated rows score alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, lambda column: [pa.array(shared.value.scores(column))], "score double", keep)
