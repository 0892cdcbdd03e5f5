"""Periodic runs against all periods tried at all places."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import SCHEMA, awkward, nothing
from tracewell.llm import periodic_runs
from tracewell.llm.catalog import op11_periodic_runs
from tracewell.llm.periodic_runs import SuffixTree, sequence_runs, text_runs


def plain_runs(w, exponent=4, least=6):
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            shorter = any(all(w[k] == w[k + p] for k in range(i, i + size - p)) for p in range(1, q))
            if size >= max(least, exponent * q) and not shorter:
                found.append((i, size, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {k for start, size, q in runs for k in range(start + q, start + size)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40), st.integers(1, 7), st.integers(0, 30), st.sampled_from([(4, 6), (2, 2), (3, 5)]))
def test_runs_of_sequences(base, period, size, limits):
    w = base + [1 + (k % period) % 4 for k in range(size)]
    assert [tuple(r) for r in sequence_runs(w, *limits).tolist()] == plain_runs(w, *limits)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=40))
def test_extensions_are_common_beginnings(w):
    tree = SuffixTree(w)
    shared = tree.extensions()
    pairs = [(a, b) for a in range(len(w) + 1) for b in range(a)]
    import numpy as np

    got = shared.shared(*np.array(pairs).T).tolist()
    for (a, b), n in zip(pairs, got, strict=True):
        common = 0
        while max(a, b) + common < len(w) and w[a + common] == w[b + common]:
            common += 1
        assert n == common
    assert tree.leaves(False).tolist() == sorted(range(len(w) + 1), key=lambda i: w[i:])
    assert tree.leaves(True).tolist() == sorted(range(len(w) + 1), key=lambda i: [-x for x in w[i:]])


def test_cuts_lose_no_run():
    rng = random.Random(5)
    for _ in range(60):
        w = [f"w{rng.randrange(12)}" for _ in range(rng.randrange(80))]
        at, q = rng.randrange(len(w) + 1), rng.randrange(1, 6)
        w[at:at] = [f"v{k % q}" if q < 4 else f"w{k % q}" for k in range(rng.randrange(30))]
        runs, collapsed = text_runs(pa.array([" ".join(w), None, "\t" + "\n".join(w) + " end"]))
        assert [tuple(r) for r in runs[0].tolist()] == plain_runs(w)
        assert [tuple(r) for r in runs[2].tolist()] == plain_runs([*w, "end"])
        assert collapsed[0].decode() == plain_collapsed(w, plain_runs(w)) and collapsed[1] == b""


def test_a_long_repetitive_text():
    w = ["a", "b", "c"] * 20_000 + ["d"] + ["e"] * 10
    runs, collapsed = text_runs(pa.array([" ".join(w)]))
    assert runs[0].tolist() == [[0, 60_000, 3], [60_001, 10, 1]] and collapsed == [b"a b c d e"]


def rebuilt(doc_id, text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query_against_a_plain_version(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(70))), "en", "s", 1) for i in range(300)]
    rows += [(400 + i, "spam " * i + "x y " * i, "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(awkward(spark))
    docs.withColumnRenamed("n_chars", "runs").write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for r in docs.collect():
        w = rebuilt(r.doc_id, r.text)
        runs = plain_runs(w) if len(w) < 1000 else [tuple(x) for x in sequence_runs([hash(x) % (1 << 40) + 1 for x in w]).tolist()]
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        milli = None if top[0] is None else 1000 * top[1] // top[2]
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((r.doc_id, len(runs), *top, milli, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(plain_collapsed(w, runs))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r.n_runs > 0 for r in got) > 40


def test_empty_table_and_bad_exponent(spark):
    out = periodic_runs.find_runs(nothing(spark))
    assert out.count() == 0 and out.columns[-3:] == ["runs", "n_words", "collapsed"]
    with pytest.raises(ValueError):
        periodic_runs.find_runs(nothing(spark), exponent=1)
