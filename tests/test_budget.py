"""Greedy admission against a sequential fold, over several rounds."""

from __future__ import annotations

import random

import pytest

from tracewell.operators.budget import Policy, admit_budget, stop_reason


def fold(rows, policy):
    files = total = 0
    cats, exts, seen, out = {}, {}, set(), {}
    for image, at, cat, ext, size, digest in sorted(rows, key=lambda r: r[1]):
        if digest in seen:
            out[at] = False
            continue
        ok = (
            size <= policy.max_file_bytes and files < policy.max_files_total and total + size <= policy.max_output_bytes
            and cats.get(cat, 0) < policy.category_cap(cat) and exts.get(ext, 0) < policy.max_files_per_extension
        )
        out[at] = ok
        if ok:
            files, total = files + 1, total + size
            cats[cat], exts[ext] = cats.get(cat, 0) + 1, exts.get(ext, 0) + 1
            seen.add(digest)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_fold(spark, seed):
    rng = random.Random(seed)
    policy = Policy(max_output_bytes=900, max_file_bytes=200, max_files_total=12, max_files_per_category=6, max_files_per_extension=4, category_caps={"c1": 2})
    rows = [
        ("img", at, f"c{rng.randrange(4)}", f"e{rng.randrange(5)}", rng.choice([5, 40, 90, 150, 260]), f"d{rng.randrange(60)}") for at in range(150)
    ]
    df = spark.createDataFrame(rows, "image_id string, ord long, category string, extension string, size long, digest string")
    got = admit_budget(df, policy)
    flags = {r.ord: r.admitted for r in got.collect()}
    assert flags == fold(rows, policy)
    assert got.where("NOT admitted AND denial IS NULL").isEmpty()
    assert stop_reason(got).first().files_written == sum(flags.values())


def test_exact_fit_is_allowed(spark):
    rows = [("i", 1, "a", "x", 60), ("i", 2, "a", "x", 41), ("i", 3, "a", "x", 40)]
    df = spark.createDataFrame(rows, "image_id string, ord long, category string, extension string, size long")
    got = {r.ord: (r.admitted, r.denial) for r in admit_budget(df, Policy(max_output_bytes=100)).collect()}
    assert got == {1: (True, None), 2: (False, "output budget of 100 B exhausted"), 3: (True, None)}


def test_nothing_is_limited_unless_asked_for(spark):
    df = spark.createDataFrame([("i", k, 1, "c", "e") for k in range(700)], "image_id string, ord long, size long, category string, extension string")
    for policy in (None, Policy(), Policy(min_confidence=70)):
        assert admit_budget(df, policy).where("admitted").count() == 700
    capped = admit_budget(df, Policy(max_output_bytes=650)).where("admitted")
    assert capped.count() == 650 and capped.agg({"ord": "max"}).first()[0] == 649
