"""The prefix trie against sets of prefixes, and its parts."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.llm import prefix_trie
from tracewell.llm.catalog import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def plain_nodes(sequences):
    """{prefix: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends)}"""
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                kids[tuple(s[: d - 1])].add(tuple(s[:d]))
    saved, leaves, out = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        saved[p] = own + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        ends = sorted(c for c in members[p] if len(sequences[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out[p] = (min(members[p]), len(p), parent, len(members[p]), len(kids[p]), leaves[p], saved[p], ends)
    return out


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def rebuilt(rows):
    turns = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda q: q[:2])] for c, v in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + s[h[c] :] for c, s in own.items()}


def random_rows(rng, n, width, depth, most=6):
    return [(c, t, "user" if t % 2 else "bot", "t" * rng.randrange(width), 0) for c in range(n) for t in range(rng.randrange(depth + 1) or most)]


CASES = {
    "narrow": random_rows(random.Random(1), 300, 2, 9),
    "wide": random_rows(random.Random(2), 200, 40, 5),
    "equal": [(c, t, "u", "same", 0) for c in range(150) for t in range(4)],
    "comb": [(c, t, "u", "same" if t < c else f"end{c}", 0) for c in range(40) for t in range(c + 1)],
    "odd": [
        (5, None, None, None, 1), (5, 1, "u", "é🙂", 2), (7, None, "", "", 3), (7, 1, "u", "é🙂", 4), (None, 1, "u", "lost", 5), (100, 3, "a", "b" * 5000, 6),
        (103, 1, "x", "y", 7), (-4, 1, "x", "y", 8),
    ],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_trie_against_prefixes(spark, case):
    rows = [r for r in CASES[case] if r[0] is not None]
    own = defaultdict(list)
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((r or "", x or ""))
    trie = prefix_trie.prefix_trie(spark.createDataFrame(CASES[case], SCHEMA).repartition(3))
    ends = {r.key: r.ends_sha256 for r in prefix_trie.member_digests(trie.members, 16).collect()}
    nodes = trie.nodes.collect()
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, ends.get(r.key, digest([]))) for r in nodes]
    want = [(*v[:-1], digest(v[-1])) for v in plain_nodes(own).values()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    depth = {r.key: r.depth for r in nodes}
    assert len(depth) == len(nodes) and all(depth[r.parent_key] == r.depth - 1 for r in nodes if r.depth)


@pytest.mark.parametrize("batches", [(1.0,), (0.5, 0.5), (0.1, 0.2, 0.3, 0.4)])
def test_batches_do_not_change_the_trie(spark, batches):
    rows = prefix_trie.sequences(prefix_trie.digest_turns(spark.createDataFrame(CASES["narrow"], SCHEMA)))
    got = sorted(prefix_trie.build(rows, batches).nodes.collect())
    assert got == sorted(prefix_trie.build(rows).nodes.collect())


def test_two_fattest(spark):
    pairs = [(a, b) for b in range(1, 70) for a in range(b)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)


def test_location_is_the_deepest_node_passed(spark):
    paths = {c: [b"%d-%s" % (d, ("a" * d + "b" * (c if d > c else 0)).encode()) for d in range(1, 18)] for c in (3, 9, 12)}
    rows = [(c, b"e%d" % c, p, [1] * 17) for c, p in paths.items()]
    frame = spark.createDataFrame(rows, "conv_id long, end binary, path array<binary>, chars array<long>")
    trie = prefix_trie.insert(None, frame.where("conv_id <> 9"), 5)
    assert sorted((r.above, r.depth) for r in trie.collect()) == [(0, 3), (3, 17), (3, 17)]
    placed = {r.conv_id: r.passed for r in prefix_trie._locate(trie, frame, 5).collect()}
    assert placed == {3: 17, 9: 3, 12: 17}


def test_query_on_awkward_and_empty_tables(spark, tmp_path):
    rows = [*CASES["odd"], *[(c, t, "u", "x" * ((c + t) % 3), 0) for c in range(190, 260) for t in range(c % 7 + 1)], (300, 1, "u", "v", 0), (301, 1, "u", "v", 0)]
    for k, own in enumerate((rows, [])):
        folder = str(tmp_path / f"t{k}")
        spark.createDataFrame(own, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
        got = sorted(map(tuple, op12_prefix_trie(spark, folder).collect()), key=repr)
        assert got == sorted(((*v[:-1], digest(v[-1])) for v in plain_nodes(rebuilt(own)).values()), key=repr)
