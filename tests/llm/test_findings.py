"""What reviews found in the operators on training data."""

from __future__ import annotations

import numpy as np

from tracewell.llm.arrow import U64
from tracewell.llm.jaccard_join import needed, signatures


def _signed(sets: list[np.ndarray], threshold: int) -> list[set[int]]:
    """Signatures of every set as one task makes them."""
    owner, signed = signatures(np.concatenate([np.sort(x) for x in sets]), np.array([len(x) for x in sets]), threshold)
    return [set(signed[owner == k].tolist()) for k in range(len(sets))]


def test_strangers_share_no_signatures():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, rng.integers(30, 400)).astype(U64) for _ in range(600)]
    signed = _signed(sets, 80)
    every = np.concatenate([np.array(list(s), U64) for s in signed])
    assert len(np.unique(every)) == len(every)


def test_linked_sets_share_as_many_signatures_as_needed():
    rng = np.random.default_rng(5)
    for threshold in (80, 85):
        sets = []
        for size in [*range(1, 60)] * 6 + [100, 101, 150, 300, 700] * 12:
            base = rng.integers(0, 2**63, size).astype(U64)
            # As far apart as the threshold allows: some shingles gone, some others instead.
            gone = int(rng.integers(0, size * (100 - threshold) // (100 + threshold) + 1))
            new = rng.integers(0, 2**63, size).astype(U64)[: int(rng.integers(0, gone + 1))]
            sets += [base, np.concatenate([base[gone:], new])]
        signed, need = _signed(sets, threshold), needed(np.array([len(x) for x in sets]), threshold)
        linked = 0
        for k in range(0, len(sets), 2):
            x, y = sets[k], sets[k + 1]
            both = len(np.intersect1d(x, y))
            if both * 100 >= threshold * (len(x) + len(y) - both):
                linked += 1
                assert len(signed[k] & signed[k + 1]) >= max(need[k], need[k + 1])
        assert linked > 200
