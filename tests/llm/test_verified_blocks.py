"""Pairs verified in blocks are those verified one by one."""

from __future__ import annotations

import random

from linework.llm import simhash_gph


def brute(pairs, sets):
    return sorted((a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)


def test_blocks_find_what_single_pairs_find(spark, monkeypatch):
    r = random.Random(5)
    base = range(60)
    sets = {n: {x if r.random() > 0.08 else r.getrandbits(40) for x in base} for n in range(50)}
    sets |= {100: {1, 2, 3}, 101: {1, 2, 3}, 102: set(), 103: {9}, 104: set(range(3000)), 105: set(range(2500))}
    pairs = [(a, b) for a in range(50) for b in range(a + 1, 50)] + [(100, 101), (102, 103), (104, 105)]
    p = spark.createDataFrame(pairs, "a long, b long")
    s = spark.createDataFrame([(n, sorted(x)) for n, x in sets.items()], "node long, s array<bigint>")
    want = brute(pairs, sets)
    assert 0 < len(want) < len(pairs)
    for part, shingles in ((64, 10**6), (7, 10**6), (64, 100)):
        monkeypatch.setattr(simhash_gph, "PART", part)
        monkeypatch.setattr(simhash_gph, "PART_SHINGLES", shingles)
        assert sorted(tuple(x) for x in simhash_gph.verified_in_blocks(p, s, 0.8).collect()) == want
    assert sorted(tuple(x) for x in simhash_gph.verified(p, s, 0.8).collect()) == want
    assert simhash_gph.verified_in_blocks(p.where("false"), s, 0.8).count() == 0
