"""Buckets that are large because the table is, not because fingerprints are near each other."""

from __future__ import annotations

import random

import numpy as np
import pytest

from linework.llm import common, simhash_gph
from tests.llm.test_operators import groups, labels_of


def near(fps, radius):
    f = np.array(fps, dtype=np.int64)
    return [(fps[i], fps[j]) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count((f[i + 1 :] ^ f[i]).view(np.uint64)) <= radius) + i + 1]


def crowd(n, close, r):
    """n fingerprints far apart, and more near some of them."""
    fps = {simhash_gph.signed(r.getrandbits(64)) for _ in range(n)}
    for f in r.sample(sorted(fps), close):
        bits = r.sample(range(64), r.choice((1, 3, 4, 5)))
        fps.add(simhash_gph.signed((f ^ sum(1 << b for b in bits)) & (1 << 64) - 1))
    return sorted(fps)


@pytest.mark.parametrize("radius", [4, 5])
def test_crowded_buckets_are_split(spark, monkeypatch, radius):
    fps, dense = crowd(4000, 300, random.Random(radius)), []
    real = simhash_gph.midpoint_links

    def counted(members, radius):
        # a member is dealt out 2,000 times and more: only what is near each other may be one
        assert (n := members.count()) < 700
        dense.append(n)
        return real(members, radius)

    monkeypatch.setattr(simhash_gph, "midpoint_links", counted)
    df = common.cut(spark.createDataFrame([(f,) for f in fps], "f long"))
    assert labels_of(simhash_gph.gph_links(df, radius, hot_bucket=1), fps) == groups(near(fps, radius), fps)
    assert dense and len(fps) > 4200


def test_runs_hold_each_bit_once():
    for n in (3, 5, 10):
        for width in (0, 2, 51):
            bits = tuple(range(7, 7 + width))
            runs = simhash_gph.runs_of(bits, n)
            assert len(runs) == n and sum(runs, ()) == bits
