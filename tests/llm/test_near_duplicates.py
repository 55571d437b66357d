"""The near-dedup stage asks for exact likeness of 5-word shingles."""

import random

from linework.llm import simhash_gph


def pair(r, n, shared):
    """Two texts of n shingles each, of which they share so many."""
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=8))
    head = [word() for _ in range(shared + 4)]
    return [" ".join(head + [word() for _ in range(n - shared)]) for _ in range(2)]


def test_only_pairs_from_the_likeness_on_are_linked(spark):
    r = random.Random(11)
    texts = [t for n, shared in ((350, 300), (450, 400), (180, 160)) for _ in range(30) for t in pair(r, n, shared)]
    a, b = (set(simhash_gph.shingle_hashes(t, 5).tolist()) for t in texts[60:62])
    assert len(a & b) / len(a | b) == 0.8
    # votes that one shingle wins: equal fingerprints of texts that are not alike
    alone = " ".join(["same"] * 400)
    texts += [alone, f"{alone} {pair(r, 40, 0)[0]}"]
    assert simhash_gph.simhash(texts[-1], 5, 4) == simhash_gph.simhash(texts[-2], 5, 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in simhash_gph.drop_near_duplicates(df).collect()}
    assert all(i in kept for i in range(60)), "pairs at 0.75 are no near-duplicates"
    assert {180, 181} <= kept
    left = sum(i in kept for i in range(61, 180, 2))
    assert all(i in kept for i in range(60, 180, 2)) and left <= 2, "pairs at 0.8 are"
