"""Text operators against brute force on small tables, and what they do with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from linework.llm import common, fingerprints, licenses, line_dedup, mixing, packing, pii, quality, queries, simhash_gph, topk, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \t\n ", None, None), (4, "one", "en", "s1"), (4, "one", "en", "s1"), (None, "no id here at all", "de", "s2"), (5, "a b c d\na b c d", "fr", "s1"), (6, "word " * 30_000, "en", "s2"), (7, "Grüße ÄÖ 😀 x", "de", "s2")]


def odd(spark, rows=ODD):
    """Rows with nulls, blanks, repeats and a long text, and more columns whose names are like those of operators."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("row", F.lit("mine")).withColumn("H", F.lit(1)).withColumn("n_chars", F.char_length("text").cast("long"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def groups(pairs, items):
    up = {x: x for x in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


def near(fps, radius):
    u = np.array(sorted(fps), dtype=np.int64)
    d = np.bitwise_count((u[:, None] ^ u[None]).view(np.uint64))
    return [(int(u[i]), int(u[j])) for i, j in zip(*np.nonzero(np.triu(d <= radius, 1)))]


def planted(n=60, copies=25, flips=3, seed=5):
    r = random.Random(seed)
    out = set()
    for _ in range(n):
        f = r.getrandbits(64)
        out.add(f)
        for _ in range(copies if len(out) < 60 else r.randrange(3)):
            g = f
            for b in r.sample(range(64), r.randrange(flips + 1)):
                g ^= 1 << b
            out.add(g)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def labels_of(links, fps):
    own = {r.node: r.label for r in common.components(links).collect()}
    return {f: own.get(f, f) for f in fps}


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7)]
    got = {x.node: x.label for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups(pairs, {x for p in pairs if p[0] != p[1] for x in p})
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius,hot", [(4, 512), (4, 4), (3, 4)])
def test_gph_links_have_all_components(spark, radius, hot):
    fps = planted()
    df = common.cut(spark.createDataFrame([(f,) for f in fps], "f long"))
    got = labels_of(simhash_gph.gph_links(df, radius, hot), fps)
    assert got == groups(near(fps, radius), fps)


def test_gph_pairs_are_all_and_once(spark):
    fps = planted(30, 10)
    df = common.cut(spark.createDataFrame([(f,) for f in fps], "f long"))
    got = [tuple(r) for r in simhash_gph.gph_links(df, 9, midpoints=False).collect()]
    assert len(got) == len(set(got)) and sorted(got) == sorted(near(fps, 9))


@pytest.mark.parametrize("hot", [512, 3])
def test_block_tables_have_all_components(spark, hot):
    fps = planted(40, 20)
    df = common.cut(spark.createDataFrame([(f,) for f in fps], "f long"))
    assert labels_of(fingerprints.block_links(df, 3, hot), fps) == groups(near(fps, 3), fps)


def test_thresholds_cover_the_radius():
    pairs = [np.array([100.0, 500, 2000] + [9999] * 14)] * 4
    _, t = simhash_gph.thresholds([16] * 4, pairs, 1000, 6)
    assert sum(x + 1 for x in t) == 7
    counts = np.zeros(8)
    counts[[0, 1, 7]] = 2, 3, 1
    assert simhash_gph.pairs_by_distance(counts).tolist() == [14, 12, 6, 4]


def word_simhash(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_op2(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_near_dedup(spark, SF).collect()}
    own = {r.doc_id: word_simhash(r.text) for r in docs.collect()}
    assert {d: f"{f:016x}" for d, f in own.items()} == {d: f for d, (f, _) in got.items()}
    links = [(a, b) for a, b in combinations(sorted(own), 2) if (own[a] ^ own[b]).bit_count() <= 4]
    assert {d: c for d, (_, c) in got.items()} == groups(links, own)


def test_simhash_of_odd_rows(spark):
    got = [(r.doc_id, r.f, r.component_id) for r in simhash_gph.simhash_components(odd(spark)).collect()]
    assert len(got) == len(ODD)
    assert {(d, f) for d, f, _ in got if d in (1, 2, 3)} == {(1, 0), (2, 0), (3, 0)} and {c for d, _, c in got if d in (1, 2, 3)} == {1}
    assert simhash_gph.simhash_components(odd(spark, [])).count() == 0


def test_near_duplicates_go(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    base = [[word() for _ in range(300)] for _ in range(12)]
    rows = [(i, " ".join(w), "en", "s") for i, w in enumerate(base)]
    for i, w in enumerate(base[:6]):
        near_ = list(w)
        near_[50], near_[200] = "x", "y"  # ten of about 300 shingles
        rows += [(100 + i, " ".join(near_), "en", "s"), (200 + i, " ".join(w), "en", "s")]
    got = simhash_gph.drop_near_duplicates(odd(spark, rows))
    assert got.columns == odd(spark, rows).columns
    assert sorted(x.doc_id for x in got.collect()) == list(range(12))
    kept = [x.doc_id for x in simhash_gph.drop_near_duplicates(odd(spark)).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 5, 6, 7]
    assert simhash_gph.drop_near_duplicates(odd(spark, [])).count() == 0


def test_op3(spark, docs):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in queries.op3_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        h, after = len(t) // 2, rows[(i + 1) % len(rows)][1]
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()
    by_text = {}
    for d, t in rows:
        by_text.setdefault(t, set()).add(got[d].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_fingerprints_of_odd_rows(spark):
    got = fingerprints.edited_fingerprints(odd(spark)).collect()
    assert len(got) == len(ODD) and {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert {r.n_chars for r in got if r.doc_id == 7} == {12}
    one = fingerprints.edited_fingerprints(odd(spark, ODD[3:4])).first()
    assert one.near_next == 1 and fingerprints.edited_fingerprints(odd(spark, [])).count() == 0


def test_surrogates(spark):
    rows = [(1, "Mail a.B7@x-y.example.com or +1 (706) 555-3138, card 4644348398010899. IP 56.187.231.175."), (2, '+1 706 555-3138; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" Mr. John Smith, Mrs Smith, Frau Müller'), (3, "A clean text Is here, The 42 and."), (4, None), (5, "A.b7@X-Y.example.com 4111 1111 1111 1111 and 4111111111111111"), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    got = {r.doc_id: r for r in pii.pseudonymise(df).collect()}
    assert got[3].text == rows[2][1] and got[4].text is None and got[6].text == "" and got[1].entities_ == 4
    assert not any(x in got[1].text for x in ("a.B7@", "555-3138", "4644348398010899", "56.187.231.175"))
    digits = lambda s: re.sub(r"\D", "", s)
    a, b = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text), re.search(r"\+1 \d{3} \d{3}-\d{4}", got[2].text)
    assert digits(a[0]) == digits(b[0])
    mail, cards = got[5].text.split()[0], re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[5].text)
    assert mail.lower() == got[1].text.split()[1].lower() and digits(cards[0]) == cards[1]
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(cards[1][::-1])) % 10 == 0
    assert re.search(r"Mr\. [A-Z]\w+ [A-Z]\w+, Mrs [A-Z]\w+, Frau [A-Z]\w+", got[2].text) and "token = " in got[2].text
    again = {r.doc_id: r.text for r in pii.pseudonymise(df, key="other").collect()}
    assert again[1] != got[1].text
    assert pii.pseudonymise(df.where("false")).count() == 0


def test_surrogates_are_distinct(spark):
    ents = spark.createDataFrame([("ipv4", f"10.0.{i // 200}.{i % 200 + 1}", False) for i in range(3000)] + [("ssn", f"{i:09d}", False) for i in range(2000)] + [("name", f"name{i}", i % 2 == 0) for i in range(400)], "kind string, canon string, female boolean")
    got = pii.surrogates(common.cut(ents)).withColumn("norm", pii.canonical(F.col("new"), F.col("kind"))).toPandas()
    assert len(got) == 5400 and not got.duplicated(["kind", "norm"]).any()
    assert not set(zip(got.kind, got.norm)) & {tuple(r)[:2] for r in ents.collect()}


def test_op5(spark, docs):
    strip = " \t\n\x0b\x0c\r"
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(strip))
    texts = {r.doc_id: (r.text or "").split("\n") for r in docs.collect()}
    seen = Counter(k for own in texts.values() for k in {key(x) for x in own})
    for r in queries.op5_line_dedup(spark, SF).collect():
        kept = [x for x in texts[r.doc_id] if not (key(x) and seen[key(x)] >= 10)]
        assert (r.n_lines, r.n_dropped) == (len(texts[r.doc_id]), len(texts[r.doc_id]) - len(kept))
        assert r.kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_line_runs(spark):
    runs = line_dedup.LineRuns(fanout=2)
    batch = lambda *hs: spark.createDataFrame([(bytes([h]), 1) for h in hs], "h binary, n long")
    for own in ((1, 2), (2, 3), (3, 4), (1, 9), (7,)):
        runs.add(batch(*own))
    assert {k: len(v) for k, v in runs.levels.items()} == {0: 1, 1: 0, 2: 1}
    assert {r.h[0]: r.n for r in runs.counts().collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 9: 1, 7: 1}
    assert sorted(r.h[0] for r in runs.unseen(batch(1, 5, 7, 8)).collect()) == [5, 8]


def test_lines_of_odd_rows(spark):
    rows = [(i, f"Same\nown {i}\n same\t", "en", "s") for i in range(12)] + ODD
    got = line_dedup.dedup_lines(odd(spark, rows))
    assert got.columns == [*odd(spark).columns, "lines_", "dropped_"]
    found = [(r.doc_id, r.text, r.lines_, r.dropped_) for r in got.collect()]
    assert (3, "own 3", 3, 2) in found and (1, None, 1, 0) in found and (2, "", 1, 0) in found and len(found) == len(rows)
    assert line_dedup.dedup_lines(odd(spark, [])).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix(docs).toPandas()
    counted = mixing.counted_documents(docs).toPandas()
    total = counted.n_tokens.sum() * 3 // 5
    taken = (got.full_epochs * got.n_tokens + got.last_tokens).sum()
    assert 0 <= total - taken <= len(counted.groupby(["domain", "lang", "source"])) * 3
    assert (got.full_epochs <= 2).all() and (got.last_tokens <= got.n_tokens).all()
    # shortages stay in the family: a domain has less than its share only if all of it is used
    share = (got.full_epochs * got.n_tokens + got.last_tokens).groupby(got.domain).sum()
    room = 2 * counted.groupby("domain").n_tokens.sum()
    full = share[share >= room.reindex(share.index) - 20]
    assert share.drop(full.index).max() - share.drop(full.index).min() <= 40
    odd_ = mixing.mix(odd(spark)).collect()
    assert all(r.full_epochs > 0 or r.last_tokens > 0 for r in odd_) and mixing.mix(odd(spark, [])).count() == 0
    again = mixing.mixed_documents(odd(spark))
    assert again.columns == odd(spark).columns


def test_best_fit():
    r = random.Random(2)
    items = [r.randrange(1, 4097) for _ in range(800)]
    put = packing.best_fit(items)
    bins = {}
    for n, (b, at, size) in zip(items, put):
        bins.setdefault((b, size), []).append((at, n))
    for (_, size), own in bins.items():
        own.sort()
        assert all(a + n == c for (a, n), (c, _) in zip(own, own[1:])) and own[0][0] == 0
        used = sum(n for _, n in own)
        assert used <= size and size == next(s for s in packing.SIZES if s >= used)
    assert sum(items) / sum(size for _, size in bins) > 0.97
    assert packing.best_fit([]) == [] and packing.best_fit([4096]) == [(0, 0, 4096)]


def test_packing(spark):
    got = packing.pack(odd(spark)).toPandas()
    long = got[got.doc_id == 6]
    assert long.n_tokens.sum() == 30_000 and sorted(long.piece) == list(range(8))
    assert (got[got.doc_id.isin([1, 2, 3])].bin_size == 0).all() and len(got[got.doc_id == 4]) == 2 and got.doc_id.isna().sum() == 1
    assert packing.pack(odd(spark, [])).count() == 0


def test_quality(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = lab.where("pmod(doc_id, 3) <> 0")
    got = quality.classify(d, train).join(lab.where("pmod(doc_id, 3) = 0"), "doc_id").toPandas()
    assert ((got.keep == (got.quality == 1)).mean()) > 0.95
    assert got[got.quality == 1].keep.mean() > 0.97


def test_posteriors_shrink(spark):
    rows = [("a", "x", 1.0)] * 50 + [("a", "y", 0.0)] + [("b", "z", 0.2)] * 40 + [("c", "w", 0.9)]
    p = {r.path: r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert p["x"].path_mean > 0.9 and 0.2 < p["y"].path_mean < p["x"].path_mean
    assert abs(p["w"].host_mean - p["w"].global_mean) < abs(0.9 - p["w"].global_mean)


def test_quality_of_odd_rows(spark, labels):
    got = quality.classify(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(odd(spark, []), labels).count() == 0
    assert quality.classify(odd(spark), labels.where("false")).where("not keep").count() == 0
    assert quality.keep_good(odd(spark), labels.where("false")).columns == odd(spark).columns


def auc(score, y):
    order = pd.Series(score).rank()
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_op8(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))
    out = got[got.held_out]
    assert auc(out.score.to_numpy(), out.toxic.to_numpy()) > 0.9
    assert out[out.toxic == 0].predicted.mean() < 0.02 and out[out.toxic == 1].predicted.mean() > 0.75


def test_toxicity_of_odd_rows(spark, labels):
    got = toxicity.score_toxicity(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(odd(spark, []), labels).count() == 0


def test_trees_and_isotonic():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    s = toxicity.boosted(toxicity.boost(x, y), x)
    assert ((s > 0) == (y == 1)).mean() > 0.95
    at, share = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4, 5]), np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(share) >= 0).all() and (np.diff(at) > 0).all()


def test_licenses(spark):
    from linework.llm.license_texts import TEXTS

    mit = dict(TEXTS)["MIT"]
    changed = "Copyright (c) 2024 Someone\n\n" + TEXTS[0][1].upper().replace(", ", " , ").replace("LICENSE", "LICENCE")
    rows = [(1, TEXTS[0][1]), (2, changed), (3, "My text.\nLicenced under the apache licence version 2.0"), (4, "A text without any."), (5, None), (6, ""), (7, TEXTS[0][1] + " More."), (8, mit)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))).collect()}
    assert got[1].license_ == got[2].license_ == got[8].license_ == "MIT" and got[3].notices_ == ["Apache-2.0"]
    assert got[4].license_digest_ is None and got[5].license_ is None and got[6].notices_ == [] and got[7].license_ is None
    low = spark.createDataFrame(TEXTS, "license string, text string")
    assert low.where(~licenses.may_match(F.col("text"))).count() == 0


def test_op10(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    bits = np.array(e.embedding.tolist()) > 0
    got = {}
    for r in queries.op10_topk(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbor_id))
    asked = e.vec_id[e.vec_id % 20 == 0]
    assert set(got) == set(asked)
    for i in asked:
        d = (bits != bits[e.vec_id == i][0]).sum(1)
        want = sorted((int(x), int(j)) for x, j in zip(d, e.vec_id) if j != i)[:10]
        assert [(x, j) for _, x, j in sorted(got[i])] == want


def test_search_with_copies_and_few_rows(spark):
    rows = spark.createDataFrame([(i, 5 if i < 60 else i * 7919) for i in range(100)] + [(None, 3), (7, 6)], "id long, code long")
    got = topk.top_k(rows, rows.where("id in (0, 59, 80)"), 4).collect()
    assert [r.neighbor_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [1, 2, 3, 4]
    few = rows.where("id in (1, 2)")
    assert topk.top_k(few, few, 10).count() == 2 and topk.top_k(rows.where("false"), few, 3).count() == 0
