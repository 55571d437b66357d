"""The methods themselves: large groups, settled runs, sizes that are opened, names in common, canonical spellings."""

import random
import re

from pyspark.sql import functions as F

from linework.llm import common, licenses, line_dedup, packing, pii, simhash_gph


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


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 400)], "a long, b long")
    assert {tuple(r) for r in common.components(edges).collect()} == {(i, 1) for i in range(1, 401)}


def test_large_families_of_near_copies(spark, monkeypatch):
    """Families in which most pairs are a little less alike than 0.8, met in lists: as brute force says."""
    monkeypatch.setattr(simhash_gph, "LARGE", 6)
    monkeypatch.setattr(simhash_gph, "LIST", 4)
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(260)]
        for _ in range(50):
            own = list(base)
            for at in r.sample(range(260), r.choice((2, 3, 5, 8))):
                own[at] = word()
            texts.append(" ".join(own))
    sets = [{t for t in zip(*(w[i:] for i in range(5)))} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = sorted(set(groups(links, range(len(texts))).values()))
    got = simhash_gph.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kept = sorted(x.doc_id for x in got.collect())
    assert set(want) <= set(kept) and len(kept) <= len(want) + 2


def test_candidates_are_met_in_lists_too(spark, monkeypatch):
    """Two large groups: every pair between them that the search allows, and none within."""
    monkeypatch.setattr(simhash_gph, "LARGE", 3)
    monkeypatch.setattr(simhash_gph, "LIST", 2)
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(simhash_gph.WIDE)]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for node in range(40):
        w = list(base)
        for _ in range(12):
            w[r.randrange(len(w))] ^= 1 << r.randrange(64)
        rows.append((node, node % 2 if node < 36 else node, 100, [sign(x) for x in w]))
    nodes = common.cut(spark.createDataFrame(rows, "node long, label long, size long, w array<long>"))
    got = {tuple(x) for x in simhash_gph.candidate_pairs(nodes, 11, 3, 0.8).collect()}
    apart = lambda a, b: [((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[3], b[3])]
    must = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and min(apart(a, b)[:3]) <= 11 and sum(apart(a, b)) <= simhash_gph.widest(0.8, 64 * simhash_gph.WIDE)}
    label = {x[0]: x[1] for x in rows}
    assert must <= got and all(label[a] != label[b] for a, b in got) and any(a < 36 and b < 36 for a, b in got)


def test_settled_lines_are_not_counted_again(spark):
    runs = line_dedup.LineRuns(fanout=2, min_docs=3)
    batch = lambda rows: spark.createDataFrame([(bytes([h]), n) for h, n in rows], "h binary, n long")
    runs.add(batch([(1, 2), (2, 1)]))
    runs.add(batch([(1, 1), (3, 2)]))
    assert [r.h[0] for s in runs.settled for r in s.collect()] == [1]
    runs.add(batch([(1, 9), (3, 1), (4, 3)]))
    assert sorted(r.h[0] for run in runs.runs() for r in run.collect()) == [2, 3, 3, 4]
    assert sorted(r.h[0] for r in runs.frequent().collect()) == [1, 3, 4]


def test_many_lines_of_one_text(spark):
    rows = [(i, "\n".join(f"common {j}" for j in range(300))) for i in range(10)] + [(99, "\n".join(f"common {j % 300}\nown {j}" for j in range(20_000)))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99].dropped_ == 20_000 and got[99].text == "\n".join(f"own {j}" for j in range(20_000)) and got[3].text == ""


def test_every_size_can_be_opened():
    def opened(item, smaller):
        sums = [sum(smaller[:i]) for i in range(len(smaller) + 1)]
        return packing.opened(item, sorted(smaller), sums, packing.SIZES, packing.SIZES[-1])

    assert opened(400, []) == 512 and opened(400, [100] * 6) == 1024 and opened(1500, [200] * 20) == 2048 and opened(2500, []) == 4096


def test_the_cheapest_limit_is_taken():
    r = random.Random(6)
    for _ in range(20):
        items = [r.choice((r.randrange(1, 500), r.randrange(1, 4097))) for _ in range(60)]
        order = sorted(range(len(items)), key=lambda i: (-items[i], i))
        put = packing.best_fit(items)
        total = sum(packing.cost(s) for _, s in {(b, s) for b, _, s in put})
        assert total <= min(packing.placed(items, order, packing.SIZES, x)[0] for x in packing.SIZES) + 1e-6


def test_packing_does_not_depend_on_files(spark):
    r = random.Random(7)
    rows = [(i % 300, "w " * r.randrange(0, 900)) for i in range(400)] + [(None, "same text")] * 50
    one = spark.createDataFrame(rows, "doc_id long, text string")
    other = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string").repartition(7)
    of = lambda df: sorted(map(tuple, packing.pack(df, shard_rows=64).collect()), key=str)
    assert of(one) == of(other)


def test_names_keep_words_in_common(spark):
    text = "Mr John Smith met Mr Smith, Mrs Anna O'Brien and Mr J. Smith. Herr Jean-Luc Picard left; key sk-abcdefghijklmnopqrstuvwx."
    got = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert not any(x in got.text for x in ("John", "Smith", "Anna", "Brien", "Picard", "Luc", "sk-abc"))
    m = re.fullmatch(r"Mr (\S+) (\S+) met Mr (\S+), Mrs (\S+) (\S+) and Mr (\S+) (\S+)\. Herr (\S+) (\S+) left; key (\S+)\.", got.text)
    assert m and m[2] == m[3] == m[7] and m[5] != m[2] and got.entities_ == 6


def test_more_entities_than_a_draw_has_surrogates(spark):
    letters = "абвгдежзиклмнопр"
    rows = [("surname", letters[i >> 4] + letters[i & 15], False) for i in range(200)] + [("email", f"{chr(97 + i // 26)}@{chr(97 + i % 26)}.io", False) for i in range(676)]
    got = pii.drawn(common.cut(spark.createDataFrame(rows, "kind string, canon string, female boolean")), "k").toPandas()
    assert len(got) == len(rows) and not got.duplicated(["kind", "norm"]).any() and not set(zip(got.kind, got.norm)) & {r[:2] for r in rows}


def test_canonical_spellings(spark):
    rows = [("Licence licence, the LICENCE", "license license the license"), ("sub licence sub license per cent\nper cent", "sublicense sublicense percent percent")]
    got = [r.c for r in spark.createDataFrame(rows, "t string, want string").select(licenses.canonical(F.col("t")).alias("c")).collect()]
    assert got == [w for _, w in rows]


def test_rows_of_a_shuffled_plan_stay_together(spark):
    rows = [(i, f"mail user{i}@example.com and line {i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in pii.pseudonymise(df, key="k").collect()}
    alone = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}
    assert {d: r.text for d, r in got.items()} == alone
