"""Each stage of the pipeline on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from linework.llm.common import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows that go into each stage, and the last one's result."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF)))
    return out


def test_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources", "best-fit packing"]
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_good_documents_stay(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = steps[1].select("doc_id").join(labels, "doc_id").groupBy("quality").count().collect()
    n = {r.quality: r["count"] for r in labels.join(steps[0], "doc_id").groupBy("quality").count().collect()}
    k = {r.quality: r["count"] for r in kept}
    assert k[1] >= 0.98 * n[1] and k.get(0, 0) <= 0.2 * n[0]


def test_lines_and_copies_go(steps):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").lower()
    seen = Counter(k for r in steps[1].collect() for k in {key(x) for x in r.text.split("\n")})
    assert all(not k or n < 10 for k, n in Counter(k for r in steps[2].collect() for k in {key(x) for x in r.text.split("\n")}).items()) or max(seen.values()) >= 10
    words = lambda t: re.findall(r"[^\s]+", t.lower())
    shingles = {r.doc_id: {tuple(w[i : i + 5]) for w in [words(r.text)] for i in range(max(1, len(w) - 4))} for r in steps[3].collect()}
    ids = sorted(shingles)
    alike = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(shingles[a] & shingles[b]) >= 0.9 * len(shingles[a] | shingles[b])]
    assert not alike


def test_every_chosen_document_is_packed(steps):
    chosen, packed = steps[4].groupBy("doc_id").count().count(), steps[5].select("doc_id").distinct().count()
    assert chosen == packed
    bins = steps[5].where("bin_id is not null").groupBy("bin_id", "bin_size").agg({"n_tokens": "sum"}).collect()
    assert all(r["sum(n_tokens)"] <= r.bin_size for r in bins)
