"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Word lists are learned first: words, and beginnings of words, that toxic labelled texts have far more often than others.
Densities of the listed words, how near they are to the second person, capitals, punctuation and disguised spellings
are the features. Trees are fitted to one part of the labelled rows, calibration to the other."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import cut

#: Labelled rows that are learned from at most, chosen by hash; entries of each word list; texts an entry needs; its least log odds.
SAMPLE_ROWS, LIST_WORDS, LEAST_TEXTS, LEAST_ODDS = 20_000, 2000, 4, 2.0
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 80, 3, 0.15, 32, 15
HELD_OUT_PARTS, CALIBRATION_PARTS = 5, 4
STEMS = (4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"[^\W\d_](?:[*@$!0134578._-]+[^\W\d_]+)+|(?<![^\W\d_])(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?![^\W\d_])")
PLAIN = str.maketrans("013457@$!", "oieastasi")
# Pronouns of the second person in four languages.
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie usted ustedes ti tus vosotros vuestro".split())
FEATURES = ("log_words", "listed", "listed_log", "odds_most", "odds_sum", "stems", "stems_log", "stem_odds", "near_second", "second", "capitals", "capital_words", "exclaims", "marks", "disguised", "disguised_listed")


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def toxic_features(text: str | None, lexicon: Lexicon) -> list[float]:
    """FEATURES of one text; an empty one has zeros."""
    text = text or ""
    words = WORD.findall(text.lower())
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    hits = {w: c for w, c in counts.items() if w in lexicon.words}
    stem_hits, stem_odds = 0, 0.0
    for w, c in counts.items():
        best = max((lexicon.stems.get(w[:k], 0.0) for k in STEMS if len(w) >= k), default=0.0)
        if best:
            stem_hits, stem_odds = stem_hits + c, max(stem_odds, best)
    listed = sum(hits.values())
    near = 0
    if hits:
        at = [i for i, w in enumerate(words) if w in hits]
        near = sum(any(w in SECOND for w in words[max(0, i - 5) : i + 6]) for i in at)
    veiled = [re.sub(r"[^\w]|_", "", m.lower().translate(PLAIN)) for m in DISGUISED.findall(text)]
    return [
        np.log1p(n), listed / n * 100, np.log1p(listed), max((lexicon.words[w] for w in hits), default=0.0), sum(lexicon.words[w] * c for w, c in hits.items()) / n,
        stem_hits / n * 100, np.log1p(stem_hits), stem_odds, near, sum(counts[w] for w in SECOND if w in counts) / n,
        sum(map(str.isupper, text)) / len(text), sum(map(str.isupper, text.split())) / n, (text.count("!") + text.count("?")) / n, sum(text.count(c) for c in "*#%&$@") / n,
        len(veiled) / n, float(sum(v in lexicon.words for v in veiled)),
    ]


def terms_column(text: Column) -> Column:
    """Distinct words of a text, and as ^... the beginnings of them."""

    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        def terms(t):
            words = set(WORD.findall((t or "").lower()))
            return [*words, *{"^" + w[:k] for w in words for k in STEMS if len(w) >= k}]

        return pd.Series([terms(t) for t in texts], dtype=object)

    return of(text)


def learn_lexicon(rows: DataFrame, size: int = LIST_WORDS) -> Lexicon:
    """rows: text, y: the entries with the highest log odds, at most `size` of each kind."""
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Lexicon()
    seen = rows.select("y", F.explode(terms_column(F.col("text"))).alias("term")).groupBy("term").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("bad") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n0 + 1))
    scored = cut(seen.where(F.col("bad") >= LEAST_TEXTS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS), "terms")
    out = Lexicon()
    for stems, into in ((False, out.words), (True, out.stems)):
        for r in scored.where(F.col("term").startswith("^") == stems).orderBy(F.desc("odds"), F.desc("bad"), "term").limit(size).collect():
            into[r.term.removeprefix("^")] = r.odds
    return out


def boost(x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float, list[tuple]]:
    """(bin edges of each feature, base score, trees): logistic boosting of trees of DEPTH levels over binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    b = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]).astype(np.int64)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, trees, width, d = np.full(len(y), base), [], BINS + 1, x.shape[1]
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node, feature, cut_at = np.zeros(len(y), np.int64), np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, width)
        for level in range(DEPTH):
            first = 2**level - 1
            slot = ((node[:, None] - first) * d + np.arange(d)) * width + b
            shape = (2**level, d, width)
            G, H, C = (np.bincount(slot.ravel(), np.repeat(v, d), 2**level * d * width).reshape(shape).cumsum(2) for v in (g, h, np.ones(len(y))))
            gain = G**2 / (H + 1) + (G[..., -1:] - G) ** 2 / (H[..., -1:] - H + 1) - G[..., -1:] ** 2 / (H[..., -1:] + 1)
            gain[(C < LEAST_LEAF) | (C[..., -1:] - C < LEAST_LEAF)] = -1
            for k in range(2**level):
                f, at = divmod(int(gain[k].argmax()), width)
                if gain[k, f, at] > 1e-6:
                    feature[first + k], cut_at[first + k] = f, at
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut_at[node])
        leaf = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        score += value[leaf]
        trees.append((feature, cut_at, value))
    return edges, base, trees


def boosted(model: tuple[list[np.ndarray], float, list[tuple]], x: np.ndarray) -> np.ndarray:
    """Log odds for rows of features."""
    edges, base, trees = model
    b = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    out, rows = np.full(len(x), base), np.arange(len(x))
    for feature, cut_at, value in trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut_at[node])
        out += value[node - (2**DEPTH - 1)]
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the increasing step function of least squares, by pooling neighbours; each class is given half a row in
    every pool, so that no score is quite 0 or 1."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + c for a, c in zip(pools[-1], last, strict=True)]
    at = np.array([p[2] / p[1] for p in pools])
    share = np.array([(p[0] + 0.25) / (p[1] + 0.5) for p in pools])
    return at, np.maximum.accumulate(share)


def calibrated(points: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    """The step function, with straight lines between its points; a trace of the score keeps the order inside a step."""
    at, share = points
    flat = np.interp(score, at, share) if len(at) else np.full(len(score), 0.5)
    return np.clip(flat * 0.998 + 0.001 / (1 + np.exp(-score)) + 0.0005, 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT_PARTS)) == 0


@dataclass
class ToxicModel:
    lexicon: Lexicon
    trees: tuple[list[np.ndarray], float, list[tuple]] | None
    points: tuple[np.ndarray, np.ndarray] | None
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.trees is None else calibrated(self.points, boosted(self.trees, x))


def features_column(text: Column, lexicon: Lexicon) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([toxic_features(t, lexicon) for t in texts], dtype=object)

    return of(text)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicModel:
    """From at most `rows` labelled documents that are not held out, those of least hash of doc_id; of texts that repeat an
    id the first in order. The word lists and
    the trees come from three quarters of them, the calibration from the rest."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "sample")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most `rows` rows
    sample = cut(sample.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION_PARTS))), "rows")
    lexicon = learn_lexicon(sample.where("part > 0").select("text", "y"))
    found = sample.select("part", "y", features_column(F.col("text"), lexicon).alias("x")).toPandas()
    x, y, part = np.array(found.x.tolist(), float).reshape(-1, len(FEATURES)), found.y.to_numpy(float), found.part.to_numpy()
    a, b = part > 0, part == 0
    if len(set(y[a])) < 2 or not b.any():
        return ToxicModel(lexicon, None, None, float(y.mean()) if len(y) else 0.0)
    trees = boost(x[a], y[a])
    return ToxicModel(lexicon, trees, isotonic(boosted(trees, x[b]), y[b]), float(y.mean()))


def score_column(text: Column, model: ToxicModel) -> Column:
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.array([toxic_features(t, model.lexicon) for t in texts], float)))

    return of(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    A null or empty text is scored by features of zero; repeated ids are scored apart; without labels of both classes
    every score is the share of toxic labels, 0 without any."""
    model = fit(docs, labels, rows)
    told = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return told.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
