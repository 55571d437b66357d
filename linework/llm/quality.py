"""Quality classifier with hierarchical empirical Bayes.

A logistic model of text features gives each document's own evidence. Hosts and the paths under them get posteriors of
the share of good documents: grouped sums of the evidence, shrunk from path to host and from host to the global prior,
with strengths estimated from how much hosts (paths) differ. A document's verdict adds what its path says, without the
document itself, to its own evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import cut, unused
from linework.llm.features import QUALITY_FEATURES, logistic, quality_features

#: Labelled rows that the model is fitted to at most, chosen by hash; weight of the site's evidence; verdict threshold.
SAMPLE_ROWS, SITE_WEIGHT, THRESHOLD = 20_000, 0.3, 0.5
#: Strengths of a prior, in documents, stay within these bounds.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0


def features_column(text: Column) -> Column:
    @F.pandas_udf("array<float>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([quality_features(t) for t in texts], dtype=object)

    return of(text)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, spreads, weights) from at most `rows` labelled documents, those of least hash of doc_id; of texts that repeat
    an id the first in order. Labels other than 0 and 1 are left out; without both classes the weights say even odds."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    sample = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most `rows` rows
    found = texts.select(features_column(F.col("text")).alias("x"), "y").toPandas()
    x, y = np.array(found.x.tolist(), dtype=float).reshape(-1, len(QUALITY_FEATURES)), found.y.to_numpy(float)
    if len(set(y)) < 2:
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    return mean, spread, logistic((x - mean) / spread, y)


def evidence_column(text: Column, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """Log odds, within +-8, that the text is good by itself."""
    mean, spread, w = model

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        x = (np.array([quality_features(t) for t in texts], dtype=float) - mean) / spread
        return pd.Series(np.clip(x @ w[1:] + w[0], -8, 8))

    return of(text)


def strength(groups: DataFrame) -> DataFrame:
    """One row, kappa: how many documents the prior counts for, by moments, from rows s (sum), n (count), m (prior mean).

    The spread of the groups' shares beyond what counting alone gives is the variance of the prior."""
    share = F.col("s") / F.col("n")
    t = groups.where("n > 1").agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * (share - F.col("m")) ** 2).alias("q"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("v"))
    between = (F.col("q") - F.col("v") / F.col("N") * F.col("k")) / F.col("N")
    kappa = (F.col("v") / F.col("N")) / F.greatest(between, F.lit(1e-9)) - 1
    return t.select(F.coalesce(F.greatest(F.lit(LEAST_STRENGTH), F.least(kappa, F.lit(MOST_STRENGTH))), F.lit(MOST_STRENGTH)).alias("kappa"))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """evidence: host, path (not null), p: one row a path: s and n of its documents, host_mean, path_mean, kappa, m0."""
    paths = cut(evidence.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n")), "paths")
    total = paths.agg(((F.sum("s") + 1) / (F.sum("n") + 2)).alias("m"))  # one row, as are the strengths
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).crossJoin(F.broadcast(total))
    hosts = hosts.crossJoin(F.broadcast(strength(hosts)))
    hosts = hosts.select("host", ((F.col("s") + F.col("kappa") * F.col("m")) / (F.col("n") + F.col("kappa"))).alias("host_mean"), F.col("m").alias("global_mean"))
    under = paths.join(hosts, "host").withColumn("m", F.col("host_mean"))
    under = under.crossJoin(F.broadcast(strength(under)))
    return under.select("host", "path", "s", "n", "kappa", "host_mean", "global_mean", ((F.col("s") + F.col("kappa") * F.col("m")) / (F.col("n") + F.col("kappa"))).alias("path_mean"))


def site_columns(source: Column, lang: Column) -> tuple[Column, Column]:
    """Documents come with a source and a language: the source is the host, the language the path under it."""
    return F.coalesce(source.cast("string"), F.lit("")), F.coalesce(lang.cast("string"), F.lit(""))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, rows: int = SAMPLE_ROWS, site_weight: float = SITE_WEIGHT, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, host, path, evidence, host_mean, path_mean, score, keep (boolean).

    host and path are expressions over docs (source and lang if left out), null ones the empty name. A null or empty text
    has features of zero and is judged by them; repeated ids are judged apart; labels of documents that aren't there
    count for nothing; without labels every document has even odds and is kept."""
    h, p = site_columns(F.col("source"), F.col("lang"))
    h, p = (h if host is None else F.coalesce(host, F.lit(""))), (p if path is None else F.coalesce(path, F.lit("")))
    model = fit(docs, labels, rows)
    told = docs.select(F.col("doc_id").alias("doc_id"), h.alias("host"), p.alias("path"), evidence_column(F.col("text"), model).alias("evidence"))
    told = cut(told.withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "evidence")
    sites = cut(site_posteriors(told), "sites")
    both = told.join(sites, ["host", "path"])
    without = (F.col("s") - F.col("p") + F.col("kappa") * F.col("host_mean")) / (F.col("n") - 1 + F.col("kappa"))
    logit = lambda x: F.log(F.greatest(x, F.lit(1e-6)) / F.greatest(1 - x, F.lit(1e-6)))
    score = 1 / (1 + F.exp(-(F.col("evidence") + site_weight * (logit(without) - logit(F.col("global_mean"))))))
    return both.select("doc_id", "host", "path", "evidence", "host_mean", "path_mean", score.alias("score")).withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, site_weight: float = SITE_WEIGHT, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that classify() keeps, with their own columns. Evidence is computed again next to the text, so
    that no text is moved; only the posteriors of the sites are joined."""
    host, path = site_columns(F.col("source"), F.col("lang"))
    model = fit(docs, labels)
    told = docs.select(host.alias("host"), path.alias("path"), evidence_column(F.col("text"), model).alias("evidence"))
    sites = cut(site_posteriors(cut(told.withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "evidence")), "sites")
    h, p, e, v = unused(docs, "h", "p", "e", "v")
    site = sites.select(F.col("host").alias(h), F.col("path").alias(p), F.struct("s", "n", "kappa", "host_mean", "global_mean").alias(v))
    mine = docs.withColumn(e, evidence_column(F.col("text"), model))
    both = mine.join(site, (host == F.col(h)) & (path == F.col(p)))
    logit = lambda x: F.log(F.greatest(x, F.lit(1e-6)) / F.greatest(1 - x, F.lit(1e-6)))
    own = 1 / (1 + F.exp(-F.col(e)))
    without = (F.col(v)["s"] - own + F.col(v)["kappa"] * F.col(v)["host_mean"]) / (F.col(v)["n"] - 1 + F.col(v)["kappa"])
    score = 1 / (1 + F.exp(-(F.col(e) + site_weight * (logit(without) - logit(F.col(v)["global_mean"])))))
    return both.where(score >= threshold).select(*docs.columns)
