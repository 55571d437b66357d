"""Mixing sources to target weights by hierarchical budgeting.

A tree of levels (domain, language, source) gets a total of tokens. Each node shares its budget among its children by
their weights; a child that cannot use its share keeps what it can and the rest goes to its siblings, so only what a
whole family cannot use reaches the family above. Each leaf then takes whole epochs and a token-prefix of one more, in
an order that the seed and the epoch fix. All of it is integer arithmetic and comes out the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.llm.common import SPACE, cut, unused

LEVELS = ("domain", "lang", "source")
#: Weights by level and value; others have DEFAULT_WEIGHT. Share of the tokens that is asked for; epochs a leaf may give.
WEIGHTS = {"lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}
DEFAULT_WEIGHT, SHARE, MAX_EPOCHS, SEED = 1, (3, 5), 2, 20
#: Leading hex digits of the order's hash that make a bucket: only the bucket in which a prefix ends is sorted.
BUCKET_DIGITS = 3


def token_count(text: Column) -> Column:
    trimmed = F.coalesce(F.btrim(text, F.lit(SPACE)), F.lit(""))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+"))).cast("long")


def domain_of(source: Column) -> Column:
    """Documents have no domain: d and the last digit of the source's name."""
    return F.concat(F.lit("d"), F.regexp_extract(F.coalesce(source, F.lit("")), "[0-9]$", 0))


def weight_of(level: str, value: Column, weights: dict[str, dict[str, int]]) -> Column:
    known = weights.get(level, {})
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in known.items():
        out = F.when(value == name, w).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """nodes: parent columns, child, w, room (long), given (long, the parent's budget): adds budget (long).

    Children that the rising level fills first come first; the filled ones keep their room, the others split what is
    left by weight, rounded down. given is at most the sum of room."""
    part = Window.partitionBy(*parent)
    w = part.orderBy(F.col("room") / F.col("w"), child)
    before = F.coalesce(F.sum("room").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(w.rowsBetween(0, Window.unboundedFollowing))
    full = nodes.withColumn("full", (F.col("given") - before) * F.col("w") >= F.col("room") * after)
    rest = F.col("given") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(part)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(part)
    sums = full.withColumn("rest", rest).withColumn("open_w", open_w)
    return sums.withColumn("budget", F.when(F.col("full"), F.col("room")).otherwise(F.expr("rest * w div open_w"))).drop("full", "rest", "open_w")


def leaf_budgets(leaves: DataFrame, levels: tuple[str, ...] = LEVELS, weights: dict[str, dict[str, int]] = WEIGHTS, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves: level columns and tokens (long), one row a leaf: adds budget (long), top down. Leaves without a token get none."""
    leaves = cut(leaves.withColumn("room", F.col("tokens") * max_epochs), "leaves")
    total = leaves.agg(F.sum("tokens").alias("t")).select(F.least(F.expr(f"coalesce(t, 0) * {share[0]} div {share[1]}"), F.coalesce("t", F.lit(0)) * max_epochs).alias("given"))
    above, given = [], total
    for level in levels:
        nodes = leaves.where("room > 0").groupBy(*above, level).agg(F.sum("room").alias("room")).withColumn("w", weight_of(level, F.col(level), weights))
        nodes = nodes.crossJoin(F.broadcast(given)) if not above else nodes.join(given, above)  # the first is one row
        out = share_out(nodes, above, level)
        above = [*above, level]
        given = cut(out.select(*above, F.col("budget").alias("given")), "given")
    return leaves.join(given, list(levels), "left").select(*levels, "tokens", F.coalesce("given", F.lit(0).cast("long")).alias("budget"))


def chosen(counted: DataFrame, levels: tuple[str, ...] = LEVELS, weights: dict[str, dict[str, int]] = WEIGHTS, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """counted: doc_id, the levels (not null), n_tokens (long), more columns: rows that are taken, with full_epochs, the
    number of whole epochs, and last_tokens, the tokens taken in the epoch after them. Sorted runs of equal ids count by
    n_tokens. A row without tokens is taken in whole epochs only."""
    leaves = counted.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    budget = cut(leaf_budgets(leaves, levels, weights, share, max_epochs), "budgets")
    plan = budget.where("budget > 0").select(*levels, F.expr("budget div tokens").alias("full_epochs"), F.expr("budget % tokens").alias("rest"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = counted.join(plan, list(levels)).withColumn("o", order).withColumn("b", F.substring("o", 1, BUCKET_DIGITS))
    by = [*levels, "b"]
    sums = rows.groupBy(*by).agg(F.sum("n_tokens").alias("in_bucket"))
    w = Window.partitionBy(*levels).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(w), F.lit(0).cast("long"))), "buckets")
    placed = rows.join(before, by)
    whole = F.col("before") + F.col("in_bucket") <= F.col("rest")
    ends = (F.col("before") < F.col("rest")) & ~whole
    easy = placed.where(~ends).withColumn("last_tokens", F.when(whole, F.col("n_tokens")).otherwise(0).cast("long"))
    exact = Window.partitionBy(*by).orderBy("o", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    sorted_ = placed.where(ends).withColumn("ahead", F.col("before") + F.coalesce(F.sum("n_tokens").over(exact), F.lit(0)))
    hard = sorted_.withColumn("last_tokens", F.greatest(F.lit(0).cast("long"), F.least("n_tokens", F.col("rest") - F.col("ahead")))).drop("ahead")
    both = easy.unionByName(hard).where("full_epochs > 0 or last_tokens > 0")
    return both.drop("rest", "o", "b", "in_bucket", "before")


def counted_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens) of documents; null levels are the empty name."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("source")).alias("domain"), of("lang").alias("lang"), of("source").alias("source"), token_count(F.col("text")).alias("n_tokens"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row for each document that is taken: doc_id, domain, lang, source, n_tokens, full_epochs, last_tokens."""
    return chosen(cut(counted_documents(docs), "counted"), **how)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents that are taken, with their own columns, a row for each epoch that has them. A text in which the
    prefix ends stays whole. Rows that repeat an id are told apart by their number of tokens, and if that is the same
    they have the same fate."""
    epochs = cut(mix(docs, **how).select("doc_id", "n_tokens", "lang", "source", (F.col("full_epochs") + (F.col("last_tokens") > 0).cast("long")).alias("times")).groupBy("doc_id", "n_tokens", "lang", "source").agg(F.max("times").alias("times")), "epochs")
    n, d, x, g, s, i = unused(docs, "n", "d", "x", "g", "s", "i")
    told = docs.withColumn(n, token_count(F.col("text")))
    mine = epochs.select(F.col("doc_id").alias(d), F.col("n_tokens").alias(f"{n}t"), F.col("lang").alias(g), F.col("source").alias(s), F.col("times").alias(x))
    same = told["doc_id"].eqNullSafe(F.col(d)) & (told[n] == F.col(f"{n}t")) & (F.coalesce(told["lang"], F.lit("")) == F.col(g)) & (F.coalesce(told["source"], F.lit("")) == F.col(s))
    return told.join(mine, same).withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(x)))).select(*docs.columns)
