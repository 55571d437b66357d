"""Helpers that the text operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.plans.shared import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The ASCII white space that separates words: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the quick path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def steady(df: DataFrame) -> DataFrame:
    """df where its plan only reads, selects and filters, so that rows come in the same order whenever it is read; else
    what it gives, written once. Row numbers need that where two branches of a plan use them."""
    nodes = df._jdf.queryExecution().sparkPlan().toString()
    return cut(df, "steady") if any(x in nodes for x in ("Aggregate", "Join", "Exchange", "Sort", "Limit", "Window", "Sample", "InPandas")) else df


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that df has no column of, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, label), label the smallest node that is reachable.

    Each round every node points to its smallest neighbour, pointers are followed twice and edges are contracted; the
    smaller node is the one of smaller hash, so however nodes are numbered a fixed share of them goes in each round.
    Joins are merge joins at every size: nothing is sent to the driver. Loops and repeated edges are allowed; nodes
    without an edge to another node are absent; no edges give no rows."""
    tidy = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    by_hash = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    left = first = cut(tidy(edges), "edges")
    steps = []
    while not left.isEmpty():
        both = left.unionAll(left.select("b", "a"))
        to = both.groupBy("a").agg(F.min(by_hash("b")).alias("m")).select(F.col("a").alias("node"), F.least(by_hash("a"), "m")["n"].alias("up"))
        far = to.alias("x").join(to.hint("merge").alias("y"), F.col("x.up") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.up").alias("up"))
        steps.append(far := cut(far, "far"))
        one = left.join(far.hint("merge").select(F.col("node").alias("a"), F.col("up").alias("a2")), "a").select("a2", "b")
        left = cut(tidy(one.join(far.hint("merge").select(F.col("node").alias("b"), F.col("up").alias("b2")), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))), "edges")
    if not steps:
        return first.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = steps[0].select("node", F.col("up").alias("root"))
    for far in steps[1:]:
        roots = roots.join(far.hint("merge").select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    roots = cut(roots, "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("label"))
    return cut(roots.join(least.hint("merge"), "root").select("node", "label"), "labels")
