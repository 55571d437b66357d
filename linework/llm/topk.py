"""Exact top-k search in binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments, and every distinct code is indexed under each of them. A query probes, round
by round, all values at segment distance exactly 0, 1, 2, ...; after radius r of m segments every code within
m * (r + 1) - 1 bits has been met, so a query is done once its k-th verified distance is no more than that."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.llm.common import cut, union

BITS, K = 64, 10
QUERY_EVERY = 20


def code_of(vector: Column, bits: int = BITS) -> Column:
    """Bit i is set where component i is positive; a null vector or component counts as not positive."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.get(vector, F.lit(i)) > 0, F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(bits)))


def segment_count(rows: int, bits: int = BITS) -> int:
    """Segments of three bits less than log2(rows): a value has about eight codes, and there are few values to probe."""
    return max(2, min(8, round(bits / max(8.0, log2(max(rows, 2)) - 3))))


def segments(m: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of m segments."""
    widths = [bits // m + (i < bits % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def part(code: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1))


def masks_at(width: int, distance: int) -> Column:
    found = [sum(1 << b for b in c) for c in combinations(range(width), distance)]
    return F.from_json(F.lit(str(found)), "array<bigint>")


def nearest_codes(queries: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """queries: q long, distinct; codes: code long, ids array<long> (its k smallest ids, in order).
    Rows (q, code, d): for each query all codes that can be among its k nearest rows."""
    m = segment_count(codes.count())
    parts = segments(m)
    index = union([codes.select(part(F.col("code"), *s).bitwiseOR(F.lit(i << 40)).alias("key"), "code", F.size("ids").alias("n")) for i, s in enumerate(parts)])
    index, last = cut(index, "index"), max(w for _, w in parts)
    open_, done, seen = cut(queries.select("q", F.lit(BITS).alias("bound")), "queries"), [], None
    for r in range(last + 1):
        if open_.isEmpty():
            break
        probes = union([
            open_.select("q", "bound", F.lit(i).alias("i"), part(F.col("q"), *s).alias("p"), F.explode(masks_at(s[1], r)).alias("x")).select("q", "bound", "i", F.col("p").bitwiseXOR(F.col("x")).bitwiseOR(F.lit(i << 40)).alias("key"))
            for i, s in enumerate(parts) if r <= s[1]
        ])
        # sizes are guessed from before the explode: without the hint the probes would be broadcast, and they grow
        differ = F.col("q").bitwiseXOR(F.col("code"))
        first = F.lit(True)  # a code is met once: in the first of the segments where it is nearest, at that distance
        for j, s in enumerate(parts):
            apart = F.bit_count(part(differ, *s))
            first = first & F.when(F.col("i") > j, apart > r).otherwise(apart >= r)
        d = F.bit_count(differ)
        fresh = probes.join(index.hint("merge"), "key").where(first & (d <= F.col("bound"))).select("q", "code", "n", d.alias("d"))
        seen = cut(fresh if seen is None else seen.unionAll(fresh), "seen")
        # rows at each distance, of which there are 65 at most: the distance at which there are k
        at = seen.groupBy("q", "d").agg(F.sum("n").alias("n")).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "n"))).alias("all"))
        begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("d"))
        run = F.aggregate("all", begin, lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when((a["n"] < k) & (a["n"] + x["n"] >= k), x["d"]).otherwise(a["d"]).alias("d")))["d"]
        now = open_.join(at.select("q", run.alias("kth")), "q", "left").select("q", F.when(F.col("kth") >= 0, F.col("kth")).otherwise(BITS).alias("bound"))
        now = cut(now, "bounds")
        ready = F.lit(r == last) | (F.col("bound") <= m * (r + 1) - 1)
        done.append(seen.join(now.where(ready), "q").where("d <= bound").select("q", "code", "d"))
        open_ = now.where(~ready)
        seen = seen.join(open_, "q").where("d <= bound").select("q", "code", "n", "d")
    return union(done) if done else index.select(F.col("key").alias("q"), "code", "n").where("false").select("q", "code", F.col("n").alias("d"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """rows and queries: id long, code long. For each row of queries its k nearest other rows by Hamming distance, ties
    by smaller id: (query_id, rank from 1, neighbor_id, distance). Fewer rows than k give as many as there are; rows
    with a null id are left out; rows that repeat an id count once, by their smallest code."""
    rows = rows.where("id is not null").groupBy("id").agg(F.min("code").alias("code"))
    queries = cut(queries.where("id is not null").groupBy("id").agg(F.min("code").alias("code")), "asked")
    codes = cut(smallest_ids(rows, k + 1), "codes")
    near = cut(nearest_codes(queries.select(F.col("code").alias("q")).distinct(), codes, k + 1), "near")
    listed = near.join(codes, "code").select("q", "d", F.explode("ids").alias("other"))
    best = listed.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "other"))), 1, k + 1).alias("best"))
    mine = queries.join(best, queries.code == best.q).select("id", F.filter("best", lambda x: x["other"] != F.col("id")).alias("best"))
    out = mine.select("id", F.posexplode(F.slice("best", 1, k)).alias("p", "x"))
    return out.select(F.col("id").alias("query_id"), (F.col("p") + 1).alias("rank"), F.col("x.other").alias("neighbor_id"), F.col("x.d").alias("distance"))


def smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """(code, ids): the k smallest ids of each code. Hot codes are dealt into 64 parts first."""
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    some = rows.withColumn("salt", salt).withColumn("n", F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))).where(F.col("n") <= k)
    return some.groupBy("code").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("ids"))
