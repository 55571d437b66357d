"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. A text longer than the largest fills whole sequences of that size; the rest of
each text is an item. Items are dealt into shards of bounded size by a seeded hash, and each shard is packed on its own:
largest first, each into the open bin that it leaves least room in. Where none has room, a new bin of the size is opened
that costs least a token, for the tokens that the items still to come can fill it with. The sizes are optimised together:
a shard is packed once for each limit on the sizes that may be opened beyond what an item needs, and the packing of least
total cost is taken. At the end each bin becomes the smallest size that holds its contents."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.common import SPACE, cut

#: Permitted lengths; what a sequence costs on top of its tokens; length at which attention costs as much as all else;
#: rows that one packing shard gets; seed of the dealing.
SIZES, OVERHEAD, ATTENTION, SHARD_ROWS, SEED = (512, 1024, 2048, 4096), 64, 16384, 4096, 17
PACKED = "doc_id bigint, piece int, n_tokens int, bin_id string, bin_offset int, bin_size int"


def cost(size: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    """Of one sequence: its tokens, attention that grows with the square, and a fixed part."""
    return size + size * size / attention + overhead


def opened(item: int, smaller: list[int], sums: list[int], sizes: tuple[int, ...], limit: int) -> int:
    """The size to open for an item: the least cost for each token that it and the items that are left (ascending, with
    running sums from 0) can fill it with. Sizes above limit are opened only where the item needs them."""
    fits = [s for s in sizes if s >= item]

    def each(size: int) -> float:
        return cost(size) / (item + min(size - item, sums[bisect_right(smaller, size - item, 0, len(smaller))]))

    return min([fits[0], *(s for s in fits[1:] if s <= limit)], key=lambda s: (each(s), s))


def placed(items: list[int], order: list[int], sizes: tuple[int, ...], limit: int) -> tuple[float, list[tuple[int, int, int]]]:
    """Total cost, and (bin, offset, size of the bin) for each item."""
    room: list[tuple[int, int]] = []  # of open bins: free tokens and number, sorted
    left = [items[i] for i in reversed(order)]
    sums = [0, *accumulate(left)]
    used, out = [], [(0, 0, 0)] * len(items)
    for i in order:
        left.pop()
        at = bisect_left(room, (items[i], -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = opened(items[i], left, sums, sizes, limit), len(used)
            used.append(0)
        out[i] = (b, used[b], 0)
        used[b] += items[i]
        if free > items[i]:
            insort(room, (free - items[i], b))
    final = [next(s for s in sizes if s >= u) for u in used]
    return sum(map(cost, final)), [(b, o, final[b]) for b, o, _ in out]


def best_fit(items: list[int], sizes: tuple[int, ...] = SIZES) -> list[tuple[int, int, int]]:
    """(bin, offset, size of the bin) for each item, in the order given: the cheapest packing over all limits, of equally
    cheap ones that with the largest limit. Items are 1 to the largest size."""
    order = sorted(range(len(items)), key=lambda i: (-items[i], i))
    return min((placed(items, order, sizes, limit) for limit in reversed(sizes)), key=lambda x: x[0])[1]


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, shard_rows: int = SHARD_ROWS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document: doc_id, piece (from 0), n_tokens, bin_id, bin_offset, bin_size.

    Tokens are words between ASCII white space. A text without a word (null, empty, blank) is one piece of no tokens in
    no bin: bin_id null, bin_size 0. Rows that repeat an id are packed as documents of their own, and a null id is one
    too. Very long texts fill sequences whole. Other columns are left out, whatever their names. An empty table gives an
    empty one. Shards are dealt by a hash of id, text and number of the copy, so no key can fill one, and the same rows
    are packed in the same way however they are stored."""
    sizes = tuple(sorted(sizes))
    trimmed = F.coalesce(F.btrim(text_col, F.lit(SPACE)), F.lit(""))
    n = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+")))
    # equal rows are told apart by a count alone: what comes out depends on the rows, not on how files hold them
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.cast("int").alias("n"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    counted = cut(counted.groupBy("doc_id", "n", "h").agg(F.count(F.lit(1)).alias("copies")), "counted")
    shards = max(1, -(-(counted.agg(F.sum("copies")).first()[0] or 0) // shard_rows))
    chunks = counted.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {shard_rows}"))))
    copies = F.sequence(F.col("c") * shard_rows + 1, F.least("copies", (F.col("c") + 1) * shard_rows))
    each = chunks.select("doc_id", "n", "h", F.explode(copies).alias("copy"))
    dealt = each.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h", "copy"), F.lit(shards)).cast("int"))

    def packed(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["doc_id", "n", "h", "copy"], kind="stable", na_position="last")
        ids, lengths, most = x.doc_id.array, x.n.to_numpy(np.int64), sizes[-1]
        rows, items = [], []
        for d, length in zip(ids, lengths.tolist(), strict=True):
            whole, rest = divmod(length, most)
            for p in range(whole):
                rows.append((d, p, most, f"{key[0]}-w{len(rows)}", 0, most))
            if rest or not whole:
                rows.append((d, whole, rest, None, 0, 0))
                if rest:
                    items.append(len(rows) - 1)
        for i, (b, offset, size) in zip(items, best_fit([rows[i][2] for i in items], sizes), strict=True):
            d, p, length, *_ = rows[i]
            rows[i] = (d, p, length, f"{key[0]}-{b}", offset, size)
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "n_tokens", "bin_id", "bin_offset", "bin_size"])
        return out.assign(doc_id=out.doc_id.astype("Int64"))

    return dealt.groupBy("shard").applyInPandas(packed, PACKED)
