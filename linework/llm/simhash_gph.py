"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints a and b that differ in at most r bits have, for any partition of the bits into groups and any thresholds
t_p >= -1 with sum(t_p + 1) = r + 1, a group p in which they differ in at most t_p bits. Correlated bits are put into one
group, thresholds come from a dynamic programme over pair counts of all fingerprints, and each pair is reported once."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import components, cut, union, unused

BITS = 64
#: Buckets with more fingerprints than this are split by more bits before pairs are made.
HOT_BUCKET = 512
#: How often they are split at most, and the fingerprints of one part above which they are dense: those are linked through
#: midpoints.
SPLITS, DENSE = 2, 64
#: Costs of a row that is dealt out and of a candidate that is verified, as parts of each other.
ROW_COST, CANDIDATE_COST = 1.0, 0.01
GROUP_COUNTS = (2, 3, 4, 5, 6)
#: Odd multipliers that widen a 64-bit hash: fixed values, any odd constants do.
WIDEN = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """A hash for each k-word shingle of a text, repeats too; all words make one where they are fewer than k."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) < k:
        return np.array([digest(joined, 42)] if parts else [], dtype=np.uint64)
    ends = np.cumsum([len(x) + 1 for x in parts]).tolist()
    starts = [0, *ends]
    return np.array([digest(joined[starts[i] : ends[i + k - 1] - 1], 42) for i in range(len(parts) - k + 1)], dtype=np.uint64)


def simhash(text: str | None, k: int, words: int = 1) -> list[int]:
    """Majority votes of the k-word shingles of a text, words * 64 bits, as signed 64-bit integers; no word gives zeros."""
    return voted(shingle_hashes(text, k), words)


def voted(h: np.ndarray, words: int) -> list[int]:
    out = []
    for w in range(words):
        x = h if not w else (h * np.uint64(WIDEN[w - 1])) ^ ((h * np.uint64(WIDEN[w - 1])) >> np.uint64(29))
        votes = np.zeros(BITS, dtype=np.int64)
        for at in range(0, len(x), 1 << 18):
            votes += np.unpackbits(x[at : at + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(votes * 2 > len(x), bitorder="little").view(np.int64)[0]))
    return out


def simhash_column(text: Column, k: int, words: int = 1) -> Column:
    """Array of `words` longs for each text."""

    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, k, words) for t in texts], dtype=object)

    return of(text)


def hex_of(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


@dataclass(frozen=True)
class Group:
    """Bits of the fingerprint that are looked up together, and how many of them may differ."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))

    @property
    def sides(self) -> tuple[int, int]:
        """Bits flipped in the index and in the probe."""
        return self.threshold // 2, self.threshold - self.threshold // 2

    def spread(self, flip: int) -> int:
        """A flip, numbered within the group, as bits of the fingerprint."""
        return signed(sum(1 << b for i, b in enumerate(self.bits) if flip >> i & 1))

    def compact(self, f: np.ndarray) -> np.ndarray:
        """The group's bits of each fingerprint, side by side."""
        u = f.view(np.uint64)
        return sum(((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(i) for i, b in enumerate(self.bits)).astype(np.int64)


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


@lru_cache
def flips(width: int, most: int) -> tuple[int, ...]:
    return tuple(sum(1 << b for b in c) for d in range(most + 1) for c in combinations(range(width), d))


def ball(width: int, radius: int) -> int:
    return sum(comb(width, d) for d in range(radius + 1))


def bit_correlation(fps: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each word w of fps (w int, f long): its rows and the |correlation| of its 64 bits over all of them; each
    partition sends one 64 x 64 matrix a word, which Spark adds up."""

    def counts(frames):
        total: dict[int, np.ndarray] = {}
        for x in frames:
            for w, own in x.groupby("w"):
                b = np.unpackbits(own.f.to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                m = total.setdefault(w, np.zeros(BITS * BITS + 1))
                m[-1] += len(b)
                for at in range(0, len(b), 1 << 16):
                    m[:-1] += (b[at : at + (1 << 16)].T @ b[at : at + (1 << 16)]).ravel()
        for w, m in total.items():
            yield pd.DataFrame({"w": w, "i": np.arange(len(m)), "n": m})

    both: dict[int, np.ndarray] = {}
    for w, i, c in fps.select("w", "f").mapInPandas(counts, "w int, i int, n double").groupBy("w", "i").agg(F.sum("n")).toLocalIterator():
        both.setdefault(w, np.zeros(BITS * BITS + 1))[i] = c
    out = {}
    for w, m in both.items():
        n, joint = int(m[-1]), m[:-1].reshape(BITS, BITS) / m[-1]
        p = joint.diagonal()
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
        out[w] = n, np.abs((joint - np.outer(p, p)) / np.outer(spread, spread))
    return out


def group_bits(corr: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m groups of nearly equal size: each starts with the free bit most tied to others and takes its closest bits."""
    free, out = set(range(BITS)), []
    for g in range(m):
        width = BITS // m + (g < BITS % m)
        rows = sorted(free)
        first = max(rows, key=lambda b: (sum(sorted((corr[b, x] for x in rows if x != b), reverse=True)[: width - 1]), -b))
        mine = [first]
        free.discard(first)
        while len(mine) < width:
            near = max(sorted(free), key=lambda b: (corr[b, mine].sum(), -b))
            mine.append(near)
            free.discard(near)
        out.append(tuple(sorted(mine)))
    return out


def pairs_by_distance(counts: np.ndarray) -> np.ndarray:
    """From the counts of each key of a group: ordered pairs of rows at each distance, exactly, by a Walsh transform."""
    x, width = counts.astype(np.float64), int(np.log2(len(counts)))
    spectrum = walsh(walsh(x) ** 2) / len(x)
    return np.bincount(np.bitwise_count(np.arange(len(x))), weights=np.rint(spectrum), minlength=width + 1)


def walsh(x: np.ndarray) -> np.ndarray:
    x, step = x.copy(), 1
    while step < len(x):
        y = x.reshape(-1, 2, step)
        x = np.stack((y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]), axis=1).reshape(-1)
        step *= 2
    return x


def thresholds(widths: list[int], pairs: list[np.ndarray], n: int, radius: int) -> tuple[float, list[int]]:
    """The cheapest thresholds >= -1 with sum(t + 1) = radius + 1: cost of what is dealt out plus of the candidates."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, counts in zip(widths, pairs, strict=True):
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, min(radius - spent, width) + 1):
                more = 0.0
                if t >= 0:
                    more = ROW_COST * n * (ball(width, t // 2) + ball(width, t - t // 2)) + CANDIDATE_COST * counts[: t + 1].sum() / 2
                now = (cost + more, [*chosen, t])
                if spent + t + 1 not in after or now[0] < after[spent + t + 1][0]:
                    after[spent + t + 1] = now
        best = after
    return best[radius + 1]


def plan(fps: DataFrame, radius: int) -> dict[int, list[Group]]:
    """For each word w of fps (w int, f long, distinct): groups of its bits and thresholds, from counts over all rows.
    However many there are, a task gets the at most 65,536 counts of one block, the driver a 64 x 64 matrix a word and
    17 numbers a block. Words without a row have no groups."""
    corr = bit_correlation(fps)
    choices = {w: [group_bits(c, m) for m in GROUP_COUNTS] for w, (_, c) in corr.items()}
    blocks = sorted({(w, b) for w, own in choices.items() for groups in own for bits in groups for b in halves(bits)})
    if not blocks:
        return {}

    def keys(frames):
        total: dict[int, np.ndarray] = {}
        for x in frames:
            for w, own in x.groupby("w"):
                f = own.f.to_numpy(np.int64)
                for i, (v, bits) in enumerate(blocks):
                    if v == w:
                        n = np.bincount(Group(bits, 0).compact(f), minlength=1 << len(bits))
                        total[i] = total[i] + n if i in total else n
        for i, n in total.items():
            yield pd.DataFrame({"i": i, "k": np.flatnonzero(n), "n": n[n > 0]})

    def distances(key, x):
        h = np.zeros(1 << len(blocks[key[0]][1]))
        h[x.k.to_numpy(np.int64)] = x.n.to_numpy()
        pairs = pairs_by_distance(h)
        return pd.DataFrame({"i": key[0], "d": np.arange(len(pairs)), "n": pairs})

    counted = fps.select("w", "f").mapInPandas(keys, "i int, k int, n long").groupBy("i", "k").agg(F.sum("n").alias("n"))
    found = {b: np.zeros(len(b[1]) + 1) for b in blocks}
    for i, d, pairs in counted.groupBy("i").applyInPandas(distances, "i int, d int, n double").toLocalIterator():
        found[blocks[i]][d] = pairs
    return {w: best_groups(own, {b: p for (v, b), p in found.items() if v == w}, corr[w][0], radius) for w, own in choices.items()}


def best_groups(choices: list[list[tuple[int, ...]]], found: dict[tuple[int, ...], np.ndarray], n: int, radius: int) -> list[Group]:
    """The cheapest grouping with its thresholds; blocks of a wide group are taken as independent."""
    options = []
    for groups in choices:
        own = [[found[b] for b in halves(bits)] for bits in groups]
        pairs = [x[0] if len(x) == 1 else np.convolve(x[0], x[1] / max(x[1].sum(), 1)) for x in own]
        options.append((*thresholds([len(g) for g in groups], pairs, n, radius), groups))
    _, chosen, groups = min(options, key=lambda x: x[0])
    return [Group(bits, t) for bits, t in zip(groups, chosen, strict=True)]


def halves(bits: tuple[int, ...]) -> list[tuple[int, ...]]:
    return [bits] if len(bits) <= 16 else [bits[: (len(bits) + 1) // 2], bits[(len(bits) + 1) // 2 :]]


def places(groups: dict[int, list[Group]]) -> list[tuple[int, Group]]:
    """(word, group) of all groups that are looked up; a place is a position in this list."""
    return [(w, g) for w, own in sorted(groups.items()) for g in own if g.threshold >= 0]


def dealt(x: DataFrame, used: list[tuple[int, Group]], side: int, s: str, only: int | None = None) -> DataFrame:
    """x: w0, w1 ... (words that are not null), columns to carry: a row for each place and flip, with key and a struct of
    all of x, the place p, the flip m and whether it is as wide as it may be; of one word only where asked. Keys are hashes; who meets by chance is told
    apart by the words."""
    told = [{"p": p, "w": w, "k": g.mask, "e": g.spread(m), "m": m, "full": m.bit_count() == g.sides[1]} for p, (w, g) in enumerate(used) if only in (None, w) for m in flips(len(g.bits), g.sides[side])]
    told = F.from_json(F.lit(json.dumps(told)), "array<struct<p:int,w:int,k:bigint,e:bigint,m:bigint,full:boolean>>")
    of = lambda c: F.coalesce(c, F.lit(0))  # noqa: E731  not null, which keeps the generated code short
    f = F.lit(0).cast("long")
    for w in sorted({w for w, _ in used}):
        f = F.when(F.col("x.w") == w, F.col(f"w{w}")).otherwise(f)
    key = F.xxhash64("x.p", f.bitwiseAND(F.col("x.k")).bitwiseXOR(F.col("x.e")))
    more = [of(F.col("x.p")).alias("p"), of(F.col("x.m")).alias("m"), F.coalesce(F.col("x.full"), F.lit(False)).alias("full")]
    return x.select(F.explode(told).alias("x"), *x.columns).select(of(key).alias("key"), F.struct(*x.columns, *more).alias(s))


def apart(a: str, b: str, words: int) -> Column:
    """Bits in which the first words of the structs a and b differ."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.w{i}").bitwiseXOR(F.col(f"{b}.w{i}"))) for i in range(words)))


def first_way(a: str, b: str, used: list[tuple[int, Group]]) -> Column:
    """Of all ways in which probe a and index b meet, the one that counts: at the first place where they do, with the flips
    of the index below those of the probe. One bit for each place, so that the code stays short enough to be compiled."""
    at = F.lit(0).cast("long")
    for p, (w, g) in enumerate(used):
        differ = F.bit_count(F.col(f"{a}.w{w}").bitwiseXOR(F.col(f"{b}.w{w}")).bitwiseAND(F.lit(g.mask)))
        at = at.bitwiseOR(F.shiftleft(F.shiftrightunsigned((differ - (g.threshold + 1)).cast("long"), 63), p))
    m, n = F.col(f"{a}.m"), F.col(f"{b}.m")
    lowest = m.bitwiseAND(F.negative(m))
    sides = (m.bitwiseAND(n) == 0) & ((n == 0) | (F.col(f"{a}.full") & (n < lowest)))
    return sides & (at.bitwiseAND(F.expr(f"shiftleft(1L, {a}.p) - 1L")) == 0)


def gph_links(fps: DataFrame, radius: int, hot_bucket: int = HOT_BUCKET, midpoints: bool = True) -> DataFrame:
    """Links (a, b) between fingerprints within radius; their components are those of all such pairs.

    fps: f long, distinct. Buckets of more than hot_bucket fingerprints would make pairs with the square of their
    size; with midpoints they are split by more bits (split_links), and only what stays together then meets at points
    half the radius away. In a large table all buckets have that many fingerprints, few of which are near each other."""
    used = places(plan(fps.select(F.lit(0).alias("w"), "f"), radius))
    if not used:
        return fps.select(F.col("f").alias("a"), F.col("f").alias("b")).where("false")
    words = fps.select(F.coalesce("f", F.lit(0)).alias("w0"))
    index, probe = dealt(words, used, 0, "b"), dealt(words, used, 1, "a")
    more = []
    if midpoints:
        hot = cut(index.groupBy("key").count().where(F.col("count") > hot_bucket).select("key"), "hot")
        if not hot.isEmpty():
            crowded = [cut(x.join(hot, "key", "left_semi"), "crowded") for x in (index, probe)]
            more = split_links(*crowded, used, radius, min(hot_bucket, DENSE))
            index, probe = index.join(hot, "key", "left_anti"), probe.join(hot, "key", "left_anti")
    return reduce(DataFrame.unionAll, [met_links(index, probe, used, radius), *more])


def met_links(index: DataFrame, probe: DataFrame, used: list[tuple[int, Group]], radius: int) -> DataFrame:
    """Links (a, b) within radius between probes and what they meet in the index, each way to meet but the first left out."""
    # sizes are guessed from before the explode: the hint keeps either side from being broadcast at any size
    meet = (F.col("a.w0") < F.col("b.w0")) & (apart("a", "b", 1) <= radius) & first_way("a", "b", used)
    return probe.join(index.hint("merge"), "key").where(meet).select(F.col("a.w0").alias("a"), F.col("b.w0").alias("b"))


def runs_of(bits: tuple[int, ...], n: int) -> list[tuple[int, ...]]:
    """bits in n runs of nearly equal length."""
    at = [len(bits) * i // n for i in range(n + 1)]
    return [bits[i:j] for i, j in zip(at, at[1:])]


def split_links(index: DataFrame, probe: DataFrame, used: list[tuple[int, Group]], radius: int, dense: int) -> list[DataFrame]:
    """Links whose components are those of all pairs within radius that index and probe (key, struct) bring together.

    Bits that the key leaves out are cut into radius + 1 runs: what is within radius agrees in one of them, so a row goes
    to radius + 1 narrower keys and meets whoever it has to. Keys that more than dense fingerprints share even so are
    split again, SPLITS times in all; then their members are linked through midpoints."""
    free = [tuple(b for b in range(BITS) if b not in g.bits) for _, g in used]
    index, probe = index.withColumn("at", F.col("b.p")), probe.withColumn("at", F.col("a.p"))
    found = []
    for _ in range(SPLITS):
        told, after = [], []
        for bits in free:
            runs = runs_of(bits, radius + 1)
            told.append([{"at": len(after) + i, "k": signed(sum(1 << b for b in run))} for i, run in enumerate(runs)])
            after += [tuple(b for b in bits if b not in run) for run in runs]
        free, runs = after, F.element_at(F.from_json(F.lit(json.dumps(told)), "array<array<struct<at:int,k:bigint>>>"), F.col("at") + 1)
        key = lambda s: F.xxhash64("key", "x.at", F.col(f"{s}.w0").bitwiseAND(F.col("x.k")))
        index, probe = (x.select("key", s, F.explode(runs).alias("x")).select(key(s).alias("key"), s, "x.at") for x, s in ((index, "b"), (probe, "a")))
        hot = cut(index.groupBy("key").count().where(F.col("count") > dense).select("key"), "hot")
        if hot.isEmpty():
            return [union([*found, met_links(index, probe, used, radius)]).distinct()]
        found.append(cut(met_links(index.join(hot, "key", "left_anti"), probe.join(hot, "key", "left_anti"), used, radius), "split"))
        index, probe = (cut(x.join(hot, "key", "left_semi"), "crowded") for x in (index, probe))
    members = union([x.select(F.col(f"{s}.w0").alias("f")) for x, s in ((index, "b"), (probe, "a"))]).distinct()
    return [union(found).distinct(), midpoint_links(cut(members, "members"), radius)]


def midpoint_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links whose components are those of all pairs within radius, without making the pairs.

    Two fingerprints that far apart have a point at most radius // 2 from one and the rest from the other. Each point
    that has a fingerprint on its near side links the smallest of those to all around it, which are at most a ball."""
    near = radius // 2
    dealt = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    masks = F.from_json(F.lit(str([signed(m) for m in flips(BITS, radius - near)])), "array<bigint>")
    points = dealt.select("f", F.explode(masks).alias("m")).select(F.col("f").bitwiseXOR(F.col("m")).alias("at"), "f", (F.bit_count("m") <= near).alias("close"))
    around = points.groupBy("at").agg(F.min(F.when(F.col("close"), F.col("f"))).alias("a"), F.collect_set("f").alias("all"))
    return around.where("a is not null and size(all) > 1").select("a", F.explode("all").alias("b")).where("a <> b").distinct()


def simhash_components(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f, component_id) for every row of docs; component_id is the smallest id reachable over links.

    Null texts count as empty; texts without a word have fingerprint zero and are linked like any other. Rows that
    repeat an id stay separate rows; a null id is never the smallest one unless all ids of its component are null."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), simhash_column(F.col(text_col), k)[0].alias("f")), "fingerprints")
    fps = cut(rows.groupBy("f").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(gph_links(fps.select("f"), radius))
    named = fps.join(labels.withColumnRenamed("node", "f"), "f", "left").select("f", "least", F.coalesce("label", "f").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = cut(named.join(least, "label").select("f", "component_id"), "components")
    return rows.join(of, "f").select("doc_id", "f", "component_id")


#: For the filter: words in a shingle, likeness asked for, words of the wide fingerprint, how many of them are searched and
#: within which radius. At 0.8 a pair differs in 9.7 +- 2.9 bits of a word: one word finds it in 0.48 of the cases, one of
#: three in 0.86; sorted neighbours find most of the others. A larger radius finds more, for more rows that are dealt out.
SHINGLE, LIKENESS, WIDE, SEARCHED, RADIUS = 5, 0.8, 6, 3, 9
#: Turns of the words at which texts are sorted and linked to near neighbours within so many places, before the search.
#: Groups of more texts than LARGE are met list by list, LIST members a list on average at most, so that a large group
#: does not meet itself.
TURNS, REACH, LARGE, LIST = (0, 16), 16, 64, 512
#: Texts to be compared, as id and hash (32 bytes each), that are sent to all tasks at most.
MOST_BROADCAST = 200_000
#: Texts and shingles in half a block of texts whose pairs are verified together, on average at most.
PART, PART_SHINGLES = 64, 1_000_000
#: Standard deviations that a candidate's differing bits may be above their mean; the shingles themselves decide. Of pairs
#: at 0.8 that leaves out six in a thousand, and in families of texts that are a little less alike most pairs.
DEVIATIONS = 2.5


def widest(similarity: float, bits: int) -> int:
    """Differing bits, of so many, that texts of this Jaccard similarity stay within, but for a few in a thousand."""
    cosine = 2 * similarity / (1 + similarity)
    p = float(np.arccos(cosine) / np.pi)
    return int(bits * p + DEVIATIONS * (bits * p * (1 - p)) ** 0.5)


def described(text: Column, k: int) -> Column:
    """Wide fingerprint, number of distinct shingles and 128 bits that tell their set."""

    def describe(t: str | None) -> tuple:
        h = shingle_hashes(t, k)
        distinct = np.unique(h)
        own = np.frombuffer(xxhash.xxh128_digest(distinct.tobytes()), dtype=np.int64)
        return voted(h, WIDE), len(distinct), int(own[0]), int(own[1])

    @F.pandas_udf("w array<bigint>, size bigint, node bigint, more bigint")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(t) for t in texts], columns=["w", "size", "node", "more"])

    return of(text)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least this Jaccard similarity."""
    x, y = (sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    return met.where(both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b")


def verified_in_blocks(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """What verified gives, for pairs of which a text may have many: its set is not sent once with each of them.

    Texts that hang together are dealt to parts of about PART texts and PART_SHINGLES shingles; two parts make a block,
    which gets each set once and is one row, however many pairs it has. A text longer than that is in a part whole."""
    group = components(pairs).join(sets.select("node", F.size("s").alias("n")).hint("merge"), "node")
    group = cut(group, "hanging")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / PART, F.sum("n") / PART_SHINGLES)).alias("parts")
    dealt_to = group.join(group.groupBy("label").agg(parts).hint("merge"), "label")
    dealt_to = cut(dealt_to.select("node", "label", F.pmod(F.xxhash64("node"), "parts").alias("part")), "parts")
    x, y = (dealt_to.select(F.col("node").alias(c), F.col("part").alias(f"p{c}"), *more).hint("merge") for c, more in (("a", ["label"]), ("b", [])))
    block = F.xxhash64("label", F.least("pa", "pb"), F.greatest("pa", "pb")).alias("block")
    met = cut(pairs.join(x, "a").join(y, "b").select(block, "a", "b"), "met")
    wanted = met.select("block", F.col("a").alias("node")).distinct().unionAll(met.select("block", "b").distinct()).distinct()
    held = wanted.join(sets.hint("merge"), "node").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("node", "s"))).alias("of"))
    told = met.groupBy("block").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))

    def alike(pair: Column) -> Column:
        one, other = F.col("of")[pair["a"]], F.col("of")[pair["b"]]
        return F.size(F.array_intersect(one, other)) * (1 + similarity) >= similarity * (F.size(one) + F.size(other)) - 1e-9

    return told.join(held.hint("merge"), "block").select(F.explode(F.filter("pairs", alike)).alias("x")).select("x.a", "x.b")


def shingle_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(node, s): the distinct shingles of the texts that pairs (a, b) ask for."""

    @F.pandas_udf("array<bigint>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, k)).view(np.int64) for t in texts], dtype=object)

    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    ends = nodes.join(ends.hint("merge"), "node").select("node", "least.id", "least.h")
    ends = cut(ends, "ends")
    told = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("g"))
    # few ends spare all other texts the shuffle; many are merge joined
    few = ends.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    own = told.join(F.broadcast(ends) if few else ends.hint("merge"), (F.col("g") == F.col("h")) & F.col("i").eqNullSafe(F.col("id"))).select("node", "t").dropDuplicates(["node"])
    return cut(own.select("node", of("t").alias("s")), "sets")


def relabelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes after the ends of each link (a, b) got into one group."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")).hint("merge")
    merged = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    out = nodes.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")).hint("merge"), "label", "left")
    return cut(out.withColumn("label", F.coalesce("to", "label")).select(*nodes.columns), "nodes")


def wide_words(nodes: DataFrame, *more: Column | str) -> DataFrame:
    """node, label, size and the words of the fingerprint as columns that are not null."""
    of = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return nodes.select(*[of(F.col(c)).alias(c) for c in ("node", "label", "size")], *[of(F.col("w")[i]).alias(f"w{i}") for i in range(WIDE)], *more)


def may_be_alike(a: str, b: str, similarity: float) -> Column:
    """Whether number of shingles and wide fingerprints of the structs a and b allow the similarity."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    return (apart(a, b, WIDE) <= widest(similarity, BITS * WIDE)) & (F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9)


def neighbour_pairs(nodes: DataFrame, turn: int, similarity: float, reach: int = REACH) -> DataFrame:
    """Pairs (a, b), at most one for each b: of the texts of other groups that stand within reach of it when all are
    sorted by a word of the fingerprint, turned by some bits, the one whose fingerprint is nearest. Range partitions
    are even however many texts are near to each other, and the work is linear."""
    turned = lambda f, n: F.shiftleft(f, n).bitwiseOR(F.shiftrightunsigned(f, 64 - n)) if n else f
    told = F.explode(F.array(*[F.struct(F.lit(2 * i + h).alias("o"), turned(F.col(f"w{i}"), (turn + 32 * h) % BITS).alias("f")) for i in range(WIDE) for h in (0, 1)]))
    rows = wide_words(nodes).select("*", told.alias("x")).select("x.o", "x.f", "node", "label", "size", *[f"w{i}" for i in range(WIDE)])
    most = widest(similarity, BITS * WIDE)

    def nearest(frames):
        for x in frames:
            w, label, size = x[[f"w{i}" for i in range(WIDE)]].to_numpy(np.int64).view(np.uint64), x.label.to_numpy(), x["size"].to_numpy()
            best, other = np.full(len(x), most + 1), np.zeros(len(x), dtype=np.int64)
            for by in range(1, min(reach + 1, len(x))):
                lo, hi = np.arange(len(x) - by), np.arange(by, len(x))
                fits = (label[lo] != label[hi]) & (np.minimum(size[lo], size[hi]) >= similarity * np.maximum(size[lo], size[hi]) - 1e-9)
                apart = np.where(fits, np.bitwise_count(w[lo] ^ w[hi]).sum(1), most + 1)
                for i, j in ((lo, hi), (hi, lo)):
                    nearer = apart < best[i]
                    best[i[nearer]], other[i[nearer]] = apart[nearer], j[nearer]
            found = best <= most
            node = x.node.to_numpy()
            yield pd.DataFrame({"a": node[other[found]], "b": node[found], "apart": best[found]})

    pairs = rows.repartitionByRange("o", "f").sortWithinPartitions("o", "f").mapInPandas(nearest, "a long, b long, apart long")
    return pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select("x.a", "b")


def candidate_pairs(nodes: DataFrame, radius: int, searched: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different groups that one of the searched words brings together at this radius and whose
    wide fingerprints and sizes allow the similarity.

    Words are searched one after the other, so that the rows that are dealt out for one are gone before the next; a pair
    counts where it meets first. Large groups are met by the texts of small ones in one direction; with each other they meet as lists of members that
    share a key, so pairs within a large group are never made."""
    fps = union([nodes.select(F.lit(i).alias("w"), F.col("w")[i].alias("f")) for i in range(searched)]).distinct()
    used = places(plan(cut(fps, "fps"), radius))
    many = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE)
    sized = nodes.join(many.hint("merge"), "label", "left")
    # the whole fingerprint goes along, so that the join itself leaves out what it tells apart
    sized = cut(wide_words(sized, F.coalesce("n", F.lit(0).cast("long")).alias("large")), "sized")
    sized = sized.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in sized.columns])
    small, large = sized.where("large = 0"), sized.where("large > 0")
    meet = may_be_alike("a", "b", similarity) & first_way("a", "b", used)
    pair = (F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
    crowded, out = not large.isEmpty(), [nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")]
    for w in sorted({w for w, _ in used}):
        both = dealt(small, used, 1, "a", w).join(dealt(sized, used, 0, "b", w).hint("merge"), "key")
        found = both.where(((F.col("b.large") > 0) | (F.col("a.node") < F.col("b.node"))) & (F.col("a.label") != F.col("b.label")) & meet).select(*pair)
        if crowded:
            lists = []
            for side, s in ((0, "b"), (1, "a")):
                chunk = F.pmod(F.xxhash64(f"{s}.node"), F.ceil(F.col(f"{s}.large") / LIST))
                lists.append(dealt(large, used, side, s, w).groupBy("key", F.col(f"{s}.label").alias(f"label{s}"), chunk).agg(F.collect_list(s).alias(s)))
            both = lists[1].join(lists[0].hint("merge"), "key").where("labela < labelb").select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
            found = found.unionAll(both.where(meet).select(*pair))
        out.append(cut(found, f"word{w}"))
    return union(out).distinct()


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, searched: int = SEARCHED, similarity: float = LIKENESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which no near-duplicate with a smaller id exists: one document of each group stays.

    Groups are the components of links between texts whose sets of shingles have at least this Jaccard similarity.
    Fingerprints of 6 x 64 bits give the candidates, each is verified by its shingles. Sorted
    neighbours are linked first, one other to each; what is one group then is not compared any more. The search covers all texts of
    different groups by words of the fingerprint. Of its candidates each text takes one first, then those left.
    A null or empty text has no shingle, so all such rows are one group. Very long texts are taken whole. Columns stay as
    they are, whatever their names. Of rows that repeat an id, the first text in order stays; null ids come last. An
    empty table gives an empty one."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), described(F.col(text_col), k).alias("x"))
    rows = cut(keyed.groupBy("id", "h", "x").agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    # one node for each set of shingles
    least = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "h", F.col("x.w").alias("w"))).alias("least")
    nodes = rows.groupBy("x.node", "x.more", "x.size").agg(least).select("node", F.col("node").alias("label"), "size", "least.w", "least")
    nodes = cut(nodes, "nodes")
    for turn in TURNS:
        pairs = cut(neighbour_pairs(nodes, turn, similarity), "neighbours")
        if pairs.isEmpty():
            break
        nodes = relabelled(nodes, cut(verified(pairs, shingle_sets(docs, nodes, pairs, k, id_col, text_col), similarity), "links"))
    found = cut(candidate_pairs(nodes, radius, searched, similarity), "candidates") if not nodes.isEmpty() else nodes.selectExpr("node a", "node b")
    if not found.isEmpty():
        sets = shingle_sets(docs, nodes, found, k, id_col, text_col)
        first = cut(found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
        nodes = relabelled(nodes, cut(verified(first, sets, similarity), "links"))
        la, lb = (nodes.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")).hint("merge") for c in "ab")
        rest = cut(found.join(first.hint("merge"), ["a", "b"], "left_anti").join(la, "a").join(lb, "b").where("la <> lb").select("a", "b"), "rest")
        if not rest.isEmpty():
            nodes = relabelled(nodes, cut(verified_in_blocks(rest, sets, similarity), "links"))
    kept = nodes.groupBy("label").agg(F.min(F.struct("least.no", "least.id", "least.h")).alias("least")).select(F.col("least.id").alias("id"), F.col("least.h").alias("h"))
    kept = cut(kept, "kept")
    repeated = cut(rows.where("n > 1").select("id", "h").join(kept.hint("merge"), ["id", "h"], "left_semi"), "repeated")
    return keep_first(docs, kept, repeated, id_col, text_col)


def keep_first(docs: DataFrame, kept: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs whose (id, hash of the text) is in kept; of equal rows, which repeated lists, one."""
    h, i = unused(docs, "h", "i")
    told = docs.withColumn(h, F.xxhash64(F.coalesce(text_col, F.lit(""))))

    def semi(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(F.col("id").alias(i), F.col("h").alias(f"{h}k"))
        return left.join(right, left[id_col].eqNullSafe(F.col(i)) & (left[h] == F.col(f"{h}k")), how)

    out = semi(told, kept, "left_semi")
    if repeated.isEmpty():
        return out.select(*docs.columns)
    again = semi(out, repeated, "left_semi").dropDuplicates([id_col, h])
    return semi(out, repeated, "left_anti").unionByName(again).select(*docs.columns)
