"""Document fingerprints by SimHash, in DataFrame operations only.

Terms are runs without ASCII white space, in pieces of at most TERM_CHARS code points; longer terms weigh more. A bit
is set if terms of more than half the weight have it set in their hash. Sums of 64 votes are kept in 16 longs of four
lanes each. Permuted block tables find what is within a Hamming radius: of six blocks three agree when up to three bits
differ, so each of the 20 choices of three blocks is a table whose leading key is looked up exactly."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.llm.common import components, cut
from linework.llm.simhash_gph import hex_of, midpoint_links

TERM_CHARS, HEAVIEST, BLOCK_TERMS = 32, 8, 4000
RADIUS, BLOCKS = 3, 6
#: Fingerprints that one key of a block table may have before they are linked through midpoints.
HOT_KEY = 512
#: Rows of one stretch of consecutive ids, and the most stretches; 64 x 64 bounds are searched in two steps.
STRETCH_ROWS, MOST_STRETCHES = 1000, 4096
LANES = 0x0001000100010001
WIDE_LANES = 0x0000FFFF0000FFFF


def terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[^ \\t-\\r]{1,%d}" % TERM_CHARS), F.lit(0))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys (which name one row each) and fingerprint (long) of the texts (not null); a text without a term has zero."""
    each = texts.select(*keys, F.posexplode_outer(terms(F.col(text_col))).alias("pos", "term"))
    weight = F.least(F.lit(HEAVIEST), 1 + F.expr("char_length(term) div 2")).cast("long")
    each = each.select(*keys, F.expr(f"coalesce(pos div {BLOCK_TERMS}, 0)").alias("block"), F.coalesce(F.xxhash64("term"), F.lit(0)).alias("hash_"), F.when(F.col("term").isNull(), 0).otherwise(weight).alias("w"))
    lanes = [F.sum(F.shiftrightunsigned("hash_", j).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"s{j}") for j in range(16)]
    block = each.groupBy(*keys, "block").agg(F.sum("w").alias("w"), *lanes)
    wide = []
    for j in range(16):
        wide.append(F.sum(F.col(f"s{j}").bitwiseAND(F.lit(WIDE_LANES))).alias(f"e{j}"))
        wide.append(F.sum(F.shiftrightunsigned(f"s{j}", 16).bitwiseAND(F.lit(WIDE_LANES))).alias(f"o{j}"))
    sums = block.groupBy(*keys).agg(F.sum("w").alias("w"), *wide)
    bits = []
    for b in range(64):  # bit b is in lane b // 16 of sum b % 16
        lane, j = divmod(b, 16)
        votes = F.shiftrightunsigned(f"{'eo'[lane % 2]}{j}", 32 * (lane // 2)).bitwiseAND(F.lit(0xFFFFFFFF))
        bits.append(F.when(votes * 2 > F.col("w"), F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of bits that agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def blocks(f: Column) -> list[Column]:
    """Six blocks of 11, 11, 11, 11, 10 and 10 bits."""
    out, at = [], 0
    for i in range(BLOCKS):
        width = 64 // BLOCKS + (i < 64 % BLOCKS)
        out.append(F.shiftrightunsigned(f, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    return out


def block_links(fps: DataFrame, radius: int = RADIUS, hot_key: int = HOT_KEY) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fps (f long, distinct) within radius, at most 5.

    Each choice of 6 - radius blocks is a table. Keys with more than hot_key fingerprints don't make pairs: their
    fingerprints are linked through midpoints."""
    own = blocks(F.col("f"))
    chosen = list(combinations(range(BLOCKS), BLOCKS - radius))
    keys = []
    for t, c in enumerate(chosen):
        key = F.lit(t).cast("long")
        for i in c:
            key = F.shiftleft(key, 11).bitwiseOR(own[i])
        keys.append(key if radius >= 2 else F.xxhash64(*[own[i] for i in c], F.lit(t)))
    table = fps.select("f", F.explode(F.array(*keys)).alias("key"))
    hot = cut(table.groupBy("key").count().where(F.col("count") > hot_key).select("key"), "hot")
    links = []
    if not hot.isEmpty():
        links.append(midpoint_links(cut(table.join(hot, "key", "left_semi").select("f").distinct(), "members"), radius))
        table = table.join(hot, "key", "left_anti")
    x, y = table.select("key", F.col("f").alias("a")), table.select("key", F.col("f").alias("b"))
    pairs = x.join(y.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return reduce(DataFrame.unionAll, [pairs.select("a", "b").distinct(), *links])


def bounds_of(ids: DataFrame) -> list[int]:
    """Ids (column o) that cut all of them into stretches of about STRETCH_ROWS rows, at most MOST_STRETCHES."""
    n = ids.count()
    stretches = max(1, min(MOST_STRETCHES, n // STRETCH_ROWS))
    if stretches == 1:
        return []
    found = ids.agg(F.percentile_approx("o", [i / stretches for i in range(1, stretches)], 20 * stretches)).first()[0]
    return sorted(set(found))


def stretch(o: Column, bounds: list[int]) -> Column:
    """How many bounds are at most o, looked up in 64 heads and then among 64."""
    if not bounds:
        return F.lit(0)
    parts = [bounds[i : i + 64] for i in range(0, len(bounds), 64)]
    heads = F.from_json(F.lit(str([p[0] for p in parts])), "array<bigint>")
    every = F.from_json(F.lit(str(parts)), "array<array<bigint>>")
    head = F.size(F.filter(heads, lambda h: h <= o))
    inner = F.size(F.filter(F.element_at(every, F.greatest(head, F.lit(1))), lambda h: h <= o))
    return F.when(head == 0, 0).otherwise((head - 1) * 64 + inner)


def with_next(docs: DataFrame) -> DataFrame:
    """docs: o long (order), t string: adds next_t, next_h and next_o of the row after it in ascending o, of the first
    row after the last. Equal o go by a hash of the text. Texts are moved once, into stretches of consecutive o; the
    first row of each stretch is also dealt to the stretch before it."""
    ids = docs.select("o")
    bounds = bounds_of(ids)
    told = docs.withColumn("stretch", stretch(F.col("o"), bounds)).withColumn("h", F.xxhash64("t"))
    heads = {r.stretch: r.o for r in told.groupBy("stretch").agg(F.min("o").alias("o")).collect()}  # at most MOST_STRETCHES rows
    order = sorted(heads)
    before = {s: order[i - 1] for i, s in enumerate(order)}  # the first goes after the last
    size = max(order, default=0) + 1
    arr = lambda d: F.from_json(F.lit(str([d.get(s, -1) for s in range(size)])), "array<bigint>")
    is_head = F.element_at(arr(heads), F.col("stretch") + 1) == F.col("o")
    to = F.element_at(arr(before), F.col("stretch") + 1).cast("int")
    place = F.when(is_head, F.array(F.struct(F.col("stretch").alias("s"), F.lit(0).alias("extra")), F.struct(to.alias("s"), F.lit(1).alias("extra")))).otherwise(F.array(F.struct(F.col("stretch").alias("s"), F.lit(0).alias("extra"))))
    dealt = told.withColumn("at", F.explode(place)).select(*docs.columns, "h", "at.s", "at.extra")
    w = Window.partitionBy("s").orderBy("extra", "o", "h")
    out = dealt.withColumn("next_t", F.lead("t").over(w)).withColumn("next_h", F.lead("h").over(w)).withColumn("next_o", F.lead("o").over(w))
    return out.where("extra = 0").drop("s", "extra")


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs (doc_id, text, more): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next and near_class, the smallest doc_id reachable over fingerprints within radius.

    The edited text has its last n_chars // 2 code points replaced by as many first ones (or all) of the next document in
    ascending doc_id. Null texts are empty, a text without a term has fingerprint zero; null ids come first; of equal
    ids the texts' hashes give the order. One row alone is its own next."""
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("o"), F.coalesce("text", F.lit("")).alias("t"))
    half = F.expr("char_length(t) div 2")
    both = with_next(base).withColumn("n_chars", F.char_length("t").cast("long"))
    both = both.withColumn("edited", F.concat(F.left(F.col("t"), (F.col("n_chars") - half).cast("int")), F.left(F.col("next_t"), half)))
    keys = ["row", "doc_id", "o", "h", "next_o", "next_h", "n_chars", "sha", "which"]
    both = both.withColumn("row", F.monotonically_increasing_id()).withColumn("sha", F.unhex(F.sha2("edited", 256)))
    texts = both.select(*keys[:-1], F.posexplode(F.array("t", "edited")).alias("which", "text"))
    found = cut(fingerprints(texts, keys), "fingerprints")
    plain, edited = found.where("which = 0"), found.where("which = 1").select("row", F.col("fingerprint").alias("edited_fp"))
    of = plain.groupBy(F.col("o").alias("next_o"), F.col("h").alias("next_h")).agg(F.min("fingerprint").alias("next_fp"))
    rows = plain.drop("which").join(edited, "row").join(of, ["next_o", "next_h"])
    fps = cut(plain.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(block_links(fps.select("f"), radius))
    named = fps.join(labels.withColumnRenamed("node", "f"), "f", "left").select("f", "least", F.coalesce("label", "f").alias("label"))
    classes = named.join(named.groupBy("label").agg(F.min("least").alias("near_class")), "label").select(F.col("f").alias("fingerprint"), "near_class")
    out = rows.join(cut(classes, "classes"), "fingerprint")
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), hex_of(F.col("fingerprint")).alias("fingerprint"), hex_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"), "near_class",
    )
