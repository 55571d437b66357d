"""Licence scans by canonical digest, in DataFrame operations only.

A text is brought to a canonical form: lower case, equivalent spellings made one, copyright lines, list markers and punctuation gone,
one space between words. Its digest is looked up among the digests of the known licence texts by a hash join. Whole
documents are looked up, and so is each of their lines, for notices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import cut, steady, unused
from linework.llm.license_texts import TEXTS

# Spellings that licence texts use for one another.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "sub license": "sublicense", "non commercial": "noncommercial", "non infringement": "noninfringement", "merchantibility": "merchantability",
    "copyright owner": "copyright holder", "copyright owners": "copyright holders", "acknowledgement": "acknowledgment", "organisation": "organization", "favour": "favor", "fulfil": "fulfill", "per cent": "percent", "version": "v", "https": "http",
}
#: Lines that say whose work it is: with a sign, a year or nothing but the phrase; wrapped text may start with the word too.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©]*(?:copyright\b[^\n]*?(?:\(c\)|©|\b(?:19|20)[0-9]{2}\b)[^\n]*|\(c\) *(?:copyright|(?:19|20)[0-9]{2})[^\n]*|©[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
#: Numbers and bullets of lists: at the start of a line or of a sentence.
MARKER = r"(?m)(?:^|(?<=[.:;])[ \t])[ \t]*(?:[*•·-]+|\(?(?:[0-9]{1,2}|[a-z])[.)])\s+"
#: Each known text has one of these words, in one of its spellings; texts without any are none of them.
SIGNS = ("licen", "permission", "redistribution")


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "), MARKER, " ")
    # two blanks between words: each word has its own on both sides, so repeated spellings are all found
    out = F.concat(F.lit(" "), F.btrim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    wide = lambda words: F.lit(" " + words.replace(" ", "  ") + " ")
    out = reduce(lambda t, x: F.replace(t, wide(x[0]), wide(x[1])), EQUIVALENT.items(), out)
    return F.btrim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def may_match(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(s)) for s in SIGNS))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """(digest, license) of the known texts; of texts that come to one digest the first licence by name."""
    rows = spark.createDataFrame(list(texts), "license string, known string")
    return rows.groupBy(digest(F.col("known")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """docs with the columns license_ (of the whole text, or null), license_digest_ (null if no known text can match)
    and notices_ (licences of single lines, distinct and sorted).

    Null and empty texts have none; very long ones are taken whole. Copyright lines alone are no licence. Repeated rows
    are scanned each. Columns of docs keep their names; the new ones get an underscore more where a name is taken. An
    empty table gives an empty one."""
    docs = steady(docs)
    known = known_digests(docs.sparkSession) if known is None else known
    row, lic, dig, notices = unused(docs, "row", "license_", "license_digest_", "notices_")
    told = docs.withColumn(row, F.monotonically_increasing_id())
    some = told.where(may_match(F.col(text_col))).select(F.col(row).alias("row"), F.col(text_col).alias("t"))
    lines = some.select("row", F.explode(F.split("t", "\n")).alias("t")).where(may_match(F.col("t"))).select("row", F.lit(False).alias("whole"), digest(F.col("t")).alias("digest"))
    both = some.select("row", F.lit(True).alias("whole"), digest(F.col("t")).alias("digest")).unionAll(lines)
    found = both.join(known, "digest", "left").groupBy("row").agg(
        F.max(F.when(F.col("whole"), F.col("digest"))).alias("d"), F.max(F.when(F.col("whole"), F.col("license"))).alias("l"), F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))).alias("n"))
    found = cut(found, "found").select(F.col("row").alias(f"{row}_"), F.col("d").alias(dig), F.col("l").alias(lic), F.col("n").alias(notices))
    out = told.join(found, F.col(row) == F.col(f"{row}_"), "left")
    return out.select(*docs.columns, lic, dig, F.coalesce(F.col(notices), F.array().cast("array<string>")).alias(notices))
