"""Line dedup over levelled sorted runs of line hashes.

A run is a written table (h binary, n long) of distinct line keys and the number of documents that have them, partitioned
by h and sorted within. Each batch of documents is merge-anti-joined with the keys that are settled, those that enough
documents have already, and adds what is left as a run at level 0. A level that has FANOUT runs is compacted: they are
merged into one run of the next level, and keys that now have enough documents leave it for a settled run. So a key is
rewritten once a level, and the lines that nearly every document has are not written again by later batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import SPACE, ascii_lower, cut, steady, union, unused

#: Runs of one level that are merged into the next; batches that a whole corpus is fed in; copies of a frequent line's row.
FANOUT, BATCHES, SALTS = 2, 4, 16
MIN_CHARS, MIN_DOCS = 1, 10


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def digest(key: Column) -> Column:
    """128 bits of the key, which stand for it."""
    return F.unhex(F.md5(key))


class LineRuns:
    """The levelled runs: add() a batch's keys, unseen() and counts() read them. With min_docs, settled has runs of the
    keys (h) that at least so many documents have, and levels only the others."""

    def __init__(self, fanout: int = FANOUT, min_docs: int | None = None):
        self.fanout, self.min_docs, self.levels, self.settled = fanout, min_docs, {}, []

    def add(self, batch: DataFrame) -> None:
        """batch: h binary, n long, one row a key. Merges levels that are full."""
        level, run = 0, self._without(batch, self.settled)
        while True:
            own = self.levels.setdefault(level, [])
            own.append(cut(run.sortWithinPartitions("h"), f"run{level}"))
            if len(own) < self.fanout:
                return
            run, self.levels[level] = self._settle(self._merged(own)), []
            level += 1

    def _settle(self, run: DataFrame) -> DataFrame:
        if self.min_docs is None:
            return run
        run = cut(run, "merged")
        self.settled.append(cut(run.where(F.col("n") >= self.min_docs).select("h").sortWithinPartitions("h"), "settled"))
        return run.where(F.col("n") < self.min_docs)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return union(runs).groupBy("h").agg(F.sum("n").alias("n")) if len(runs) > 1 else runs[0]

    @staticmethod
    def _without(batch: DataFrame, runs: list[DataFrame]) -> DataFrame:
        for run in runs:
            batch = batch.join(run.select("h").hint("merge"), "h", "left_anti")
        return batch

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels.values() for r in level]

    def counts(self) -> DataFrame:
        return self._merged(self.runs())

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of batch (h binary, ...) whose key no run has: one merge-anti-join a run."""
        return self._without(batch, [*self.settled, *self.runs()])

    def frequent(self) -> DataFrame:
        """(h): the keys that at least min_docs documents have; each is in one settled run or in none."""
        return union([*self.settled, self.counts().where(F.col("n") >= self.min_docs).select("h")])


def keyed_lines(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(row, h): each distinct key of at least min_chars code points of each row, by a number of the row."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text_col)), line_key), lambda k: F.char_length(k) >= min_chars))
    return docs.select("row", F.explode(keys).alias("k")).select("row", digest(F.col("k")).alias("h"))


def frequent_keys(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(h): keys that at least min_docs rows of docs have, from runs that each batch of rows adds to."""
    runs = LineRuns(min_docs=min_docs)
    keyed = cut(keyed_lines(docs.withColumn("row", F.monotonically_increasing_id()), text_col, min_chars).groupBy((F.pmod(F.xxhash64("row"), F.lit(batches))).cast("int").alias("batch"), "h").agg(F.count(F.lit(1)).alias("n")), "batches")
    for b in range(batches):
        runs.add(keyed.where(F.col("batch") == b).select("h", "n"))
    return runs.frequent()


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the columns lines_ (lines before) and dropped_ (lines lost), and in text_col the lines that stay.

    Lines are split at \\n; a null or empty text has one empty line and stays as it is. Keys of at least min_chars code
    points that at least min_docs rows have lose all their lines in every row; a key counts once a row, and rows that
    repeat count each. Very long texts are split whole. Columns of docs keep their names; the new ones get an underscore more
    where a name is taken. An empty table gives an empty one. Lines that stay keep their own spelling. A text that loses all its lines becomes empty."""
    row, lines, drop = unused(docs, "row", "lines", "drop")
    docs = steady(docs)
    often = cut(frequent_keys(docs, text_col, min_docs, min_chars), "frequent")
    told = docs.withColumn(row, F.monotonically_increasing_id())
    at = told.select(F.col(row).alias("row"), F.posexplode(F.transform(lines_of(F.col(text_col)), line_key)).alias("pos", "k")).where(F.char_length("k") >= min_chars)
    at = at.select("row", "pos", digest(F.col("k")).alias("h"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    salted = often.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    gone = at.join(salted.hint("merge"), ["h", "salt"], "left_semi").groupBy("row").agg(F.collect_list("pos").alias("gone"))
    both = told.join(gone.select(F.col("row").alias(f"{row}_"), F.col("gone").alias(drop)), F.col(row) == F.col(f"{row}_"), "left")
    both = both.withColumn(lines, lines_of(F.col(text_col)))
    n, lost = unused(docs, "lines_", "dropped_")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))  # by hash, linear in the lines
    kept = F.concat_ws("\n", F.transform(places, lambda i: F.get(F.col(lines), i)))
    return both.select(
        *[F.when(F.col(drop).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias(n), F.coalesce(F.size(F.col(drop)), F.lit(0)).cast("long").alias(lost),
    )


def dedup_documents(docs: DataFrame, **how) -> DataFrame:
    """dedup_lines() with the columns of docs alone; n_chars, where there is one, follows the text."""
    out = dedup_lines(docs, **how).select(*docs.columns)
    text = how.get("text_col", "text")
    return out.withColumn("n_chars", F.char_length(F.coalesce(text, F.lit(""))).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
