"""Kernels over rows or drawings of which many are alike: each kind is worked out once, and its result is that of all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.plans.shared import cut


def tasks(df: DataFrame) -> int:
    """An explicit number of partitions, for stages whose rows are few bytes and much work: those would be merged."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def settled(df: DataFrame) -> DataFrame:
    """df, which gives the same rows whenever it is read; written once where its expressions would draw anew."""
    return df if df._jdf.queryExecution().analyzed().deterministic() else cut(df, "settled")


def _text(columns: list[str]) -> Column:
    """The values as text, signs of zeros and all digits included."""
    return F.to_json(F.struct(*columns))


def kinds_of_drawings(df: DataFrame) -> DataFrame:
    """drawing_id, first: the least drawing_id of those that have the same rows. Rows are told by sums of 128 bits of hash,
    so drawings are compared without being put together."""
    text = df.select("drawing_id", _text([c for c in df.columns if c != "drawing_id"]).alias("t"))
    hashed = text.select("drawing_id", F.xxhash64(F.lit(1), "t").alias("g"), F.xxhash64(F.lit(2), "t").alias("h"))
    halves = [(c, f) for c in "gh" for f in (lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)), lambda x: F.shiftrightunsigned(x, 32))]
    sums = [F.sum(f(F.col(c))).alias(f"s{i}") for i, (c, f) in enumerate(halves)]
    told = hashed.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("s4"), *sums)
    return told.select("drawing_id", F.min("drawing_id").over(Window.partitionBy(*[f"s{i}" for i in range(5)])).alias("first"))


def each_kind(rows: DataFrame, columns: list[str], f: Callable, schema: str) -> DataFrame:
    """rows: id and columns: what f, a function of frames with id and columns, gives for each id. f gets one row for each
    different value of the columns; ids in it stand for those values (schema without the id)."""
    rows = settled(rows.select("id", *columns))
    keyed = rows.withColumn("_key", F.sha2(_text(columns), 256))
    different = keyed.select(F.col("_key").alias("id"), *columns).dropDuplicates(["id"]).repartition(tasks(rows), "id")
    found = different.mapInPandas(f, f"id string, {schema}").withColumnRenamed("id", "_key")
    return keyed.select("id", "_key").join(found, "_key").drop("_key")
