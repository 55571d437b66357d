"""Streams: sessions over events, and drawings that arrive as records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linework.sources.records import RECORDS, edges_from_records


def session_windows(events: DataFrame, key: str, gap: str, time: str = "ts", late: str | None = None) -> DataFrame:
    """key, lo, hi, n of each run of events that are at most gap apart; with late, on a stream with that watermark."""
    if late:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("lo"), F.col("w.end").alias("hi"), "n")


def drawing_stream(spark: SparkSession, path: str, read: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Record files (JSON lines) as they come, each batch through `read` (say heal_drawings) and into `sink`. A drawing
    must come whole in one file; drawings don't depend on each other, so there is no state."""
    rows = spark.readStream.schema(RECORDS).json(path)
    return rows.writeStream.foreachBatch(lambda batch, n: sink(read(edges_from_records(batch)), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
