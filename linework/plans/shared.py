"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark removes the shuffle files of a query as soon as it has ended; else they stay until the driver's heap is
#: collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local master gets a new
    local folder; on a cluster, whose machines do not share local folders, it is an error."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="linework-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, a lost executor costs nothing that is
    already written, and Spark knows the real size when it picks a join. The files go when the driver ends, those of the
    shuffles that led to them once they are written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linework-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
