"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir, and rows numbered in order."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it is unset, a local session gets one of its own and a cluster's is
    refused, as its machines share no temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


#: How tables are written: text takes about half the bytes of Spark's default.
PACKED = {"compression": "zstd"}
_passing = threading.local()


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """df as a table there: lost executors cost no recomputation, and later steps read the columns that they need. One
    that is made inside passing() goes at its end, unless it is to be kept."""
    path = new_path(df.sparkSession, "table")
    if not keep and getattr(_passing, "paths", None) is not None:
        _passing.paths.append(path)
    df.write.options(**PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """For a step whose results are written elsewhere: the tables that this thread cuts inside are deleted at its end, and
    so are the shuffles that nobody holds any more, by a collection of the driver's garbage."""
    outer, _passing.paths = getattr(_passing, "paths", None), []
    try:
        yield
    finally:
        paths, _passing.paths = _passing.paths, outer
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        spark._jvm.System.gc()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place in that order, from 1: ranges are sorted by themselves and numbered inside; only the sizes
    of the ranges, one row each, go through one window."""
    held = cut(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    place = (F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name)
    return held.join(F.broadcast(starts), part == F.col("_part")).select(*rows.columns, place)  # a row for each range


def running(rows: DataFrame, by: str, order: str, value, name: str) -> DataFrame:
    """rows with the sum of value over the rows before them in that order, for each `by`. Ranges are summed by
    themselves; only the sums of ranges, a row each, go through one window."""
    held = cut(rows.withColumn("_v", value).repartitionByRange(by, order).withColumn("_range", F.spark_partition_id()))
    upto = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    sums = held.groupBy(by, "_range").agg(F.sum("_v").alias("_s"))
    starts = sums.select(by, "_range", F.coalesce(F.sum("_s").over(upto(by).orderBy("_range")), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("_v").over(upto(by, "_range").orderBy(order)), F.lit(0))
    return held.join(starts, [by, "_range"]).select(*rows.columns, (F.col("_before") + own).alias(name))
