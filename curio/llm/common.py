"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Word pattern of every contract here: what lies between space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Documents in fewer files than there are cores are dealt to all cores: a small file has one
    row group, which one task would read and work on alone."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and len(rows.inputFiles()) < cores else rows


def cut_dir(spark: SparkSession) -> str:
    """The checkpoint folder: that of spark.checkpoint.dir. Where it is unset, a local session gets one of its own and a
    cluster's is refused, as its machines share no temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def drop_tables(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this session, once its results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cut_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark's context cleaner drop the shuffles whose plans nobody holds any more, by a collection of the driver's
    garbage. Those of the last job may still be held by what reports on it."""
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the checkpoint folder, so that lost executors cost no recomputation. The shuffles that it
    replaces stay for a while: df's own plan ran and holds them. Behind large ones cut_table() stands."""
    cut_dir(df.sparkSession)
    return df.checkpoint()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, th (hash of the text) and rk (hash of both). rk and th are never null and name a row's contents,
    also where ids are null or repeat."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), F.xxhash64("text").alias("th"), "text")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", at_most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about at_most bytes of text (a single longer text stays whole)."""
    for batch in batches:
        index = batch.schema.get_field_index(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > at_most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Each text as UTF-8 bytes; null is empty."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [v or b"" for v in values.to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def running(rows: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """rows with the sum of each value over all rows before them in that order, without a task that holds them all:
    ranges are summed by themselves, and only the sums of ranges, one row each, by one window."""
    placed = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumns({f"_v{i}": v for i, v in enumerate(sums.values())}))
    upto = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    whole = placed.groupBy("_range").agg(*[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(sums))])
    whole = whole.select("_range", *[F.coalesce(F.sum(f"_s{i}").over(upto().orderBy("_range")), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    own = lambda i: F.coalesce(F.sum(f"_v{i}").over(upto("_range").orderBy(*order)), F.lit(0))
    joined = placed.join(F.broadcast(whole), "_range")  # a row for each range
    return joined.select(*rows.columns, *[(F.col(f"_b{i}") + own(i)).alias(name) for i, name in enumerate(sums)])


def cut_table(df: DataFrame) -> DataFrame:
    """As cut(), as a Parquet table in the same folder: smaller for large tables, and read by the column. The shuffles
    that it replaces belong to the plan of the write, which nobody holds, so they go at once or with the next call."""
    path = f"{cut_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
