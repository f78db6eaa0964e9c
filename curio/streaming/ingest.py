"""Shares that arrive as files become items of an addressed store, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curio.operators.addressed import Store
from curio.operators.items import found_urls, ingest_landed, ingest_shares
from curio.operators.pages import LANDED
from curio.plans.scratch import numbered
from curio.sources import schemas as S


def read_share_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Shares of the JSON files in a folder, with the file they came in and its time, which give their order."""
    shares = spark.readStream.schema(S.SHARE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return shares.select("*", F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("place"))


def load(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The items of a store of ingest(), of the batches before that number if one is given."""
    return Store.open(spark, store).load(before)


def compact(spark: SparkSession, store: str, into: str, buckets: int = 64) -> None:
    """Writes the items of a store into a new one with that many buckets, as its first batch; for between two runs."""
    Store.open(spark, store).rehash(into, buckets)


def ordered(batch: DataFrame) -> DataFrame:
    """The shares of a batch with seq: a total order, as the store's semantics ask."""
    return numbered(batch, ["arrived", "file", "place", F.xxhash64("url", "shared_text", "source_app")], "seq").drop("arrived", "file", "place")


def ingest(shares: DataFrame, pages: Callable[[], DataFrame], store: str, checkpoint: str, now: Callable | None = None, buckets: int = 64) -> StreamingQuery:
    """Runs until all shares that have arrived are in the store.

    A batch reads the buckets of the store that its ids and URLs fall into, of the batches before it, and writes the
    items that it makes or touches into the same buckets. One that is run again after a failure writes the same once
    more, in place of the first. A late share is merged by its keys like any other, so there is no watermark; ids come
    from URLs.
    """
    held = Store.open(shares.sparkSession, store, buckets)

    def take(batch: DataFrame, number: int) -> None:
        held.upsert(number, ingest_shares(ordered(batch), pages(), now() if now else F.current_timestamp()))

    return shares.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_page_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Fetches (PAGE_SCHEMA) that land as Parquet files, with the time at which they landed."""
    pages = spark.readStream.schema(S.PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return pages.select("*", F.col("_metadata.file_modification_time").alias("landed_at"))


def ingest_waiting(shares: DataFrame, pages: DataFrame, store: str, checkpoint: str, wait: str = "1 hour", late: str = "10 minutes", now: Callable | None = None, buckets: int = 64) -> StreamingQuery:
    """As ingest(), with the fetches as a stream of their own: a URL's share waits for its page, and a page for shares.

    A share is taken in with a fetch that landed up to `wait` before or after it, whichever of both comes first; of
    several in one batch the last one landed counts, and one that comes in a later batch is taken in anew. A share for
    which none comes is taken in with the note of a failed fetch once both streams' times have passed `wait` (streams
    may be `late` out of order). Then both rows leave the state: it holds what arrived in that time, not the store.
    """
    held = Store.open(shares.sparkSession, store, buckets)
    urls = found_urls(shares.withWatermark("arrived", late).withColumn("_order", F.struct("arrived", "file", "place", F.xxhash64("url", "shared_text", "source_app").alias("of"))))
    urls = urls.drop("file", "place")
    fetches = pages.select(F.col("source_url").alias("_url"), F.struct(*LANDED).alias("_p"), "landed_at").withWatermark("landed_at", late)
    near = F.expr(f"landed_at >= arrived - INTERVAL {wait} AND landed_at <= arrived + INTERVAL {wait}")
    joined = urls.join(fetches, (F.col("source_url") == F.col("_url")) & near, "leftOuter").drop("_url")

    def take(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in ("_p", "landed_at")]
        one = batch.groupBy(*rest).agg(F.max_by("_p", F.struct(F.col("landed_at"), F.col("_p"))).alias("_p"))
        placed = numbered(one, ["_order", "at"], "seq").drop("_order", "arrived")
        held.upsert(number, ingest_landed(placed, now() if now else F.current_timestamp()))

    return joined.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
