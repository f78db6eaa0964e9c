"""Items from metadata and analysis, and the whole way from shares to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curio.functions.classify import merge_model_replies
from curio.functions.text import is_blank
from curio.functions.urls import resolve_requests
from curio.operators import pages as P
from curio.sources.schemas import ITEM_COLUMNS, ITEM_SCHEMA, REPLY_SCHEMA


def build_items(analysed: DataFrame, now: Column, keep: list[str] | None = None) -> DataFrame:
    """Items of metadata with analysis (and source_app, id): active, without a cover, created now. Without an id
    column the id is a hash of final_url, so that a batch that is run again gives the same items."""
    kinds = {f.name: f.dataType for f in ITEM_SCHEMA}
    parts = {c: F.col(f"analysis.{c}") for c in "summary category keywords entities sentiment content_type importance_score notes".split()}
    fixed = {
        "id": F.col("id") if "id" in analysed.columns else F.sha2("final_url", 256), "source_app": F.col("source_app") if "source_app" in analysed.columns else F.lit(None),
        "remote_image_url": F.lit(None), "cover_cached_at": F.lit(None), "cover_checked_at": F.lit(None), "status": F.lit("active"), "created_at": now, "updated_at": now,
    }
    return analysed.select(*[(parts.get(c) if c in parts else fixed.get(c, F.col(c))).cast(kinds[c]).alias(c) for c in ITEM_COLUMNS], *(keep or []))


def reanalyze_items(items: DataFrame, replies: DataFrame, now: Column) -> DataFrame:
    """items analysed again from what they keep: id, created_at and status stay, covers are forgotten."""
    local = F.col("image_url").startswith("/media/")
    image = F.coalesce("remote_image_url", F.when(~local, F.col("image_url")))
    original = F.when(is_blank("original_text"), F.col("content_text")).otherwise(F.col("original_text"))
    kept = "source_url final_url source_app platform title description author content_text".split()
    rows = items.select("id", *kept, image.alias("image_url"), original.alias("original_text"), F.col("status").alias("_status"), F.col("created_at").alias("_created"))
    analysed = merge_model_replies(rows, replies)
    built = build_items(analysed, now, keep=["_status", "_created"])
    state = {"status": F.col("_status"), "created_at": F.col("_created")}
    return built.select(*[state.get(c, F.col(c)).alias(c) for c in ITEM_COLUMNS])


def ingest_shares(shares: DataFrame, pages: DataFrame, now: Column, replies: DataFrame | None = None, rendered: DataFrame | None = None, payloads: DataFrame | None = None) -> DataFrame:
    """Items with seq of share requests (url, shared_text, source_app, seq): each URL in them, landed page, renderings
    and payloads merged in, analysed. Requests without a URL, or with one that is none, give no items. Each URL is
    looked up once. seq orders them for the store's upsert, which merges repeats."""
    rows = P.merge_pages(P.seed_metadata(found_urls(shares)), pages)
    if rendered is not None:
        rows = P.merge_rendered(rows, rendered)
    if payloads is not None:
        rows = P.merge_api_payloads(rows, payloads)
    return _analysed(rows, now, replies)


def found_urls(shares: DataFrame) -> DataFrame:
    """A row (seq, shared_text, source_app, at, source_url) for each URL of share requests; other columns stay."""
    rest = [c for c in shares.columns if c not in ("url", "shared_text", "source_app")]
    return resolve_requests(shares).where("reject is null").select(*rest, "shared_text", "source_app", F.posexplode("urls").alias("at", "source_url"))


def ingest_landed(found: DataFrame, now: Column, replies: DataFrame | None = None) -> DataFrame:
    """As ingest_shares(), of found_urls() that are joined with their fetches already (struct _p, null where none came)."""
    return _analysed(P.merge_landed(P.seed_metadata(found)), now, replies)


def _analysed(rows: DataFrame, now: Column, replies: DataFrame | None) -> DataFrame:
    none = rows.sparkSession.createDataFrame([], REPLY_SCHEMA)
    analysed = merge_model_replies(P.finish_metadata(rows), replies if replies is not None else none)
    return build_items(analysed.withColumn("seq", F.col("seq") * 1_000_000 + F.col("at")), now, keep=["seq"])
