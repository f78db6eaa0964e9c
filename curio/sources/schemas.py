"""Schemas of the tables that the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, TIME = T.StringType(), T.TimestampType()


def _fields(text: str) -> list[T.StructField]:
    """'name' for a required string, 'name?' for a nullable one, 'name[]' for an array."""
    out = []
    for x in text.split():
        name = x.rstrip("?[]")
        out.append(T.StructField(name, T.ArrayType(STRING) if x.endswith("[]") else STRING, True))
    return out


ITEM_SCHEMA = T.StructType(
    [
        *_fields("id source_url final_url source_app? platform title description author? image_url? remote_image_url?"),
        T.StructField("cover_cached_at", TIME),
        T.StructField("cover_checked_at", TIME),
        *_fields("content_text original_text summary category keywords[] entities[] sentiment content_type"),
        T.StructField("importance_score", T.ShortType()),
        *_fields("notes status"),
        T.StructField("created_at", TIME),
        T.StructField("updated_at", TIME),
    ]
)
ITEM_COLUMNS = ITEM_SCHEMA.fieldNames()
#: Fields that must be there when an item is read; original_text and the rest have defaults.
REQUIRED = [c for c in ITEM_COLUMNS if c not in "source_app author image_url remote_image_url cover_cached_at cover_checked_at original_text".split()]
METADATA_COLUMNS = "source_url final_url platform title description author image_url content_text original_text".split()
SHARE_SCHEMA = T.StructType(_fields("url? shared_text? source_app?"))
PAGE_SCHEMA = T.StructType([*_fields("source_url final_url"), T.StructField("http_status", T.IntegerType()), *_fields("body? error?")])
RENDERED_SCHEMA = T.StructType([T.StructField("ok", T.BooleanType()), *_fields("source_url final_url? title? description? author? image_url? content_text? extractor?")])
PAYLOAD_SCHEMA = T.StructType(_fields("platform post_id payload?"))
REPLY_SCHEMA = T.StructType(_fields("item_key reply?"))
#: A log of edits, see store.apply_edits(): of each row the fields of its kind count.
EDIT_SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType()), *_fields("id kind status? category? keywords[] notes? image_url? remote_image_url?"), T.StructField("cover_cached_at", TIME), T.StructField("cover_checked_at", TIME), T.StructField("at", TIME)]
)
