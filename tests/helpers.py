from datetime import UTC, datetime, timedelta

from curio.sources.schemas import ITEM_COLUMNS, ITEM_SCHEMA

START = datetime(2024, 1, 1, tzinfo=UTC).replace(tzinfo=None)


def item(id="i1", url="https://example.org/1", minutes=0, **more):
    row = dict.fromkeys(ITEM_COLUMNS, "") | dict.fromkeys(["source_app", "author", "image_url", "remote_image_url", "cover_cached_at", "cover_checked_at"])
    row |= {
        "id": id, "source_url": url, "final_url": url, "platform": "GitHub", "title": "Title", "category": "技术", "keywords": ["a"], "entities": [], "sentiment": "neutral",
        "content_type": "link", "importance_score": 50, "status": "active", "created_at": START + timedelta(minutes=minutes), "updated_at": START + timedelta(minutes=minutes),
    }
    return row | more


def items(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ITEM_COLUMNS) for r in rows], ITEM_SCHEMA)
