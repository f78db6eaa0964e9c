"""Filters, search, order, counts and the digest of a collection of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curio.functions import lists
from curio.functions.text import clean_text, one_line, is_blank, trim, truncate_chars
from curio.plans.scratch import cut
from curio.sources.schemas import ITEM_COLUMNS
from curio.sources.tables import WRITTEN

TOP = 20
#: The fields that a search looks in, in the order in which they are put together.
SEARCHED = "title description summary category platform source_url final_url source_app author content_type notes keywords entities content_text".split()


def haystack() -> Column:
    """What a search looks in: fourteen fields, one space between, lower case."""
    value = lambda c: F.coalesce(F.array_join(c, " ") if c in ("keywords", "entities") else F.col(c), F.lit(""))
    return F.lower(F.concat_ws(" ", *[value(c) for c in SEARCHED]))


def search_items(items: DataFrame, query: str | None) -> DataFrame:
    """items in whose fields, put together, the trimmed query stands, whatever the case. Only a query with a space can
    run over a border of fields; any other is looked for field by field, the short ones first."""
    needle = (query or "").strip().lower()
    if not needle:
        return items
    if any(c.isspace() for c in needle):
        return items.where(haystack().contains(F.lit(needle)))
    hit = F.lit(False)
    for c in SEARCHED:
        value = F.array_join(c, " ") if c in ("keywords", "entities") else F.col(c)
        hit = hit | F.coalesce(F.lower(value).contains(F.lit(needle)), F.lit(False))
    return items.where(hit)


def filter_items(items: DataFrame, query: str | None = None, category: str | None = None, platform: str | None = None, status: str | None = None) -> DataFrame:
    """All given conditions; None or '' is none. Equality first, so that the scan gets it."""
    for name, value in (("status", status), ("category", category), ("platform", platform)):
        if value:
            items = items.where(F.col(name) == value)
    return search_items(items, query)


def active_items(items: DataFrame) -> DataFrame:
    return items.where("status <> 'archived'")


def get_items(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id").distinct(), "id", "left_semi")


ORDERS = {
    "newest": [("created_at", True), ("title", False)],
    "oldest": [("created_at", False), ("title", False)],
    "importance": [("importance_score", True), ("created_at", True), ("title", False)],
}


def order_of(sort: str | None) -> list[Column]:
    """Unknown orders are the newest first; ties are broken by id."""
    return [F.desc(c) if down else F.asc(c) for c, down in ORDERS.get(sort or "newest", ORDERS["newest"])] + [F.asc("id")]


def sort_items(items: DataFrame, sort: str | None = None) -> DataFrame:
    return items.orderBy(*order_of(sort))


def list_items(items: DataFrame, sort: str | None = None, limit: int | None = None, **filters) -> DataFrame:
    found = sort_items(filter_items(items, **filters), sort)
    return found.limit(limit) if limit else found


def list_page(items: DataFrame, size: int, after: dict | None = None, sort: str | None = None, **filters) -> DataFrame:
    """The page of a listing that follows the item `after` (its id and the columns of the order; None: the first page).
    The place is a condition on the order's own columns, not a number of rows to skip: the scan takes its first part as
    a filter, each task keeps at most `size` rows, and items added meanwhile shift no page. Needs no nulls in the
    columns of the order, which items do not have."""
    found = filter_items(items, **filters)
    if after is not None:
        keys = [*ORDERS.get(sort or "newest", ORDERS["newest"]), ("id", False)]
        beyond, first = F.lit(False), keys[0]
        for name, down in reversed(keys):
            at = F.lit(after[name])
            beyond = (F.col(name) < at if down else F.col(name) > at) | ((F.col(name) == at) & beyond)
        bound = F.lit(after[first[0]])
        found = found.where(F.col(first[0]) <= bound if first[1] else F.col(first[0]) >= bound).where(beyond)
    return sort_items(found, sort).limit(size)


def recent_items(items: DataFrame, most: int = 8) -> DataFrame:
    return project_digest_item(sort_items(active_items(items)).limit(most))


def project_digest_item(items: DataFrame) -> DataFrame:
    return items.select("id", "title", "platform", "category", truncate_chars("summary", 140).alias("summary"), "created_at")


def count_by(values: DataFrame, label: str, most: int = TOP) -> DataFrame:
    """(label, count) of the trimmed, non-blank values: the most frequent, ties by label."""
    counted = values.select(trim(label).alias("label")).where("label <> ''").groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "label").limit(most)


def count_categories(items: DataFrame) -> DataFrame:
    return count_by(items, "category")


def count_platforms(items: DataFrame) -> DataFrame:
    return count_by(items, "platform")


def count_keywords(items: DataFrame) -> DataFrame:
    return count_by(items.select(F.explode("keywords").alias("keyword")), "keyword")


def label_rows(items: DataFrame, *keep: str) -> DataFrame:
    """(dim, label) and the columns kept, for each trimmed, non-blank category, platform and keyword of items."""
    pair = lambda name, c: F.struct(F.lit(name).alias("dim"), c.alias("label"))
    pairs = F.concat(
        F.array(pair("category", F.col("category")), pair("platform", F.col("platform"))),
        F.coalesce(F.transform("keywords", lambda k: pair("keyword", k)), F.array().cast("array<struct<dim:string,label:string>>")),
    )
    return items.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.dim", trim("p.label").alias("label")).where("label <> ''")


def rank_labels(counted: DataFrame, most: int = TOP) -> DataFrame:
    """(dim, label, count, place) of (dim, label, count): the most frequent of each dimension, ties by label."""
    place = F.row_number().over(W.partitionBy("dim").orderBy(F.desc("count"), "label"))
    return counted.withColumn("place", place).where(F.col("place") <= most)


def top_labels_per_dimension(items: DataFrame, most: int = TOP) -> DataFrame:
    """(dim, label, count, place): categories, platforms and keywords in one pass over items, counted before ranking."""
    return rank_labels(label_rows(items).groupBy("dim", "label").agg(F.count(F.lit(1)).alias("count")), most)


def buckets_of(top: DataFrame) -> DataFrame:
    """One row: the three top lists as arrays of (label, count)."""
    take = lambda dim: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("dim") == dim, F.struct("place", "label", "count")))), lambda b: F.struct(b["label"].alias("label"), b["count"].alias("count"))
    )
    return top.agg(take("category").alias("categories"), take("platform").alias("platforms"), take("keyword").alias("keywords"))


def collection_stats(items: DataFrame, **filters) -> DataFrame:
    """One row: total (blank labels too), categories, platforms, keywords of the filtered items."""
    found = filter_items(items, **filters)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return total.join(buckets_of(top_labels_per_dimension(found)))  # two tables of one row


def focus_summary() -> Column:
    """Text from the columns categories, platforms and keywords."""
    some = lambda c, n, f: F.array_join(F.transform(F.slice(c, 1, n), f), "、")
    categories = some("categories", 3, lambda b: F.concat(b["label"], F.lit(" "), b["count"].cast("string")))
    platforms = some("platforms", 2, lambda b: b["label"])
    keywords = some("keywords", 4, lambda b: b["label"])
    parts = F.concat(
        F.lit(lists.FOCUS_CATEGORIES), categories,
        F.when(platforms != "", F.concat(F.lit(lists.FOCUS_PLATFORMS), platforms)).otherwise(F.lit("")),
        F.when(keywords != "", F.concat(F.lit(lists.FOCUS_KEYWORDS), keywords)).otherwise(F.lit("")), F.lit(lists.FOCUS_END),
    )
    return F.when(F.size("categories") == 0, F.lit(lists.DIGEST_EMPTY)).otherwise(parts)


def digest_suggestions(first_hint: str = lists.HINT_FIRST) -> Column:
    """Array of hints from total, categories, platforms and keywords."""
    first = lambda c: F.try_element_at(c, F.lit(1))
    category, platform = first("categories"), first("platforms")
    offers = F.exists("keywords", lambda b: b["label"].contains("优惠") | b["label"].contains("券"))
    hints = F.array_compact(
        F.array(
            F.when(category["count"] >= 5, F.concat(F.lit(lists.HINT_CATEGORY[0]), category["label"], F.lit(lists.HINT_CATEGORY[1]))),
            F.when(platform["count"] >= 4, F.concat(F.lit(lists.HINT_PLATFORM[0]), platform["label"], F.lit(lists.HINT_PLATFORM[1]))),
            F.when(offers, F.lit(lists.HINT_OFFERS)),
        )
    )
    hints = F.when(F.size(hints) == 0, F.array(F.lit(lists.HINT_BALANCED))).otherwise(hints)
    tidy = F.slice(F.array_distinct(F.filter(F.transform(hints, clean_text), lambda h: h != "")), 1, 5)
    return F.when(F.col("total") == 0, F.array(F.lit(first_hint))).otherwise(tidy)


def collection_digest(items: DataFrame, generated_at: Column, first_hint: str = lists.HINT_FIRST) -> DataFrame:
    """One row: total, generated_at, focus_summary, category_summaries, recent_items, suggestions of the active items."""
    # The few columns that count are worked out once, for three uses.
    active = cut(active_items(items).select("id", "title", "platform", "category", "keywords", "summary", "created_at"))
    return digest_row(collection_stats(active), active, generated_at, first_hint)


def digest_row(stats: DataFrame, active: DataFrame, generated_at: Column, first_hint: str = lists.HINT_FIRST) -> DataFrame:
    """The digest of collection_stats()' row and a table that holds at least the eight newest active items."""
    newest = project_digest_item(sort_items(active).limit(8)).select(F.struct((-F.unix_micros("created_at")).alias("order"), "title", "id", "platform", "category", "summary", "created_at").alias("r"))
    fields = "id title platform category summary created_at".split()
    recent = newest.agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias("recent_items"))
    row = stats.join(recent)
    return row.select("total", generated_at.alias("generated_at"), focus_summary().alias("focus_summary"), F.col("categories").alias("category_summaries"), "recent_items", digest_suggestions(first_hint).alias("suggestions"))


def item_markdown() -> Column:
    """An item's block of the Markdown export."""
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), value, F.lit("\n"))
    body = F.when(is_blank("original_text"), trim("content_text")).otherwise(trim("original_text"))
    none = F.lit("")
    return F.concat(
        F.lit("### "), one_line("title"), F.lit("\n\n"),
        line("Platform", one_line("platform")), line("Category", one_line("category")), line("Type", one_line("content_type")), line("Status", one_line("status")),
        line("Importance", F.col("importance_score").cast("string")), line("Created", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss 'UTC'")), line("URL", F.col("final_url")),
        F.when(F.size("keywords") > 0, line("Keywords", F.array_join(F.transform("keywords", one_line), ", "))).otherwise(none), F.lit("\n"),
        F.when(is_blank("summary"), none).otherwise(F.concat(one_line("summary"), F.lit("\n\n"))),
        F.when(body == "", none).otherwise(F.concat(F.lit("#### 原文\n\n"), body, F.lit("\n\n"))),
        F.when(is_blank("notes"), none).otherwise(F.concat(F.lit("> Notes: "), one_line("notes"), F.lit("\n\n"))),
    )


def markdown_header(items: DataFrame, generated_at: Column, heading: str = "Collection Export") -> DataFrame:
    """One row, header: everything above the items' blocks."""
    stored = items.agg(F.count(F.lit(1)).alias("stored"))
    rows = F.array_join(F.transform("category_summaries", lambda b: F.concat(F.lit("- "), b["label"], F.lit(": "), b["count"].cast("string"), F.lit("\n"))), "")
    text = F.concat(
        F.lit(f"# {heading}\n\n- Generated: "), F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit("\n- Total active items: "), F.col("total").cast("string"),
        F.lit("\n- Total stored items: "), F.col("stored").cast("string"), F.lit("\n\n## Collection Summary\n\n"), F.col("focus_summary"), F.lit("\n\n"),
        F.when(F.size("category_summaries") > 0, F.concat(F.lit("### Categories\n\n"), rows, F.lit("\n"))).otherwise(F.lit("")), F.lit("## Items\n\n"),
    )
    return collection_digest(items, generated_at).join(stored).select(text.alias("header"))


def export_markdown(items: DataFrame) -> DataFrame:
    """(id, block) in store order; markdown_header() stands above. Blocks stay rows: a collection can be large."""
    return sort_items(items).select("id", item_markdown().alias("block"))


def export_json(items: DataFrame, generated_at: Column) -> DataFrame:
    """(part, place, line): the lines of one JSON document, in the order of part and place: the envelope with its digest
    (part 0), an item on each line in store order (part 1), the end (part 2). Lines stay rows: a collection can be
    large. Only the first item's order, one row, is looked up besides, for the commas."""
    count = items.agg(F.count(F.lit(1)).alias("item_count"))
    digest = collection_digest(items, generated_at)
    envelope = digest.select(F.struct(*digest.columns).alias("digest")).join(count)
    fields = F.struct(F.lit(1).alias("schema_version"), F.col("digest.generated_at").alias("generated_at"), "item_count", "digest")
    nothing = F.lit(None).cast("struct<micros:bigint,title:string,id:string>")
    head = envelope.select(F.lit(0).alias("part"), nothing.alias("place"), F.concat(F.regexp_replace(F.to_json(fields, WRITTEN), r"\}$", ""), F.lit(',"items":[')).alias("line"))
    place = F.struct((-F.unix_micros("created_at")).alias("micros"), "title", "id")
    lines = items.select(F.lit(1).alias("part"), place.alias("place"), F.to_json(F.struct(*ITEM_COLUMNS), WRITTEN).alias("line"))
    first = items.agg(F.min(place).alias("_first"))
    lines = lines.join(F.broadcast(first)).select("part", "place", F.when(F.col("place") == F.col("_first"), F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line"))
    end = count.select(F.lit(2).alias("part"), nothing.alias("place"), F.lit("]}").alias("line"))
    return head.union(lines).union(end)


def write_export_json(items: DataFrame, path: str, generated_at: Column) -> None:
    """export_json() as text files: in the order of their names they are one JSON document."""
    export_json(items, generated_at).orderBy("part", "place").select("line").write.mode("overwrite").text(path)


def validate_import(items: DataFrame) -> DataFrame:
    """items with reason: the first rule that an item breaks, or null."""
    version = F.col("schema_version") if "schema_version" in items.columns else F.lit(1)
    reason = (
        F.when(version.isNull() | (version != 1), "unsupported schema_version")
        .when(is_blank("id"), "empty id")
        .when(is_blank("source_url") | is_blank("final_url"), "empty URL")
        .when(is_blank("title"), "empty title")
        .when(~F.coalesce(F.col("status").isin(lists.STATUSES), F.lit(False)), "bad status")
    )
    return items.withColumn("reason", reason)


def validate_status(patches: DataFrame) -> DataFrame:
    return patches.withColumn("valid", F.coalesce(F.col("status").isin(lists.STATUSES), F.lit(False)))


