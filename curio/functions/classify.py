"""Classification columns: category, content type, keywords, entities, summary, and the whole analysis of a link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curio.functions import lists
from curio.functions.text import col, is_blank, once, truncate_chars

KEYWORD = r"[A-Za-z][A-Za-z0-9_+\-.]{2,}|[\p{IsHan}]{2,8}"


def _any(text: Column, words: list[str]) -> Column:
    """Whether text has one of the words: plain searches one after another, which end at the first hit."""
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def infer_category(text: Column | str, platform: Column | str) -> Column:
    platform = col(platform)

    def rules(low: Column) -> Column:
        out = None
        for name, category in lists.STRICT_PLATFORMS.items():
            hit = (platform == name) & ~_any(low, lists.TECHNICAL)
            out = F.when(hit, F.lit(category)) if out is None else out.when(hit, F.lit(category))
        for category, words in lists.CATEGORIES:
            out = out.when(_any(low, words), F.lit(category))
        for category, names in lists.PLATFORM_CATEGORIES:
            out = out.when(platform.isin(names), F.lit(category))
        return out.otherwise(F.lit(lists.OTHER_CATEGORY))

    return once(F.lower(col(text)), rules)


def infer_content_type(url: Column | str, text: Column | str) -> Column:
    def rules(low: Column) -> Column:
        out = None
        for i, (kind, parts) in enumerate(lists.CONTENT_TYPES):
            hit = _any(low, parts)
            if i == len(lists.CONTENT_TYPES) - 1:
                hit = hit | (F.char_length(col(text)) > lists.LONG_ARTICLE)
            out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
        return out.otherwise(F.lit("link"))

    return once(F.lower(F.concat_ws(" ", col(url), col(text))), rules)


def extract_keywords(text: Column | str, most: int = 12) -> Column:
    found = F.array_distinct(F.regexp_extract_all(col(text), F.lit(KEYWORD), F.lit(0)))
    return F.slice(F.filter(found, lambda w: ~w.isin(lists.STOP_WORDS)), 1, most)


def extract_entities(text: Column | str) -> Column:
    return once(text, lambda t: F.filter(F.array(*[F.lit(e) for e in lists.ENTITIES]), lambda e: F.contains(t, e)))


def fallback_summary(description: Column | str, content: Column | str, platform: Column | str) -> Column:
    return (
        F.when(~is_blank(description), truncate_chars(description, 160))
        .when(~is_blank(content), truncate_chars(content, 160))
        .otherwise(F.concat(F.lit(lists.FALLBACK_SUMMARY[0]), col(platform), F.lit(lists.FALLBACK_SUMMARY[1])))
    )


def is_blocked(title: Column | str, content: Column | str) -> Column:
    hit = col(title).contains(lists.BLOCKED_TITLE)
    for part in lists.BLOCKED_TEXTS:
        hit = hit | col(content).contains(part)
    return hit


def prompt_payload(metadata: DataFrame) -> Column:
    """The JSON text that a model is asked about."""
    fields = [F.col("final_url").alias("url"), "platform", "title", "description", "author", truncate_chars("content_text", 7000).alias("content_text")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _sorted_set(words: Column, most: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(words)), 1, most)


def heuristic_analysis(note: Column) -> Column:
    """The analysis of a row of metadata by rules alone."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce("content_text", F.lit("")))

    def analysis(text: Column, category: Column) -> Column:
        return F.struct(
            fallback_summary("description", "content_text", "platform").alias("summary"),
            category.alias("category"),
            _sorted_set(F.concat(F.array(F.col("platform"), category), extract_keywords(text)), 10).alias("keywords"),
            extract_entities(text).alias("entities"),
            F.lit("neutral").alias("sentiment"),
            infer_content_type("final_url", text).alias("content_type"),
            F.when(F.char_length("content_text") > 400, 66).otherwise(48).cast("smallint").alias("importance_score"),
            note.alias("notes"),
        )

    return once(text, lambda t: once(infer_category(t, "platform"), lambda c: analysis(t, c)))


def blocked_analysis() -> Column:
    """The analysis of a row of metadata whose page was walled off."""
    category = infer_category(F.lit(""), "platform")
    words = F.array(F.col("platform"), category, *[F.lit(k) for k in lists.BLOCKED_KEYWORDS])
    return F.struct(
        F.concat("platform", F.lit(lists.BLOCKED_SUMMARY)).alias("summary"),
        category.alias("category"),
        _sorted_set(words, 4).alias("keywords"),
        F.array("platform").alias("entities"),
        F.lit("neutral").alias("sentiment"),
        infer_content_type("final_url", "title").alias("content_type"),
        F.lit(36).cast("smallint").alias("importance_score"),
        F.lit(lists.BLOCKED_NOTES).alias("notes"),
    )


#: The types that a reply's fields must have, as the schema of a VARIANT names them; an array may be empty.
REPLY_TYPES = {
    "summary": ["STRING"], "category": ["STRING"], "keywords": ["ARRAY<STRING>", "ARRAY<VOID>"], "entities": ["ARRAY<STRING>", "ARRAY<VOID>"],
    "sentiment": ["STRING"], "content_type": ["STRING"], "importance_score": ["BIGINT"], "notes": ["STRING"],
}
REPLY = "summary string, category string, keywords array<string>, entities array<string>, sentiment string, content_type string, importance_score int, notes string"


def normalize_analysis(reply: Column | str) -> Column:
    """A model's JSON reply as an analysis; null unless it is an object with all eight fields, each of its type: nothing
    is converted, so a number is no text, 50.5 no score, and an array with a null no list of words."""
    # In brackets, so that text after the object makes the whole unreadable, or a second element.
    typed = F.try_parse_json(F.concat(F.lit("["), col(reply), F.lit("]")))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(typed, path, "variant"))
    whole = kind("$[1]").isNull()
    for field, kinds in REPLY_TYPES.items():
        whole = whole & kind(f"$[0].{field}").isin(kinds)
    r = F.from_json(col(reply), REPLY)
    whole = F.coalesce(whole & r["importance_score"].between(0, 255), F.lit(False))
    no_nulls = lambda words: ~F.exists(words, lambda w: w.isNull())
    whole = whole & F.coalesce(no_nulls(r["keywords"]) & no_nulls(r["entities"]), F.lit(False))
    filled = lambda c, text: F.when(is_blank(c), F.lit(text)).otherwise(c)
    present = lambda words: F.filter(words, lambda w: ~is_blank(w))
    return F.when(
        whole,
        F.struct(
            filled(r["summary"], lists.NO_SUMMARY).alias("summary"), filled(r["category"], lists.NO_CATEGORY).alias("category"),
            present(r["keywords"]).alias("keywords"), present(r["entities"]).alias("entities"), r["sentiment"].alias("sentiment"),
            r["content_type"].alias("content_type"), F.least(r["importance_score"], F.lit(100)).cast("smallint").alias("importance_score"), r["notes"].alias("notes"),
        ),
    )


def merge_model_replies(metadata: DataFrame, replies: DataFrame, note: str = "") -> DataFrame:
    """metadata (with final_url) with analysis: of blocked pages the fixed one, else the model's where a landed reply
    (item_key, reply) can be read, else the heuristic one with a note."""
    content = F.get_json_object("reply", "$.choices[0].message.content")
    one = replies.groupBy(F.col("item_key").alias("_key")).agg(F.max("reply").alias("reply"))
    joined = metadata.join(one, F.col("final_url") == F.col("_key"), "left")
    said = F.when(F.col("_key").isNull(), F.lit(note)).otherwise(F.lit(lists.UNREADABLE_REPLY))
    analysis = F.when(is_blocked("title", "content_text"), blocked_analysis()).otherwise(F.coalesce(normalize_analysis(content), heuristic_analysis(said)))
    return joined.withColumn("analysis", analysis).drop("_key", "reply")
