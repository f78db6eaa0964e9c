"""Items, patches and batches that are derived from the tables at hand, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.functions.text import clean_text, first_meaningful_line, truncate_chars
from curio.functions.urls import platform_for_url
from curio.functions import lists
from curio.sources.schemas import ITEM_COLUMNS, ITEM_SCHEMA

HOSTS = "www.xiaohongshu.com www.bilibili.com github.com zhuanlan.zhihu.com m.weibo.cn news.example.org amap.com www.youtube.com item.jd.com docs.google.com x.com mp.weixin.qq.com".split()
CATEGORIES = ["技术", " 美食 ", "旅行", "", "财经", "影音娱乐", "技术"]
START = 1_700_000_000
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table at hand. Tables of texts in fewer files than there are cores are dealt to all cores: a small file has one
    row group, which one task would read and work on alone."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and len(rows.inputFiles()) < cores else rows


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item for each document."""
    n = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    url = F.concat(F.lit("https://"), pick(HOSTS), F.lit("/item/"), n.cast("string"))
    minutes = n * 7919 % 100_000
    at = F.timestamp_seconds(F.lit(START) + minutes * 60)
    text = F.coalesce("text", F.lit(""))
    words = F.array_compact(F.array(F.col("lang"), F.col("source"), F.concat(F.lit("kw"), (n % 37).cast("string")), F.when(n % 10 == 0, F.lit("优惠券"))))
    values = {
        "id": F.concat(F.lit("doc-"), n.cast("string")), "source_url": F.concat(url, F.lit("?from=share")), "final_url": url,
        "source_app": F.when(n % 3 > 0, F.concat(F.lit("app"), (n % 3).cast("string"))), "platform": platform_for_url(url),
        "title": F.coalesce(first_meaningful_line(text), F.lit(lists.PLACEHOLDER_TITLE)), "description": truncate_chars("_clean", 200),
        "author": F.when(n % 4 > 0, F.col("source")), "image_url": F.when(n % 5 > 0, F.concat(F.lit("https://img.example.org/"), n.cast("string"), F.lit(".jpg"))).otherwise(F.lit("/media/cover-1.jpg")),
        "remote_image_url": F.when(n % 2 > 0, F.concat(F.lit("https://cdn.example.org/"), n.cast("string"), F.lit(".jpg"))),
        "cover_cached_at": F.lit(None), "cover_checked_at": F.when(n % 3 > 0, F.timestamp_seconds(F.lit(START) + minutes * 60 + n % 13 * 3600)),
        "content_text": F.col("_clean"), "original_text": text, "summary": truncate_chars("_clean", 160), "category": pick(CATEGORIES), "keywords": words,
        "entities": F.array_compact(F.array("source")), "sentiment": F.lit("neutral"), "content_type": F.lit("link"), "importance_score": F.coalesce("n_chars", F.lit(0)) % 101,
        "notes": F.when(n % 9 == 0, F.lit("seen  twice")).otherwise(F.lit("")), "status": F.element_at(F.array(*[F.lit(s) for s in ["active", "active", "archived", "favorite"]]), (n % 4 + 1).cast("int")),
        "created_at": at, "updated_at": at,
    }
    kinds = {f.name: f.dataType for f in ITEM_SCHEMA}
    # Cleaned once, for three columns.
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").withColumn("_clean", clean_text(text))
    return docs.select(*[values[c].cast(kinds[c]).alias(c) for c in ITEM_COLUMNS])


def event_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a batch of items: a URL for each user, in order of event_id; few fields matter."""
    e = table(spark, sf_dir, "events")
    kinds = {f.name: f.dataType for f in ITEM_SCHEMA}
    values = {
        "id": F.concat(F.lit("ev-"), F.col("event_id").cast("string")), "final_url": F.concat(F.lit("https://example.org/u/"), F.col("user_id").cast("string")), "title": F.col("event_type"),
        "category": F.col("event_type"), "status": F.lit("active"), "created_at": F.timestamp_seconds(F.lit(START) + F.col("event_id")), "updated_at": F.timestamp_seconds(F.lit(START) + F.col("event_id")),
    }
    plain = {"keywords": F.array().cast("array<string>"), "entities": F.array().cast("array<string>"), "importance_score": F.lit(1)}
    nulls = "source_app author image_url remote_image_url cover_cached_at cover_checked_at".split()
    of = lambda c: values.get(c, plain.get(c, F.lit(None) if c in nulls else F.lit("")))
    return e.select(*[of(c).cast(kinds[c]).alias(c) for c in ITEM_COLUMNS], F.col("event_id").alias("seq"))


def event_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the users with an even number, as an earlier state of the store."""
    batch = event_batch(spark, sf_dir).where(F.regexp_extract("final_url", "([0-9]+)$", 1).cast("long") % 2 == 0)
    first = batch.groupBy("final_url").agg(F.min("seq").alias("seq"))
    return batch.join(first, ["final_url", "seq"], "left_semi").withColumn("id", F.concat(F.lit("old-"), F.regexp_extract("final_url", "([0-9]+)$", 1))).drop("seq").select(*ITEM_COLUMNS)


# The same for DuckDB.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def one_line_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def clean_sql(c: str) -> str:
    return one_line_sql(f"replace(replace({c}, '&nbsp;', ' '), '&amp;', '&')")


def original_sql(c: str) -> str:
    """clean_original_text() of c."""
    out = c
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        out = f"replace({out}, '{entity}', '{plain}')"
    out = f"replace(replace({out}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    in_line = WS.replace(r"\t-\r", r"\t\x{0b}\x{0c}\r")
    out = f"regexp_replace(regexp_replace({out}, '{in_line}+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
    out = f"regexp_replace({out}, '\\n{{2,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace(regexp_replace({out}, '^[ \\n]+', ''), '[ \\n]+$', '')"


def untagged_sql(c: str) -> str:
    return f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"


def formatted_sql(c: str) -> str:
    """html_to_formatted_text() of c."""
    out = f"replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    out = f"regexp_replace({out}, '<br(/| /)?>', chr(10), 'g')"
    out = f"regexp_replace({out}, '(?i)</?(p|div|section|article|li|h[1-6])\\b[^>]*>', chr(10), 'g')"
    return original_sql(untagged_sql(out))


def trim_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def cut_sql(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN {c}[1:{n}] || '...' ELSE {c} END"


def first_line_sql(c: str) -> str:
    lines = f"list_transform(string_split({c}, chr(10)), lambda x: {trim_sql('x')})"
    return f"(list_filter({lines}, lambda x: length(x) >= 4 AND NOT starts_with(x, 'http'))[1])"


def host_sql(c: str) -> str:
    return rf"lower(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


def platform_sql(c: str) -> str:
    host = rf"regexp_replace({host_sql(c)}, '^(www\.)+', '')"
    hit = lambda p: f"{host} = '{p[1:]}'" if p[0] == "=" else f"contains({host}, '{p}')"
    rules = " ".join(f"WHEN {' OR '.join(hit(p) for p in parts)} THEN '{name}'" for name, parts in lists.PLATFORMS)
    return f"CASE WHEN {host} = '' THEN '{lists.UNKNOWN_PLATFORM}' {rules} ELSE {host} END"


def _pick_sql(values: list[str]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[doc_id % {len(values)} + 1]"


ITEMS_SQL = f"""
raw AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars, 'https://' || {_pick_sql(HOSTS)} || '/item/' || doc_id AS url,
  TIMESTAMP '2023-11-14 22:13:20' + to_minutes(doc_id * 7919 % 100000) AS made FROM documents WHERE doc_id IS NOT NULL),
items AS MATERIALIZED (SELECT 'doc-' || doc_id AS id, url || '?from=share' AS source_url, url AS final_url, CASE WHEN doc_id % 3 > 0 THEN 'app' || (doc_id % 3) END AS source_app,
  {platform_sql('url')} AS platform, coalesce({cut_sql(first_line_sql('text'), 120)}, '{lists.PLACEHOLDER_TITLE}') AS title,
  {cut_sql('(' + clean_sql('text') + ')', 200)} AS description, CASE WHEN doc_id % 4 > 0 THEN source END AS author,
  CASE WHEN doc_id % 5 > 0 THEN 'https://img.example.org/' || doc_id || '.jpg' ELSE '/media/cover-1.jpg' END AS image_url,
  CASE WHEN doc_id % 2 > 0 THEN 'https://cdn.example.org/' || doc_id || '.jpg' END AS remote_image_url, CAST(NULL AS TIMESTAMP) AS cover_cached_at,
  CASE WHEN doc_id % 3 > 0 THEN made + to_hours(doc_id % 13) END AS cover_checked_at, {clean_sql('text')} AS content_text, text AS original_text,
  {cut_sql('(' + clean_sql('text') + ')', 160)} AS summary, {_pick_sql(CATEGORIES)} AS category,
  list_filter([lang, source, 'kw' || (doc_id % 37), CASE WHEN doc_id % 10 = 0 THEN '优惠券' END], lambda k: k IS NOT NULL) AS keywords,
  list_filter([source], lambda k: k IS NOT NULL) AS entities, 'neutral' AS sentiment, 'link' AS content_type, CAST(coalesce(n_chars, 0) % 101 AS SMALLINT) AS importance_score,
  CASE WHEN doc_id % 9 = 0 THEN 'seen  twice' ELSE '' END AS notes, (['active', 'active', 'archived', 'favorite'])[doc_id % 4 + 1] AS status, made AS created_at, made AS updated_at FROM raw)
"""
EVENTS_SQL = """
batch AS (SELECT 'ev-' || event_id AS id, 'https://example.org/u/' || user_id AS final_url, event_type AS title, event_type AS category, 1700000000 + event_id AS made, event_id AS seq, user_id FROM events),
store AS (SELECT 'old-' || user_id AS id, final_url, arg_min(title, seq) AS title, arg_min(category, seq) AS category, min(made) AS made FROM batch WHERE user_id % 2 = 0 GROUP BY user_id, final_url)
"""
