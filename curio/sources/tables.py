"""Sources and sinks. Every reader takes a path and gives a table with a fixed schema; bad input fails, it isn't dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.functions.text import once
from curio.plans.scratch import cut, running
from curio.sources import schemas as S

#: What Spark reads of timestamps as RFC 3339 writes them.
JSON = {"mode": "FAILFAST", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX"}
WRITTEN = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _settled(items: DataFrame) -> DataFrame:
    return items.withColumn("original_text", F.coalesce("original_text", F.lit("")))


def _complete(items: DataFrame) -> DataFrame:
    """Fails on an item without a required field."""
    missing = F.lit(False)
    for c in S.REQUIRED:
        missing = missing | F.col(c).isNull()
    return items.withColumn("id", F.when(missing, F.raise_error(F.lit("item without a required field"))).otherwise(F.col("id")))


def read_items_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON array of items, or JSON lines (multi_line=False, which Spark can split). A missing path is an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], S.ITEM_SCHEMA)
    return _settled(_complete(spark.read.schema(S.ITEM_SCHEMA).options(**JSON).option("multiLine", multi_line).json(path)))


def write_items_json(items: DataFrame, path: str) -> None:
    """JSON lines in store order, over as many files as Spark likes; their names keep the order."""
    ordered = items.select(*S.ITEM_COLUMNS).orderBy(F.desc("created_at"), "title", "id")
    ordered.write.mode("overwrite").options(**WRITTEN).json(path)


def pack_items(items: DataFrame) -> DataFrame:
    """Stored rows: the item as JSON, and the columns that stores look up."""
    whole = F.to_json(F.struct(*S.ITEM_COLUMNS), WRITTEN)
    return items.select("id", "final_url", whole.alias("item"), "status", "created_at", "updated_at")


def unpack_items(stored: DataFrame) -> DataFrame:
    """Items of stored rows; a row whose JSON is no item fails."""
    return _settled(_complete(stored.select(F.from_json("item", S.ITEM_SCHEMA, JSON).alias("i")).select("i.*")))


def read_items_jdbc(spark: SparkSession, url: str, table: str = "public.items", parts: int = 16, bounds: tuple[str, str] | None = None, item: str = "item::text", **options) -> DataFrame:
    """Items of a database's table of stored rows, split by created_at where bounds are given. item is how the database
    gives the item as text, by default Postgres's way. Needs the driver's jar."""
    quoted = lambda c: c if item == "item::text" else f'"{c}"'
    columns = ", ".join([f"{item} as {quoted('item')}", *map(quoted, ("id", "final_url", "status", "created_at", "updated_at"))])
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"(select {columns} from {table}) t", **options)
    if bounds:
        reader = reader.options(partitionColumn="created_at", lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return unpack_items(reader.load())


def write_items_jdbc(items: DataFrame, url: str, staging: str = "public.items_staging", **options) -> None:
    """Stored rows into a staging table, from which one SQL statement merges."""
    pack_items(items).write.format("jdbc").options(url=url, dbtable=staging, **options).mode("overwrite").save()


def read_backup_json(spark: SparkSession, path: str) -> DataFrame:
    """A backup envelope's items with schema_version and seq, their place in it."""
    schema = f"schema_version smallint, items array<{S.ITEM_SCHEMA.simpleString()}>"
    envelope = spark.read.schema(schema).options(**JSON).option("multiLine", True).json(path)
    rows = envelope.select("schema_version", F.posexplode_outer("items").alias("seq", "i"))
    return _settled(rows.where("i is not null").select("schema_version", "seq", "i.*"))


def _count(text: Column, *marks: str) -> Column:
    return sum((F.char_length(text) - F.char_length(F.replace(text, F.lit(m), F.lit(""))) for m in marks), F.lit(0))


def json_elements(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(file, seq, element, version): the objects of the JSON array in each file, as text, read by all cores.

    The file is cut after every closing brace, wherever it stands, so any task can read any part of it. Prefix sums over
    the cuts say first which begin inside a string (quotes before it), then how deep each is (brackets outside of
    strings), then which element it belongs to (braces that close one): no task sees more than its cuts. The sums move
    numbers only; the texts are written once, and moved only where the cuts of one element meet. With key the array is that entry of a top-level object, the only one there that holds objects;
    version is the object's schema_version.
    """
    cuts = spark.read.option("lineSep", "}").text(path)
    cuts = cut(cuts.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias("at"), F.col("value").alias("text")))
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    opened = lambda text: once(F.regexp_replace(text, '"[^"]*("|$)', ""), lambda x: _count(x, "{", "[") - _count(x, "]"))
    marks = cuts.select("file", "at", once(bare, lambda x: F.struct(_count(x, '"').alias("quotes"), opened(x).alias("outside"), opened(F.concat(F.lit('"'), x)).alias("inside"))).alias("m"))
    marks = running(marks.select("file", "at", "m.*"), "file", "at", F.col("quotes"), "before")
    still = (F.col("before") + F.col("quotes")) % 2 == 1
    net = F.when(F.col("before") % 2 == 1, F.col("inside")).otherwise(F.col("outside")) - F.when(still, 0).otherwise(1)
    marks = running(marks.select("file", "at", net.alias("net"), still.alias("still")), "file", "at", F.col("net"), "depth")
    closes = ~F.col("still") & (F.col("depth") + F.col("net") == (1 if key is None else 2))
    marks = cut(running(marks.select("file", "at", closes.alias("closes")), "file", "at", F.col("closes").cast("int"), "seq"))
    # An element that is one cut is there already; the others, and what stands around the array, are put together.
    sizes = marks.groupBy("file", "seq").agg(((F.count(F.lit(1)) == 1) & F.max("closes") & (F.col("seq") > 0)).alias("alone"))
    placed = cuts.drop("file").join(cut(marks.join(sizes, ["file", "seq"])), "at")
    several = placed.where("not alone").groupBy("file", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda c: c["text"]), "}").alias("text"), F.max("closes").alias("whole"))
    each = cut(several)
    head = r"^[\s,\[]+" if key is None else rf'(?s)^\s*\{{.*?"{key}"\s*:\s*\[\s*'
    element = F.when(F.col("seq") == 0, F.regexp_replace("text", head, "")).otherwise(F.regexp_replace("text", r"^[\s,]+", ""))
    found = each.where("whole").select("file", "seq", "text").unionByName(placed.where("alone").select("file", "seq", "text"))
    found = found.select("file", "seq", F.concat(element, F.lit("}")).alias("element"))
    around = F.when(F.col("whole"), F.regexp_extract("text", head, 0)).otherwise(F.col("text"))
    versions = each.where("seq = 0 or not whole").select("file", F.nullif(F.regexp_extract(around, r'"schema_version"\s*:\s*([0-9]+)', 1), F.lit("")).cast("smallint").alias("v"))
    return found.join(versions.groupBy("file").agg(F.max("v").alias("version")), "file", "left")


def read_items_array(spark: SparkSession, path: str) -> DataFrame:
    """The items of a JSON array, as read_items_json() gives them, with seq: a large file is read in parts."""
    rows = json_elements(spark, path).select("seq", F.from_json("element", S.ITEM_SCHEMA, JSON).alias("i"))
    return _settled(_complete(rows.select("seq", "i.*")))


def read_backup_parts(spark: SparkSession, path: str) -> DataFrame:
    """As read_backup_json(): a large backup is read in parts, and no row holds more than one item."""
    rows = json_elements(spark, path, "items").select(F.col("version").alias("schema_version"), F.col("seq").cast("int").alias("seq"), F.from_json("element", S.ITEM_SCHEMA, JSON).alias("i"))
    return _settled(rows.select("schema_version", "seq", "i.*"))


def read_shares(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SHARE_SCHEMA).option("mode", "FAILFAST").json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PAGE_SCHEMA).parquet(path)


def landed(pages: DataFrame) -> DataFrame:
    """page_id, url, html as landed fetches that all went well."""
    return pages.select(F.col("url").alias("source_url"), F.col("url").alias("final_url"), F.lit(200).alias("http_status"), F.col("html").alias("body"), F.lit(None).cast("string").alias("error"))


def read_rendered(spark: SparkSession, path: str) -> DataFrame:
    """Pages that a browser rendered, without the failed ones."""
    return spark.read.schema(S.RENDERED_SCHEMA).option("mode", "FAILFAST").json(path).where("ok")


def read_api_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PAYLOAD_SCHEMA).option("mode", "FAILFAST").json(path)


def read_model_replies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.REPLY_SCHEMA).option("mode", "FAILFAST").json(path)
