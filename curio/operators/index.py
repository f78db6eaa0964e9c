"""An index to search: postings of three-character grams, candidates by intersection, the literal rule on candidates.

    texts/bucket=<b>/   (doc, id, text): an item's fields put together, as search_items() sees them
    grams/bucket=<g>/   (gram, doc), sorted: which items have a gram
    counts/             (gram, n), sorted: in how many
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.operators.query import haystack
from curio.plans.scratch import cut, numbered

WIDTH = 3
#: Of a needle's grams as many of the rarest are intersected; what they let through is decided by the text itself.
RAREST = 4
#: A lookahead finds every gram, also those that overlap, in one pass over the text.
GRAM = "(?s)(?=(" + "." * WIDTH + "))"


def grams(text: Column | str) -> Column:
    """The different runs of three characters of a text; none of a shorter one."""
    return F.array_distinct(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(GRAM), F.lit(1)))


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    per_bucket: int
    gram_buckets: int

    @staticmethod
    def build(items: DataFrame, path: str, per_bucket: int = 1000, gram_buckets: int = 64) -> SearchIndex:
        """Writes the index of items. A bucket of texts holds about per_bucket items, so that few candidates read few
        texts; postings are counted and sorted where their gram is dealt to, and a gram that most items have is
        spread over many files by document."""
        spark = items.sparkSession
        texts = cut(numbered(items.select("id", haystack().alias("text")), ["id"], "doc"))
        total = texts.count()
        wide = max(1, -(-total // per_bucket))
        placed = texts.withColumn("bucket", F.floor((F.col("doc") - 1) / per_bucket).cast("int"))
        placed.repartitionByRange(min(wide, 4096), "bucket").sortWithinPartitions("bucket", "doc").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/texts")
        postings = texts.select("doc", F.explode(grams("text")).alias("gram")).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(gram_buckets)).cast("int"))
        # By range of (bucket, gram, doc): no task holds a whole frequent gram.
        postings.repartitionByRange("bucket", "gram", "doc").sortWithinPartitions("bucket", "gram", "doc").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
        written = spark.read.schema("gram string, doc long, bucket int").parquet(f"{path}/grams")
        written.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy("gram").write.mode("overwrite").parquet(f"{path}/counts")
        spark.range(1).select(F.lit(per_bucket).alias("per_bucket"), F.lit(gram_buckets).alias("gram_buckets")).write.mode("overwrite").parquet(f"{path}/layout")
        return SearchIndex(spark, path, per_bucket, gram_buckets)

    @staticmethod
    def open(spark: SparkSession, path: str) -> SearchIndex:
        row = spark.read.schema("per_bucket int, gram_buckets int").parquet(f"{path}/layout").first()
        return SearchIndex(spark, path, row["per_bucket"], row["gram_buckets"])

    def candidates(self, needle: str) -> DataFrame | None:
        """(doc) of the items that have the needle's rarest grams; None if the needle is shorter than a gram."""
        wanted = sorted({needle[i : i + WIDTH] for i in range(len(needle) - WIDTH + 1)})
        if not wanted:
            return None
        none = self.spark.createDataFrame([], "doc long")
        counts = self.spark.read.schema("gram string, n long").parquet(f"{self.path}/counts")
        known = {r["gram"]: r["n"] for r in counts.where(F.col("gram").isin(wanted)).collect()}  # as many as the needle is long
        if len(known) < len(wanted):
            return none
        rarest = sorted(wanted, key=lambda g: (known[g], g))[:RAREST]
        rows = self.spark.read.schema("gram string, doc long, bucket int").parquet(f"{self.path}/grams")
        buckets = [r["b"] for r in self.spark.createDataFrame([(g,) for g in rarest], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(self.gram_buckets)).cast("int").alias("b")).distinct().collect()]
        found = rows.where(F.col("bucket").isin(buckets) & F.col("gram").isin(rarest))
        return found.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select("doc")

    def texts_for(self, candidates: DataFrame) -> DataFrame:
        """The texts of candidates: only the folders they lie in are read."""
        placed = cut(candidates.withColumn("bucket", F.floor((F.col("doc") - 1) / self.per_bucket).cast("int")))
        hit = [r["bucket"] for r in placed.select("bucket").distinct().collect()]  # buckets, of a thousand items each
        if not hit:
            return self.spark.createDataFrame([], "id string, text string")
        root = f"{self.path}/texts"
        rows = self.spark.read.schema("id string, text string, doc long, bucket int").option("basePath", root).parquet(*[f"{root}/bucket={b}" for b in hit])
        return rows.join(placed.select("doc"), "doc", "left_semi").select("id", "text")

    def search(self, query: str | None) -> DataFrame:
        """(id) of the items that search_items() finds. A needle of under three characters looks at all texts."""
        needle = (query or "").strip().lower()
        texts = self.spark.read.schema("id string, text string").parquet(f"{self.path}/texts")
        if not needle:
            return texts.select("id")
        found = self.candidates(needle)
        return (texts if found is None else self.texts_for(found)).where(F.col("text").contains(needle)).select("id")
