"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams, against every window of every document.

DataFrame functions only. Words are runs of ASCII letters, digits and all characters beyond ASCII, in lower case (A-Z).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curio.llm.common import cut

#: A word once A-Z are in lower case, and one in a text as it stands.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of windows that one broadcast may hold. A benchmark with more is taken in blocks, each of them one broadcast.
BROADCAST_BYTES = 48 << 20


def words(text: Column) -> Column:
    """The words of a text; none of null. Only A-Z change their case, which lower() does by itself where all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _hash(at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get("w", at + j) for j in range(length)])


def benchmark_windows(benchmark: DataFrame, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """((h, window, cls), (cls, items)): the different windows of all items, h a hash and window the words; and for each
    class of windows that stand in the same items, their ids as sorted text (of a null id the empty text). An item with
    fewer words than width, but not none, is one window. Both are as large as the benchmark at most."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = items.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))).alias("at"))
    each = starts.select(F.slice("w", F.col("at") + 1, width).alias("window"), "item").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    each = cut(each.select(F.xxhash64("window").alias("h"), "window", "items"))
    classes = cut(each.select("items").distinct().withColumn("cls", F.monotonically_increasing_id()))
    return each.join(classes, "items").select("h", "window", "cls"), classes


def _name() -> list[Column]:
    """Two hashes of a document's id and text, which name it; rows that repeat are one."""
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit("text"), "text", "doc_id").alias("r2")]


def _whole(docs: DataFrame) -> DataFrame:
    """(r1, r2, _doc): rows with all their columns packed, so that these can have any name."""
    return docs.select(*_name(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def hits(docs: DataFrame, windows: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(r1, r2, a, z, cls): a window of the benchmark stands at the words a to z - 1 of a document.

    One pass over documents and no shuffle of them: words are exploded, each start's windows are hashed (one for each
    length that the benchmark has, mostly one) and looked up in the broadcast set; a find is compared word by word.
    Bytes of the set are counted first: beyond most_bytes the windows are dealt by their hash into blocks that fit, and
    there is a pass for each block.
    """
    sets = cut(windows)
    size = sets.agg(F.coalesce(F.sum(64 + F.octet_length(F.array_join("window", "")) + 24 * F.size("window")), F.lit(0)).alias("n"), F.sort_array(F.collect_set(F.size("window"))).alias("lengths")).first()
    lengths, blocks = list(size["lengths"]) or [1], max(1, -(-2 * size["n"] // most_bytes)) if size["n"] > most_bytes else 1
    # The outer form keeps the optimizer from testing, and so making, the words twice.
    starts = docs.select(*_name(), words(F.col("text")).alias("w")).select("r1", "r2", "w", F.posexplode_outer("w").alias("a", "_")).where("a is not null")
    fits = lambda n: F.col("a") + n <= F.size("w")
    if len(lengths) == 1:
        hashed = starts.where(fits(lengths[0])).select("r1", "r2", "w", "a", F.lit(lengths[0]).alias("n"), _hash(F.col("a"), lengths[0]).alias("h"))
    else:
        tried = F.array(*[F.struct(F.lit(n).alias("n"), F.when(fits(n), _hash(F.col("a"), n)).alias("h")) for n in lengths])
        hashed = starts.select("r1", "r2", "w", "a", F.explode(tried).alias("t")).select("r1", "r2", "w", "a", "t.n", "t.h").where("h is not null")

    def found(block: DataFrame) -> DataFrame:
        side = block.select(F.col("h").alias("_h"), "window", "cls")
        same = (F.col("h") == F.col("_h")) & (F.slice("w", F.col("a") + 1, F.col("n")) == F.col("window"))
        return hashed.join(F.broadcast(side), same).select("r1", "r2", "a", (F.col("a") + F.col("n")).alias("z"), "cls")  # at most most_bytes, counted

    return reduce(DataFrame.unionByName, [found(sets.where(F.pmod("h", F.lit(blocks)) == i) if blocks > 1 else sets) for i in range(blocks)])


def spans(found: DataFrame) -> DataFrame:
    """(r1, r2, spans, n_hit, sets) of the documents with hits: maximal runs of hit words as (a, z) in order, the number
    of hit words, and the classes of the windows. One shuffle of hits by document."""
    upto = W.partitionBy("r1", "r2").orderBy("a", "z")
    seen = F.max("z").over(upto.rowsBetween(W.unboundedPreceding, -1))
    marked = found.select("*", F.coalesce((F.col("a") > seen).cast("int"), F.lit(1)).alias("fresh"))
    runs = marked.select("*", F.sum("fresh").over(upto.rowsBetween(W.unboundedPreceding, 0)).alias("run"))
    each = runs.groupBy("r1", "r2", "run").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.collect_set("cls").alias("sets"))
    return each.groupBy("r1", "r2").agg(
        F.sort_array(F.collect_list(F.struct("a", "z"))).alias("spans"), F.sum(F.col("z") - F.col("a")).cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sets")))).alias("sets")
    )


def _listed(spanned: DataFrame, classes: DataFrame) -> DataFrame:
    """spanned with items, the sorted ids of the items whose windows it has. Documents with the same classes of windows,
    such as copies, are looked up once."""
    sets = spanned.select("sets").distinct()
    items = sets.select("sets", F.explode("sets").alias("cls")).join(classes, "cls").groupBy("sets").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return spanned.join(items, "sets").drop("sets")


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every document's doc_id with n_words, n_hit, n_items, items (the ids, sorted as text) and contaminated.

    A word is hit if it lies in an occurrence of a window of `width` consecutive words of an item. Null and empty texts
    have no words and are clean; rows that repeat get equal values; a document of any length is one row of words, and
    its windows are rows of 40 bytes. An empty benchmark hits nothing; no documents in, no rows out. Different items
    with one window are all listed. Other columns of docs are not read, so they can have any name.
    """
    windows, classes = benchmark_windows(benchmark, width)
    spanned = _listed(cut(spans(hits(docs, windows, most_bytes))), classes).select("r1", "r2", "n_hit", "items")
    every = docs.select("doc_id", *_name(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    joined = every.join(spanned, ["r1", "r2"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs, of the same columns, without the words that are hit; what stands after such a word goes with it, what stands
    between kept words stays. A text without a hit, and a null one, stays as it is; n_chars, if there, is counted anew
    where a text changed."""
    windows, _ = benchmark_windows(benchmark, width)
    spanned = spans(hits(docs, windows, most_bytes)).select("r1", "r2", "spans")
    text = F.coalesce(F.col("_doc.text"), F.lit(""))
    joined = _whole(docs).join(spanned, ["r1", "r2"], "left")
    cutup = joined.select("_doc", "spans", F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)).alias("w"), F.split(text, RAW_WORD, -1).alias("between"))

    def stay(i: Column) -> Column:
        """The words between two spans, before the first or after the last."""
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["z"])
        end = F.coalesce(F.get("spans", i)["a"], F.size("w"))
        return F.when(begin < end, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<int>"))

    stays = F.flatten(F.transform(F.sequence(F.lit(0), F.size("spans")), stay))
    kept = F.concat(F.get("between", F.lit(0)), F.array_join(F.transform(stays, lambda i: F.concat(F.get("w", i), F.get("between", i + 1))), ""))
    hit = F.col("spans").isNotNull()
    done = cutup.select("_doc", hit.alias("_hit"), F.when(hit, kept).otherwise(F.col("_doc.text")).alias("_text"))
    value = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.when(F.col("_hit"), F.char_length("_text").cast("long")).otherwise(F.col("_doc.n_chars"))
    return done.select(*[value.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, most_hit: float = 0.0, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without those of whose words more than the share most_hit is hit."""
    windows, _ = benchmark_windows(benchmark, width)
    hit = spans(hits(docs, windows, most_bytes)).select("r1", "r2", "n_hit")
    n = docs.select(*_name(), F.size(words(F.col("text"))).alias("n")).distinct().join(hit, ["r1", "r2"])
    bad = n.where(F.col("n_hit") > most_hit * F.col("n")).select("r1", "r2")
    return _whole(docs).join(bad, ["r1", "r2"], "left_anti").select("_doc.*")
