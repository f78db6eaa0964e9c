"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curio.llm.common import WORD, cut, cut_table, running

#: Hash sub-buckets of one size class. With the size classes they bound the table of prefix sums of a source, and
#: let a source with a third of all rows spread over many tasks.
SUB_BUCKETS = 512
#: Size classes for each doubling of the size.
CLASSES = 4


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row for each source with its target.

    sizes has source, source_size. Sources take the weights in code-point order, null last, the list repeating. They
    share `share` times the total by weight; no target exceeds `most` times its source's size, and what is cut there
    is shared again by weight among the rest until none is above. With caps reached in order of cap over weight this
    has a closed form: the sources below some rank are at their cap, the others get the same amount for each unit of
    weight. Ranks and sums are running sums over ranges of sources, so there may be as many sources as hosts.
    """
    # Fixed order: null sources come last.
    placed = running(sizes, [F.col("source").isNull(), F.col("source")], {"nth": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    capped = placed.withColumn("weight", w).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    summed = cut(running(capped, [F.col("ratio"), F.col("source").isNull(), F.col("source")], {"caps": F.col("cap"), "weights": F.col("weight")}))
    whole = summed.agg(F.sum("source_size").alias("_size"), F.sum("weight").alias("_weight"))  # one row
    level = (F.col("_size") * F.lit(share) - F.col("caps")) / (F.col("_weight") - F.col("weights"))
    levels = summed.join(F.broadcast(whole)).withColumn("level", level)
    # The level of the first source that is not at its cap (of equal ratios the first has the highest); without one, all are.
    first = levels.where("ratio >= level").agg((-F.min(F.struct("ratio", (-F.col("level")).alias("down")))["down"]).alias("_level"))
    at = F.coalesce(F.least("cap", F.col("_level") * F.col("weight")), F.col("cap"))
    return summed.join(F.broadcast(first)).select("source", "source_size", at.alias("target"))


def _copies(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: str) -> DataFrame:
    """rows (doc_id, source, size, th and what else they carry) with source_size, target and copies."""
    bits = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
    rows = (
        rows.withColumn("_h", bits(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        .withColumn("_class", F.floor(F.log2(F.col("size") + 1.0) * CLASSES).cast("int"))
        .withColumn("_sub", (F.col("_h") % SUB_BUCKETS).cast("int"))
    )
    cells = rows.groupBy("source", "_class", "_sub").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
    per_source = cells.groupBy("source").agg(F.sum("_words").cast("double").alias("source_size"))
    offset = bits(F.concat_ws(":", F.lit(seed), F.lit("source"), F.coalesce("source", F.lit("")))) / float(1 << 32)
    goals = targets(per_source, weights, share, most).select(F.col("source").alias("_source"), "source_size", "target", offset.alias("_offset"))
    upto = W.partitionBy("source").orderBy("_class", "_sub").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(upto), F.lit(0))
    starts = (
        cells.withColumn("_before", before)
        .join(goals, F.col("source").eqNullSafe(F.col("_source")))
        .select(F.col("source").alias("_source"), F.col("_class").alias("_c"), F.col("_sub").alias("_s"), "_before", "source_size", "target", "_offset")
    )
    inside = W.partitionBy("source", "_class", "_sub").orderBy("size", "_h", "doc_id", "th")
    ranked = rows.withColumn("_at", F.row_number().over(inside))
    placed = ranked.join(
        starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_c")) & (F.col("_sub") == F.col("_s"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = lambda n: F.floor(n * rate + F.col("_offset"))
    nth = F.col("_before") + F.col("_at")
    return placed.withColumn("copies", (crossed(nth) - crossed(nth - 1)).cast("int"))


def _sized(docs: DataFrame, *more) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return cut_table(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("th"), *more))  # words are counted once


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix-1"
) -> DataFrame:
    """doc_id, source, size, source_size, target (of the source) and copies of every row of docs.

    A document's expected copies are its source's target over the source's size. Within a source the documents are
    put in order of size class, then of a hash, and their expected copies are summed up; with one random offset for
    the source, a document is taken once for each integer that its part of the sum crosses. The order by size keeps
    the words taken near the target, not only the documents.

    The prefix sum is in two steps, so that no task holds a source: counts for each (source, size class, hash bucket)
    are summed by a window over those few buckets, and a second window ranks the rows inside one bucket.

    Null or empty texts have size 0 and may be taken or not; a null source is a source; a null doc_id sorts first;
    rows that repeat are rows of their own; other columns of docs, whatever their names, are not read. No rows in, no
    rows out. The result depends on the rows only, not on
    their placement, so reruns agree.
    """
    return _copies(_sized(docs), weights, share, most, seed).select("doc_id", "source", "size", "source_size", "target", "copies")


def sample(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix-1"
) -> DataFrame:
    """The mixed corpus: docs' own columns, each row as often as mix() takes it."""
    rows = _copies(_sized(docs, F.struct(*docs.columns).alias("_doc")), weights, share, most, seed).where("copies > 0")
    return rows.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_doc.*")
