"""Quality rules with thresholds that adapt to each language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curio.llm.common import column, cut, cut_table, slices, utf8

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"  # fixed values: the characters that count as symbols
UPPER = bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper"]


def _repeated(ids: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Of which words (of documents one after another) a window of `width` words occurs twice in its document."""
    n = len(ids) - width + 1
    if n < 1:
        return np.zeros(len(ids), bool)
    rank, span = ids, 1
    while span < width:  # ranks of windows twice as wide, the last step overlapping; equal ranks are equal windows
        step = min(span, width - span)
        pairs = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank, span = np.unique(pairs, return_inverse=True)[1].astype(np.int64), span + step
    inside = owner[:n] == owner[width - 1 :]
    key = rank * (int(owner[-1]) + 1) + owner[:n]
    _, which, often = np.unique(key[inside], return_inverse=True, return_counts=True)
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(inside)[often[which] > 1]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges[:-1]) > 0


def _measure(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = utf8(batch)
        seen: dict[bytes, int] = {}
        ids: list[int] = []
        n_words, dup = [], []
        for text in texts:
            words = text.split()
            n_words.append(len(words))
            ids += [seen.setdefault(w, len(seen)) for w in words]
            lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
            dup.append(len(lines) - len(set(lines)))
        owner = np.repeat(np.arange(len(texts)), n_words)
        repeat = np.bincount(owner[_repeated(np.array(ids, np.int64), owner, width)], minlength=len(texts)) if ids else np.zeros(len(texts))
        chars = [len(t.translate(None, SPACE).decode("utf-8", "replace")) for t in texts]
        symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
        upper = [len(t) - len(t.translate(None, UPPER)) for t in texts]
        values = [n_words, chars, symbols, dup, repeat.astype(np.int64), upper]
        own = [column(batch, c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*own, *[pa.array(v, pa.int64()) for v in values]], names=[*[c for c in batch.schema.names if c != "text"], *COUNTS])


def counts(docs: DataFrame, width: int = 8) -> DataFrame:
    """doc_id, lang, source and the counts of every text; with _doc, if docs has it, but without text."""
    rest = [c for c in ("doc_id", "lang", "source", "_doc") if c in docs.columns]
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], *[f"{c} bigint" for c in COUNTS]])
    return docs.select(*rest, "text").mapInArrow(lambda batches: _measure(batches, width), schema)


#: The measures that adapt: name, count, what it is a share of, parts in the whole (the bin of a sketch is one part),
#: and the least spread, in parts, that counts as the distance of the quartiles.
MEASURES = [
    ("symbols", "n_symbols", "word_chars", 1000, 10),
    ("repeats", "n_repeat_words", "n_words", 1000, 60),
    ("dup_lines", "n_dup_lines", "n_words", 1000, 20),
    ("upper", "n_upper", "word_chars", 1000, 60),
    ("word_length", "word_chars", "n_words", 100, 150),
]


def _parts(over: str, under: str, factor: int):
    return F.when(F.col(under) > 0, F.floor(F.col(over) * factor / F.col(under))).otherwise(F.lit(0)).cast("long")


#: Leading binary digits of a value that a sketch keeps.
DIGITS = 10


def _bin(value: Column) -> Column:
    """The least value with the same leading digits, of a value that is not negative."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))).cast("long")
    return value - value % step


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): mergeable quantile sketches of the rows that pass the base rules.

    A bin holds the values that agree in their DIGITS leading binary digits and is named by the least of them, so two
    sketches are merged by adding counts in any order. A quantile is at most 1 part in 2^(DIGITS - 1) below the exact
    one, and is exact below 2^DIGITS. A sketch has at most 2^DIGITS + (63 - DIGITS) * 2^(DIGITS - 1) bins, whatever the
    rows: 28,160, of which texts of words that one can read use some hundred.
    """
    bins = F.array(*[F.struct(F.lit(i).alias("measure"), _bin(_parts(over, under, factor)).alias("bin")) for i, (_, over, under, factor, _) in enumerate(MEASURES)])
    return (
        measured.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(bins).alias("b"))
        .groupBy("lang", "source", F.col("b.measure").alias("measure"), F.col("b.bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _fences(sketch: DataFrame, keys: list[str], reach: float, name: str) -> DataFrame:
    """keys, rows in the sketch, and an array of the upper fence of each measure, from merged sketches."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    upto = W.partitionBy(*keys, "measure").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(W.partitionBy(*keys, "measure")))
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bin")))
    quartiles = ranked.groupBy(*keys, "measure").agg(at(25).alias("low"), at(75).alias("high"), F.max("total").alias("total"))
    least = F.element_at(F.array(*[F.lit(spread) for *_, spread in MEASURES]), F.col("measure") + 1)
    fence = F.col("high") + reach * F.greatest(F.col("high") - F.col("low"), least)
    return quartiles.groupBy(*keys).agg(
        F.max("total").alias(f"{name}_rows"), F.array_sort(F.collect_list(F.struct("measure", fence.alias("fence")))).alias(name)
    )


def judge(docs: DataFrame, width: int = 8, least_words: int = 20, most_repeated: int = 30, reach: float = 3.0, prior: int = 10) -> DataFrame:
    """doc_id, lang, source (and _doc) with the counts, base_failed and kept of every row of docs.

    base_failed: fewer than least_words words, or over most_repeated per cent of the words in repeated windows.
    kept: not base_failed, and no measure over its fence. The fence of a language's source is the upper quartile plus
    `reach` times the distance of the quartiles, among its rows that pass the base rules. A small group's fence leans on
    its language's, and that on the fence of all rows: each as if `prior` rows of the wider group stood beside its own.

    Texts are measured once, into a table. The thresholds, a table of the sketches' size, are written, too, so that their
    size is known when they are joined back: Spark broadcasts them if that is below its own threshold, else it sorts.
    Null or empty texts have no words and fail; null lang or source are values of their own; rows that repeat are
    judged one by one; other columns of docs, whatever their names, are not read; no rows in, no rows out.
    """
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    measured = cut_table(counts(docs, width).withColumn("base_failed", base))
    sketch = cut(sketches(measured))
    narrow = _fences(sketch, ["lang", "source"], reach, "own")
    wide = _fences(sketch, ["lang"], reach, "lang_wide")
    every = _fences(sketch, [], reach, "all")
    lean = lambda own, n, other: F.zip_with(own, other, lambda x, y: F.struct(x["measure"].alias("measure"), ((n * x["fence"] + prior * y["fence"]) / (n + prior)).alias("fence")))
    wider = wide.join(F.broadcast(every)).select(F.col("lang").alias("_l"), lean("lang_wide", F.col("lang_wide_rows"), F.col("all")).alias("_wider"))  # every: one row
    chosen = narrow.join(wider, F.col("lang").eqNullSafe(F.col("_l")))
    chosen = cut_table(chosen.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), lean("own", F.col("own_rows"), F.col("_wider")).alias("_fences")))
    over = F.lit(False)
    for i, (_, count, under, factor, _) in enumerate(MEASURES):
        over = over | (_parts(count, under, factor) > F.col("_fences")[i]["fence"])
    joined = measured.join(chosen, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False))).drop("_lang", "_source", "_fences")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' own columns.

    What goes is named by two hashes of all that a verdict depends on (and of doc_id, so that copies don't meet), and
    those names are joined back to docs: no copy of the documents is written.
    """
    seen = ["doc_id", "text", "lang", "source"]
    names = [F.xxhash64(F.lit(k), *seen, *[F.col(c).isNull() for c in seen]).alias(f"_h{k}") for k in range(2)]
    gone = cut_table(judge(docs.select(*seen, F.struct(*names).alias("_doc")), **options).where(~F.col("kept")).select("_doc.*"))
    return docs.select(*names, F.struct(*docs.columns).alias("_doc")).join(gone, ["_h0", "_h1"], "left_anti").select("_doc.*")
