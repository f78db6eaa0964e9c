"""Substring dedup by super-k-mer partitioning: repeated windows of words, the first one stays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.llm.common import column, keyed, slices, utf8
from curio.llm.windows import FIRST, SETTLED, Kind, by_bucket, gathered, levels, order_of, ranges


def _units(text: bytes) -> tuple[list[bytes], np.ndarray]:
    words = text.split()
    return words, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _join(words: list[bytes], begin: int, end: int) -> bytes:
    return b" ".join(words[begin:end])


def same_windows(words: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, number) of every window in the strings; equal windows have equal numbers.

    Windows are numbered by sorting: ranks of words, of pairs of ranks, and so on up to the width."""
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for s in words for w in s], np.int64)
    lengths = np.array([len(s) for s in words], np.int64)
    rank, span = ids, 1
    while span < width:
        step = min(span, width - span)
        _, rank = np.unique(rank[: len(rank) - step] * (len(ids) + 1) + rank[step:], return_inverse=True)
        span += step
    many = np.maximum(lengths - width + 1, 0)
    owner = np.repeat(np.arange(len(words)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    return owner, place, rank[np.repeat(np.cumsum(lengths) - lengths, many) + place]


def _look(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """Of the first occurrence of each string, the windows that start earlier elsewhere: doc_id, rk, a, b (word places)."""
    owner, place, number = same_windows([s.split(b" ") for s in utf8(batch, "s")], width)
    ids = order_of(column(batch, "doc_id"))
    rk, start = column(batch, "rk").to_numpy(), column(batch, "start").to_numpy().astype(np.int64)
    at = start[owner] + place
    order = np.lexsort((at, rk[owner], ids[owner], number))
    # Each window against the first of its number; rows that repeat are the same place.
    new = np.concatenate([[True], number[order[1:]] != number[order[:-1]]]) if len(order) else np.zeros(0, bool)
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.zeros(len(owner), bool)
    later[order] = (rk[owner[order]] != rk[owner[first]]) | (at[order] != at[first])
    firsts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    out = [(i, start[i] + a, start[i] + b + width - 1) for i in range(batch.num_rows) for a, b in ranges(later[firsts[i] : firsts[i + 1]])]
    which, a, b = zip(*out, strict=True) if out else ((), (), ())
    whose = pa.array(which, pa.int64())
    yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(whose), column(batch, "rk").take(whose), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "rk", "a", "b"])


def repeats(docs: DataFrame, width: int = 20, grams: tuple[int, ...] = (8, 14, 18)) -> DataFrame:
    """doc_id, rk and a, b: the words of a document, [a, b), that windows cover which also start earlier.

    Of pieces that are equal as a whole only the first goes to the bucket, where sorting numbers its windows; the
    others are covered whole. Spans may overlap.
    """
    found, windows = levels(docs, Kind(_units, _join, width, grams))
    kind = dict(docs.dtypes)["doc_id"]
    span = lambda n: (F.col("start").cast("long").alias("a"), (F.col("start") + n + (width - 1)).cast("long").alias("b"))
    spans = None
    for places, strings in found:
        some = by_bucket(strings, lambda b: _look(b, width), f"doc_id {kind}, rk bigint, a bigint, b bigint")
        later = places.where(F.col("kind").bitwiseAND(F.lit(FIRST).cast("tinyint")) == 0).select("doc_id", "rk", *span(F.col("n")))
        spans = some.union(later) if spans is None else spans.union(some).union(later)
    if windows is not None:
        settled = F.col("flags").bitwiseAND(F.lit(SETTLED).cast("tinyint")) > 0  # what an earlier one in the same task settles
        open_ = windows.where(~settled)
        first = open_.groupBy("h", "i").agg(F.min(F.struct("doc_id", "rk", "start")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
        again = open_.join(first, ["h", "i"]).where("rk <> f.rk or start <> f.start or not doc_id <=> f.doc_id")
        spans = spans.union(again.select("doc_id", "rk", *span(1))).union(windows.where(settled).select("doc_id", "rk", *span(F.col("n"))))
    return spans


def covered(spans: list | None, n: int) -> np.ndarray:
    """Which of n places the spans cover."""
    edges = np.zeros(n + 1, np.int64)
    if spans:
        at = np.array([(x["a"], x["b"]) for x in spans], np.int64)
        np.add.at(edges, at[:, 0], 1)
        np.add.at(edges, np.minimum(at[:, 1], n), -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, width: int = 20, grams: tuple[int, ...] = (8, 14, 18)) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (binary: kept words joined by one space) and kept_sha256 of every row.

    A word goes if a window that covers it starts earlier, too: in a document of smaller doc_id (null counts as
    smaller than any; equal ids are ordered by a hash of their texts), or earlier in its own. Rows that repeat, id and
    text, are one document, and all keep what it keeps. Null texts are empty; texts shorter than a window lose
    nothing; other columns of docs, whatever their names, are not read; no rows in, no rows out.
    """
    rows = gathered(repeats(docs, width, grams), keyed(docs).select("doc_id", "rk", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, gone, kept = [], [], []
            for text, spans in zip(utf8(batch), column(batch, "spans").to_pylist(), strict=True):
                words = text.split()
                out = covered(spans, len(words))
                n.append(len(words))
                gone.append(int(out.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~out)] if gone[-1] else words))
            digests = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), digests], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return rows.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text binary, kept_sha256 string")
