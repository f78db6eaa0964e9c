"""Suffix-array dedup by a run-length index: long repeated byte strings are removed wherever they stand."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.llm.common import column, keyed, slices, utf8
from curio.llm.superkmer import covered
from curio.llm.windows import AGAIN, Kind, by_bucket, gathered, levels, mix, ranges

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _units(text: bytes) -> tuple[bytes, np.ndarray]:
    return text, _BYTE[np.frombuffer(text, np.uint8)]


def _join(text: bytes, begin: int, end: int) -> bytes:
    return text[begin:end]


def _sevens(symbols: np.ndarray) -> np.ndarray:
    """Seven symbols of nine bits from each place on, as one number; 0 past the end."""
    longer = np.concatenate([symbols, np.zeros(7, np.int64)])
    key = np.zeros(len(symbols), np.int64)
    for j in range(7):
        key = (key << 9) | longer[j : j + len(symbols)]
    return key


def suffix_array(symbols: np.ndarray, sevens: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order. Only suffixes that are still tied are sorted again, by ranks further on."""
    n = len(symbols)
    order = np.argsort(sevens, kind="stable")
    new = np.concatenate([[True], sevens[order[1:]] != sevens[order[:-1]]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~(new & np.append(new[1:], True))
    ahead = 7
    slots = np.flatnonzero(tied)
    while len(slots):
        some = order[slots]
        if ahead > n:  # equal up to the text's end: the shorter one first
            order[slots] = some[np.argsort((rank[some] << 32) | (n - some), kind="stable")]
            break
        key = (rank[some] << 32) | (rank[np.minimum(some + ahead, n)] + 1)
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[slots] = some
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[some] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        ahead *= 2
    return order


class RunIndex:
    """Strings, each as often as it occurs, as a run-compressed Burrows-Wheeler transform with samples at run ends.

    A run is a stretch of equal symbols of the transform (the symbol before a string's start makes a run of its own).
    Equal strings stand side by side in every row of the transform, so a string that occurs k times makes the runs of
    one, k times as long: it is put in once, with its number. Of each run are kept: its symbol and length; the places
    in the text of its first and last row; how far the suffix of the first row agrees with the row above, and that of
    the last row with the row below (a row that counts more than once agrees with itself, to its string's end).

    Inside a run these lengths follow: from one place of the text to the next they fall by one. So they are the
    matching statistics of every place against all other places, and matching() streams them string by string from the
    samples, without any row inside a run. Nothing that is kept is longer than the number of runs or of strings.
    """

    def __init__(self, strings: list[bytes], times: np.ndarray | None = None):
        self.lengths = np.array([len(s) for s in strings], np.int64)
        times = np.ones(len(strings), np.int64) if times is None else times
        symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        self.begins = np.cumsum(self.lengths + 1) - self.lengths - 1
        symbols[self.begins + self.lengths] = 0
        sevens = _sevens(symbols)
        order = suffix_array(symbols, sevens)
        before = symbols[order - 1]  # the transform; place 0 sees the last separator
        owner = np.repeat(np.arange(len(strings)), self.lengths + 1)
        breaks = (before[1:] != before[:-1]) | (before[1:] == 0) | (before[:-1] == 0)
        heads = np.concatenate([[0], np.flatnonzero(breaks) + 1])
        tails = np.append(heads[1:] - 1, len(order) - 1)
        self.symbol, self.length = before[heads], np.add.reduceat(times[owner[order]], heads)
        self.head_at, self.tail_at = order[heads], order[tails]
        self.head_up, self.tail_down = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        left = self.begins[owner] + self.lengths[owner] - np.arange(len(symbols))  # symbols up to the string's end
        agree = self._agree(order[heads[1:] - 1], order[heads[1:]], left, sevens)
        self.head_up[1:] = agree
        self.tail_down[:-1] = agree
        self.many = times > 1

    @property
    def runs(self) -> int:
        return len(self.symbol)

    @staticmethod
    def _agree(a: np.ndarray, b: np.ndarray, left: np.ndarray, sevens: np.ndarray) -> np.ndarray:
        """Common length of the suffixes at a and b, inside their strings."""
        out = np.minimum(left[a], left[b])
        going, at = np.flatnonzero(out > 0), 0
        while len(going):
            differ = sevens[a[going] + at] ^ sevens[b[going] + at]
            stop = differ != 0
            same = (62 - np.floor(np.log2(differ[stop].astype(np.float64))).astype(np.int64)) // 9
            out[going[stop]] = np.minimum(out[going[stop]], at + same)
            at += 7
            going = going[~stop]
            going = going[out[going] > at]
        return out

    def matching(self) -> Iterator[np.ndarray]:
        """For each string in turn and every place in it, the length of the longest string from there on that starts
        elsewhere, too."""
        sides = []
        for at, value in ((self.head_at, self.head_up), (self.tail_at, self.tail_down)):
            order = np.argsort(at, kind="stable")
            sides.append((at[order], value[order]))
        for begin, n, many in zip(self.begins.tolist(), self.lengths.tolist(), self.many.tolist(), strict=True):
            out = np.arange(n, 0, -1) if many else np.zeros(n, np.int64)
            for at, value in sides if n and not many else ():
                low, high = np.searchsorted(at, [begin, begin + n])  # the string's start is always a run's end
                streamed = np.repeat(value[low:high] + at[low:high], np.diff(np.append(at[low:high], begin + n))) - np.arange(begin, begin + n)
                out = np.maximum(out, streamed)
            yield out

    def text(self) -> list[bytes]:
        """The different strings, walked back from their ends by the last-to-first mapping over runs alone."""
        starts = np.cumsum(self.length) - self.length
        by_symbol = np.argsort(self.symbol, kind="stable")
        to = np.zeros(self.runs, np.int64)
        to[by_symbol] = np.cumsum(self.length[by_symbol]) - self.length[by_symbol]
        out = set()
        for row in range(int(self.length[self.symbol == 0].sum())):  # the rows of the separators
            found = bytearray()
            while True:
                run = int(np.searchsorted(starts, row, "right")) - 1
                if self.symbol[run] == 0:
                    break
                found.append(int(self.symbol[run]) - 1)
                row = int(to[run] + row - starts[run])
            out.add(bytes(found[::-1]))
        return sorted(out)


def _look(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """doc_id, rk, a, b: the bytes [a, b) of each document that the windows of its strings cover which occur again."""
    start, times = column(batch, "start").to_numpy(), np.where(column(batch, "again").to_numpy(zero_copy_only=False), 2, 1)
    index = RunIndex(utf8(batch, "s"), times)
    out = [(i, start[i] + a, start[i] + b + width - 1) for i, found in enumerate(index.matching()) for a, b in ranges(found >= width)]
    which, a, b = zip(*out, strict=True) if out else ((), (), ())
    at = pa.array(which, pa.int64())
    yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(at), column(batch, "rk").take(at), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "rk", "a", "b"])


def repeats(docs: DataFrame, width: int = 200, grams: tuple[int, ...] = (64, 132, 180)) -> DataFrame:
    """doc_id, rk and a, b: the bytes [a, b) of a document that strings of `width` bytes cover which start elsewhere, too.

    The index is built for each chunk of buckets, over their different strings with their numbers. What it says of a
    string that occurs more than once, that all of it matches, holds for each of its places. Spans may overlap.
    """
    found, windows = levels(docs, Kind(_units, _join, width, grams))
    kind = dict(docs.dtypes)["doc_id"]
    spans = None
    for places, strings in found:
        some = by_bucket(strings, lambda b: _look(b, width), f"doc_id {kind}, rk bigint, a bigint, b bigint")
        equal = places.where(F.col("kind").bitwiseAND(F.lit(AGAIN).cast("tinyint")) > 0)
        equal = equal.select("doc_id", "rk", F.col("start").cast("long").alias("a"), (F.col("start") + F.col("n") + (width - 1)).cast("long").alias("b"))
        spans = some.union(equal) if spans is None else spans.union(some).union(equal)
    if windows is not None:
        often = windows.where("h is not null").groupBy("h", "i").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        hit = windows.where("flags = 0").join(often, ["h", "i"]).drop("c").unionByName(windows.where("flags > 0"), allowMissingColumns=True)  # some have equals in their own slice
        spans = spans.union(hit.select("doc_id", "rk", F.col("start").cast("long").alias("a"), (F.col("start") + F.col("n") + (width - 1)).cast("long").alias("b")))
    return spans


def remove_repeats(docs: DataFrame, width: int = 200, grams: tuple[int, ...] = (64, 132, 180)) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 of every row of docs.

    Every byte goes that a string of `width` bytes covers which starts anywhere else in the texts, wherever it stands.
    Null texts are empty; shorter texts than `width` lose nothing; null ids are returned as they are; rows that repeat
    are documents of their own, so what they share goes from each; other columns of docs, whatever their names, are not
    read; no rows in, no rows out.
    """
    rows = gathered(repeats(docs, width, grams), keyed(docs).select("doc_id", "rk", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, gone, runs, kept = [], [], [], []
            for text, spans in zip(utf8(batch), column(batch, "spans").to_pylist(), strict=True):
                out = covered(spans, len(text))
                n.append(len(text))
                gone.append(int(out.sum()))
                runs.append(len(ranges(out)) if gone[-1] else 0)
                kept.append(np.frombuffer(text, np.uint8)[~out].tobytes() if gone[-1] else text)
            digests = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
            numbers = [pa.array(v, pa.int64()) for v in (n, gone, runs)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *numbers, pa.array(kept, pa.binary()), digests], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return rows.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")


def whole_characters(text: bytes, out: np.ndarray) -> bytes:
    """The kept bytes, each removed run narrowed to whole UTF-8 characters."""
    if not out.any():
        return text
    data = np.frombuffer(text, np.uint8)
    # A character goes if all its bytes do.
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(starts) or starts[0]:
        starts = np.concatenate([[0], starts])
    whole = np.minimum.reduceat(out.astype(np.int8), starts)
    return data[np.repeat(whole, np.diff(np.append(starts, len(data)))) == 0].tobytes()


def clean(docs: DataFrame, width: int = 200, grams: tuple[int, ...] = (64, 132, 180)) -> DataFrame:
    """docs with the repeated strings taken out of text (in whole characters), and n_chars, if there is one, renewed.

    Null texts stay null; other columns are kept, whatever their names; else as remove_repeats()."""
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col("doc_id"), F.xxhash64("doc_id", "text").alias("rk"), "text", F.struct(*docs.columns).alias("_doc"))
    joined = gathered(repeats(docs, width, grams), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [whole_characters(t, covered(s, len(t))).decode("utf-8", "replace") if s else None for t, s in zip(utf8(batch), column(batch, "spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), column(batch, "_doc")], names=["_text", "_doc"])

    doc_kind = dict(rows.dtypes)["_doc"]
    done = joined.select("text", "spans", "_doc").mapInArrow(run, f"_text string, _doc {doc_kind}")
    new = F.when(F.col("_text").isNull(), F.col("_doc.text")).otherwise(F.col("_text"))
    values = {"text": new} | ({"n_chars": F.when(F.col("_text").isNull(), F.col("_doc.n_chars")).otherwise(F.length("_text")).cast(kinds["n_chars"])} if "n_chars" in kinds else {})
    return done.select(*[values.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
