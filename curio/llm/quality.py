"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.llm.common import column, slices, utf8
from curio.llm.toxicity import labelled

DIMENSIONS = 1 << 15
#: Bytes to classes of a word's shape: capital, letter, digit; others stand for themselves.
_SHAPE = bytes(ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"x+|X+|0+")


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a document: words (each by its share, damped), shapes of words and of pairs of them by
    their shares, and steps of the document's length, repeated lines and repeated words."""
    words = text.split()
    n = len(words)
    names: list[bytes] = []
    values: list[float] = []

    def put(kind: bytes, counts: Counter, total: int, weight: float) -> None:
        names.extend(kind + k for k in counts)
        values.extend([weight * (c / total) ** 0.5 for c in counts.values()])

    if n:
        put(b"w", Counter(words), n, 1.0)
        shapes = _RUN.sub(lambda m: m[0][:1], text.translate(_SHAPE)).split()
        put(b"s", Counter(shapes), n, 2.0)
        if n > 1:
            put(b"p", Counter(map(b" ".join, zip(shapes, shapes[1:], strict=False))), n - 1, 1.0)
    lines = [x for x in text.split(b"\n") if x.strip()]
    names += [b"n%d" % n.bit_length(), b"l%d" % (10 * (len(lines) - len(set(lines))) // max(1, len(lines))), b"d%d" % (10 * len(set(words)) // max(1, n))]
    values += [1.0, 1.0, 1.0]
    at = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names)) % np.uint64(DIMENSIONS)
    return at.astype(np.int32), np.array(values, np.float32)


class Ordinal:
    """P(grade > k) = logistic(w.x - threshold k), one w for all k and ordered thresholds."""

    def __init__(self, grades: int):
        self.grades = grades
        self.w, self.cuts = np.zeros(DIMENSIONS), np.arange(grades - 1, dtype=float) - (grades - 2) / 2

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 30, rate: float = 0.2, ridge: float = 1e-5) -> Ordinal:
        """Adagrad over batches of 64. The gaps between thresholds are exponentials, so they stay in order."""
        rng = np.random.default_rng(7)
        first, gaps = self.cuts[0] if len(self.cuts) else 0.0, np.zeros(max(0, self.grades - 2))
        sum_w, sum_c = np.full(DIMENSIONS, 1e-6), np.full(max(1, self.grades - 1), 1e-6)
        for _ in range(epochs if len(rows) and self.grades > 1 else 0):
            order = rng.permutation(len(rows))
            for begin in range(0, len(order), 64):
                batch = order[begin : begin + 64]
                at = np.concatenate([rows[i][0] for i in batch])
                value = np.concatenate([rows[i][1] for i in batch])
                row = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
                cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
                score = np.bincount(row, value * self.w[at], len(batch))
                # Log-likelihood of a grade is log(F(upper) - F(lower)) of logistic F.
                edges = np.concatenate([[-np.inf], cuts, [np.inf]])
                up, low = edges[y[batch] + 1] - score, edges[y[batch]] - score
                fu, fl = 1 / (1 + np.exp(-np.clip(up, -40, 40))), 1 / (1 + np.exp(-np.clip(low, -40, 40)))
                du, dl, p = fu * (1 - fu), fl * (1 - fl), np.maximum(fu - fl, 1e-9)
                by_score = (du - dl) / p  # d(-log p) / d(score)
                grad = np.bincount(at, value * by_score[row], DIMENSIONS) / len(batch)
                touched = np.unique(at)
                grad = grad[touched] + ridge * self.w[touched]
                sum_w[touched] += grad**2
                self.w[touched] -= rate * grad / np.sqrt(sum_w[touched])
                by_cut = np.zeros(self.grades - 1)
                for k in range(self.grades - 1):
                    by_cut[k] = (np.where(y[batch] == k + 1, dl / p, 0) - np.where(y[batch] == k, du / p, 0)).mean()
                tail = np.cumsum(by_cut[::-1])[::-1]
                own = np.concatenate([[tail[0]], tail[1:] * np.exp(gaps)])
                sum_c += own**2
                move = rate * own / np.sqrt(sum_c)
                first, gaps = first - move[0], np.clip(gaps - move[1:], -6, 4)
        if self.grades > 1:
            self.cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        return self

    def tails(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """P(grade > k) for each row and k."""
        score = np.array([float(np.dot(value, self.w[at])) for at, value in rows]).reshape(-1, 1)
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score, -40, 40)))


def fit(docs: DataFrame, ratings: DataFrame, grades: int = 3, most: int = 12_000) -> Ordinal:
    """The model from at most `most` rated documents (doc_id, grade from 0 to grades - 1), see toxicity.labelled().

    No ratings, or no documents of them: the model that knows nothing. Null texts are empty."""
    wanted = labelled(docs, ratings.where(F.col("grade").between(0, grades - 1)).select("doc_id", "grade"), "grade", most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [hashed(t) for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").cast(pa.string()), column(batch, "grade"), pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())],
                names=["doc_id", "grade", "at", "value"],
            )

    found = wanted.select("doc_id", "text", "grade").mapInArrow(run, "doc_id string, grade int, at binary, value binary").orderBy("doc_id").collect()  # at most `most` sparse rows
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in found]
    return Ordinal(grades).fit(rows, np.array([r["grade"] for r in found], np.int64))


def grade(docs: DataFrame, model: Ordinal, at_least: int = 1, cut: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of at_least or a higher grade) and kept of every row of docs.

    kept where the tail probability is `cut` or more. Null texts are empty and get the grade of such; whole texts count,
    however long; rows that repeat are graded one by one, so equal texts get equal grades; other columns of docs,
    whatever their names, are not read; no rows in, no rows out. Rows stay where they are; the weights, DIMENSIONS of
    them, go along with the function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tails = model.tails([hashed(t) for t in utf8(batch)])
            tail = tails[:, at_least - 1]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(tails.sum(1), pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= cut, pa.bool_())],
                names=["doc_id", "expected_grade", "tail_probability", "kept"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, kept boolean")
