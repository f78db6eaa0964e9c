"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.llm.common import column, cut, slices

# Insults and second-person words of the languages at hand; the labels add to the insults.
INSULTS = frozenset(
    "idiot idiots stupid moron morons imbecile dumb dumbass fool fools loser losers trash garbage scum clown clowns worthless pathetic disgusting "
    "filth filthy vermin pig pigs bastard bitch asshole crap shit fuck fucking jerk creep freak retard hate ugly liar coward parasite "
    "dumm dummkopf trottel arschloch schwein abschaum wertlos erbärmlich ekelhaft versager hässlich scheisse scheiße blöd "
    "imbécile stupide connard salope crétin débile ordure déchet minable dégoûtant abruti merde perdant inutile "
    "idiota estúpido estúpida imbécil tonto basura escoria patético asqueroso perdedor mierda payaso cabrón puta inútil".split()
)
YOU = frozenset("you your yours yourself yourselves ur u du dich dir dein deine deiner euch euer ihr tu te toi ton ta tes vous votre vos usted ustedes ti tú tuyo".split())
LEET = str.maketrans("013457@$!|", "oieastasil")

_TOKEN = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[a-z]+[0-9@$!|*.\-_]+(?:[a-z0-9@$!|*.\-_]*[a-z])")
_LONG_RUN = re.compile(r"([a-z])\1\1")
_CAPS = re.compile(r"\b[A-Z]{2,}\b")
FEATURES = [
    "log_words", "insults", "log_insults", "learned", "log_learned", "learned_weight", "you", "near_you", "log_near_you", "capitals", "caps_words",
    "exclaims", "questions", "punctuation", "digits", "mixed", "masked_insults", "long_runs", "word_length",
]


def _terms(token: str) -> tuple[str, ...]:
    """What the learned lexicon knows a word by: itself, and its first four and five letters, marked by a dot."""
    return (token, token[:4] + ".", token[:5] + ".") if len(token) > 5 else (token, token[:4] + ".") if len(token) > 4 else (token,)


def features(text: str, learned: dict[str, float], reach: int = 6) -> list[float]:
    """One document's features: rates for each word or character, with counts of the rare ones on a log scale."""
    low = text.lower()
    tokens = _TOKEN.findall(low)
    n, chars = max(1, len(tokens)), max(1, len(text))
    fixed = [i for i, t in enumerate(tokens) if t in INSULTS]
    known = learned.keys()
    won = {i: max(learned[k] for k in _terms(t) if k in learned) for i, t in enumerate(tokens) if not known.isdisjoint(_terms(t))} if learned else {}
    you = [i for i, t in enumerate(tokens) if t in YOU]
    hits = sorted({*fixed, *won})
    near = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        left = np.array([-reach * 9, *you])[at]
        right = np.array([*you, len(tokens) + reach * 9])[at]
        near = int((np.minimum(np.array(hits) - left, right - np.array(hits)) <= reach).sum())
    mixed = _MIXED.findall(low)
    masked = sum(1 for m in mixed if (plain := re.sub(r"[^\w]|_", "", m.translate(LEET))) in INSULTS or plain in learned)
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    ends = text.count("!"), text.count("?")
    return [
        math.log1p(len(tokens)), len(fixed) / n, math.log1p(len(fixed)), len(won) / n, math.log1p(len(won)), sum(won.values()) / n,
        len(you) / n, near / n, math.log1p(near), upper / chars, len(_CAPS.findall(text)) / n, ends[0] / n, ends[1] / n,
        sum(map(text.count, ".,;:!?\"'()-*#$%&|")) / chars, sum(map(text.count, "0123456789")) / chars, len(mixed) / n, masked / n,
        len(_LONG_RUN.findall(low)) / n, len(text) / n,
    ]


class Trees:
    """Boosted regression trees for a 0/1 label: Newton steps on the logistic loss, splits at quantiles."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 3.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        prior = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.trees = math.log(prior / (1 - prior)), []
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        # Rates that are mostly 0 have few quantiles above it: the spread of the others is added.
        self.cuts = [np.unique(np.concatenate([k, np.quantile(c[c > 0], np.linspace(0, 1, 12)) if (c > 0).any() else [], [0.0]])) for k, c in zip(self.cuts, x.T, strict=True)]
        binned = np.stack([np.searchsorted(k, c, "left") for k, c in zip(self.cuts, x.T, strict=True)]) if len(y) else np.zeros((x.shape[1], 0), int)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) and 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-f))
            tree, step = self._grow(binned, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            f += self.rate * step
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A tree as rows of (feature, cut, leaf value) in heap order; rows go right where value > cut."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        at, step = np.zeros(binned.shape[1], np.int64), np.zeros(binned.shape[1])
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = -gs / (hs + self.ridge)
            step[rows] = value[node]
            if node >= 2**self.depth - 1:
                continue
            best = (1e-6, -1, 0)
            for j, cuts in enumerate(self.cuts):
                if not len(cuts):
                    continue
                b = binned[j, rows]
                gl, hl = (np.cumsum(np.bincount(b, w[rows], len(cuts) + 1))[:-1] for w in (g, h))
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(np.minimum(hl, hs - hl) < self.least * 0.05)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], self.cuts[best[1]][best[2]]
                at[rows] = 2 * node + 1 + (binned[best[1], rows] > best[2])
        return (feature, cut, value), step

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        every = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[at]
                at = np.where(j >= 0, 2 * at + 1 + (x[every, np.maximum(j, 0)] > cut[at]), at)
            f += self.rate * value[at]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the monotone step fit by pooling adjacent violators; a prior of one case each way."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest and highest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            v2, w2, _, hi = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += w2
            blocks[-1][3] = hi
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    p = [b[0] / b[1] for b in blocks]
    return np.array([x for b in blocks for x in (b[2], b[3])]), np.array([x for q in p for x in (q, q)])


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, label and h (the text's hash) of at most `most` labelled documents that may be learned from: those
    of lowest hash.

    Rows whose crc32(doc_id as text) is divisible by 5 are held out. `most` rows of two numbers are broadcast. Where
    rows share a doc_id, one stays, that of the smallest text hash; a label that differs counts as the higher one."""
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    chosen = usable.where(part != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", label).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", "t.text", label, F.col("t.h").alias("h"))


def _lexicon(rows: DataFrame, least_docs: int, most_words: int) -> dict[str, float]:
    """Terms (words and beginnings of words) that mark the label: term -> log odds, from the documents of rows, equal
    texts once. The most_words of the largest document count times log odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, ys = [], []
            for text, y in zip(column(batch, "text").to_pylist(), column(batch, "y").to_pylist(), strict=True):
                own = {k for t in set(_TOKEN.findall((text or "").lower())) for k in _terms(t)}
                words += own
                ys += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ys, pa.int32())], names=["word", "y"])

    rows = rows.dropDuplicates(["text"])
    totals = rows.agg(F.sum("y").alias("yes"), F.count(F.lit(1)).alias("n")).first()
    yes, no = totals["yes"] or 0, (totals["n"] or 0) - (totals["yes"] or 0)
    counted = rows.select("text", "y").mapInArrow(run, "word string, y int").groupBy("word").agg(F.sum("y").alias("yes"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("yes") + 0.5) / (yes + 1.0)) - F.log((F.col("n") - F.col("yes") + 0.5) / (no + 1.0))
    enough = F.greatest(F.lit(least_docs), F.lit(yes / 200))
    found = counted.where((F.col("yes") >= enough) & (odds > 3.0)).select("word", odds.alias("odds"), (F.col("yes") * odds).alias("weight"))
    return {r["word"]: r["odds"] for r in found.orderBy(F.desc("weight"), "word").limit(most_words).collect()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 30_000, least_docs: int = 5, most_terms: int = 300) -> tuple[dict, Trees, tuple]:
    """(lexicon, trees, isotonic knots) from at most `most` labelled documents, none of them held out.

    The trees see densities of lexicons that were learned on the other half of the rows, so that no word's density
    echoes the labels it was learned from; scores use the lexicon of both halves. The calibration sees margins of
    trees that were fitted on other rows. Halves and folds go by the text, so equal texts are on one side. A lexicon
    holds `most_terms` terms at most.
    """
    rows = cut(labelled(docs, labels, label, most).select("doc_id", "text", F.col(label).alias("y"), F.pmod("h", F.lit(2)).alias("half"), F.pmod(F.shiftright("h", 1), F.lit(4)).alias("fold")))
    halves = [rows.where(F.col("half") == k) for k in range(2)]
    lexicons = [_lexicon(half, least_docs, most_terms) for half in halves]
    measured = [score_features(half.select("doc_id", "text", "y", "fold"), other, keep=["y", "fold"]) for half, other in zip(halves, reversed(lexicons), strict=True)]
    found = measured[0].union(measured[1]).orderBy("doc_id").collect()  # at most `most` rows of dense features
    x = np.array([r["features"] for r in found], float).reshape(-1, len(FEATURES))
    y = np.array([r["y"] for r in found], float)
    fold = np.array([r["fold"] for r in found], int)
    cross = np.zeros(len(y))
    for k in range(4):
        cross[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return _lexicon(rows, least_docs, most_terms), Trees().fit(x, y), isotonic(cross, y)


def score_features(docs: DataFrame, learned: dict[str, float], keep: list[str]) -> DataFrame:
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(t or "", learned) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *[column(batch, c) for c in keep], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", *keep, "features"])

    schema = ", ".join([f"doc_id {kinds['doc_id']}", *[f"`{c}` {kinds[c]}" for c in keep], "features array<double>"])
    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def score(docs: DataFrame, model: tuple[dict, Trees, tuple]) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs; null texts are empty. Rows stay where they are."""
    learned, trees, (knots, p) = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t or "", learned) for t in column(batch, "text").to_pylist()], float).reshape(-1, len(FEATURES))
            margin = trees.margin(x)
            # A thousandth of the raw probability keeps the order inside the calibration's steps.
            out = 0.999 * np.interp(margin, knots, p) + 0.001 / (1 + np.exp(-margin))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.clip(out, 0, 1), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    held_out rows (crc32 of the doc_id as text is divisible by 5; a null doc_id is held out) are never learned from.
    Null or empty texts get the score of a text without words. Without labels of both kinds the score is constant.
    Rows that repeat are scored one by one; whole texts count, however long; other columns of docs, whatever their
    names, are not read; no rows in, no rows out.
    """
    scored = score(docs, fit(docs, labels, **options))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
