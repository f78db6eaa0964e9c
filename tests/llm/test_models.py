"""Operators that learn: held-out accuracy, and their parts against plain versions."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from curio.llm import quality, toxicity

BAD = ["grumblat", "grumbler", "grumbling", "idiot"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(20, 60))]
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(w + "%%%" * junk for w in words)))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(9001, None), (9002, ""), (None, "no id"), (9001, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, tables):
    docs, labels = tables
    got = toxicity.toxicity(docs, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == 904 and len(held) > 100 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1


def learned_from(docs, labels, label):
    """(doc_id, text, label, hash) that may be learned from, by plain Python: see toxicity.labelled()."""
    best = {}
    for r in labels:
        if r["doc_id"] is not None and r[label] is not None:
            best[r["doc_id"]] = max(best.get(r["doc_id"], -1), r[label])
    one = {}
    for r in docs:
        if r["doc_id"] in best and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            h = 42 if r["text"] is None else xxhash.xxh64_intdigest(r["text"].encode(), 42)
            h -= (h >> 63) << 64
            one[r["doc_id"]] = min(one.get(r["doc_id"], (1 << 63, "")), (h, r["text"] or ""))
    return [(i, t, best[i], h) for i, (h, t) in sorted(one.items())]


def lexicon(rows):
    """Terms by plain counting: see toxicity._lexicon()."""
    once = {t: y for _, t, y, _ in reversed(rows)}
    yes, no = sum(once.values()), len(once) - sum(once.values())
    hits, every = collections.Counter(), collections.Counter()
    for t, y in once.items():
        own = {k for w in toxicity._TOKEN.findall(t.lower()) for k in toxicity._terms(w)}
        every.update(own)
        hits.update(own if y else ())
    odds = {k: math.log((hits[k] + 0.5) / (yes + 1)) - math.log((n - hits[k] + 0.5) / (no + 1)) for k, n in every.items()}
    some = [k for k, o in odds.items() if o > 3 and hits[k] >= max(5, yes / 200)]
    return {k: odds[k] for k in sorted(some, key=lambda k: (-hits[k] * odds[k], k))[:300]}


def test_toxicity_is_its_plain_version(spark, tables):
    docs, labels = tables
    texts, rows = docs.collect(), learned_from(docs.collect(), labels.collect(), "toxic")
    halves = [[r for r in rows if r[3] % 2 == k] for k in range(2)]
    lexicons = [lexicon(h) for h in halves]
    found = sorted((i, toxicity.features(t, other), y, (h >> 1) % 4) for half, other in zip(halves, reversed(lexicons), strict=True) for i, t, y, h in half)
    x, y, fold = (np.array([r[k] for r in found], float) for k in (1, 2, 3))
    cross = np.zeros(len(y))
    for k in range(4):
        cross[fold == k] = toxicity.Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    trees, (knots, p), words = toxicity.Trees().fit(x, y), toxicity.isotonic(cross, y), lexicon(rows)
    margin = trees.margin(np.array([toxicity.features(r["text"] or "", words) for r in texts], float))
    want = np.clip(0.999 * np.interp(margin, knots, p) + 0.001 / (1 + np.exp(-margin)), 0, 1)
    key = lambda i, s: (i is None, i or 0, round(s, 9))
    got = toxicity.toxicity(docs.withColumns({c: F.lit("clash") for c in ("features", "y", "score", "held_out")}), labels).collect()
    assert sorted(key(r["doc_id"], r["score"]) for r in got) == sorted(key(r["doc_id"], s) for r, s in zip(texts, want, strict=True))
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_quality_is_its_plain_version(spark, tables):
    docs, labels = tables
    ratings = labels.where("quality is not null").selectExpr("doc_id", "quality + if(quality = 1 and toxic = 0, 1, 0) as grade")
    rows = sorted(learned_from(docs.collect(), ratings.collect(), "grade"), key=lambda r: str(r[0]))
    model = quality.Ordinal(3).fit([quality.hashed(t.encode()) for _, t, *_ in rows], np.array([y for _, _, y, _ in rows]))
    got = quality.grade(docs.withColumns({c: F.lit("clash") for c in ("kept", "grade")}), quality.fit(docs, ratings)).collect()
    tails = model.tails([quality.hashed((r["text"] or "").encode()) for r in docs.collect()])
    key = lambda i, *v: (i is None, i or 0, *[round(float(x), 9) for x in v])
    assert sorted(key(r["doc_id"], r["expected_grade"], r["tail_probability"], r["kept"]) for r in got) == sorted(key(r["doc_id"], t.sum(), t[0], t[0] >= 0.5) for r, t in zip(docs.collect(), tails, strict=True))


def test_learners_take_odd_tables(spark, tables):
    """Empty documents, no ratings, a very long text, texts that are equal, rows that repeat."""
    docs, labels = tables
    ratings = labels.where("quality is not null").selectExpr("doc_id", "quality as grade")
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and quality.grade(docs.limit(0), quality.fit(docs.limit(0), ratings)).count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    odd = spark.createDataFrame([(1, long), (2, long), (3, "same text"), (3, "same text"), (4, "same text"), (None, None)], docs.schema)
    for got in (
        {(r["doc_id"], r["score"]) for r in toxicity.score(odd, toxicity.fit(docs, labels)).collect()},
        {(r["doc_id"], r["expected_grade"]) for r in quality.grade(odd, quality.fit(docs, ratings)).collect()},
        {(r["doc_id"], r["expected_grade"]) for r in quality.grade(odd, quality.fit(docs, ratings.limit(0))).collect()},
    ):
        by_id = dict(got)
        assert len(got) == 5 and by_id[1] == by_id[2] and by_id[3] == by_id[4]


def test_isotonic_is_monotone_and_fits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    knots, p = toxicity.isotonic(x, y)
    fit = np.interp(np.sort(x), knots, p)
    assert (np.diff(fit) >= -1e-12).all() and abs(fit.mean() - y.mean()) < 0.02
    # The best monotone fit by brute force: maximum over starts of the minimum over ends of means.
    v = y[np.argsort(x)][:40]
    best = [max(min(v[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    knots, p = toxicity.isotonic(np.arange(40.0), v)
    assert np.allclose(np.interp(np.arange(40.0), knots, p), best)


def test_trees_learn_a_step():
    rng = np.random.default_rng(2)
    x = rng.random((600, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    m = toxicity.Trees().fit(x[:400], y[:400]).margin(x[400:])
    assert ((m > 0) == (y[400:] > 0)).mean() > 0.93
    flat = toxicity.Trees().fit(x[:0], y[:0]).margin(x[:3])
    assert np.allclose(flat, 0.0)


def test_features():
    f = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT! grumbler 1d10t", {"grumb.": 4.0}), strict=True))
    assert f["insults"] == 1 / 4 and f["learned"] == 1 / 4 and f["near_you"] == 2 / 4 and f["exclaims"] == 1 / 4 and f["learned_weight"] == 1.0
    assert toxicity.features("", {})[0] == 0.0


def test_quality(spark, tables):
    docs, labels = tables
    ratings = labels.where("quality is not null").selectExpr("doc_id", "quality + if(quality = 1 and toxic = 0, 1, 0) as grade")
    got = {r["doc_id"]: r for r in quality.grade(docs, quality.fit(docs, ratings)).collect()}
    truth = {r["doc_id"]: r["grade"] for r in ratings.collect() if r["doc_id"] is not None}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["kept"] == (truth[i] > 0) for i in held) / len(held) > 0.97
    mean = lambda g: np.mean([got[i]["expected_grade"] for i in held if truth[i] == g])
    assert mean(0) < mean(1) and mean(0) < mean(2) and all(0 <= r["expected_grade"] <= 2 for r in got.values()) and got[9001]["expected_grade"] == got[9002]["expected_grade"]


def test_ordinal_thresholds_stay_in_order():
    rng = np.random.default_rng(3)
    rows = [(np.array([0], np.int32), np.array([v], np.float32)) for v in rng.normal(size=600)]
    y = np.array([int(np.searchsorted([-0.5, 0.5, 1.0], float(v[0]))) for _, v in rows])
    model = quality.Ordinal(4).fit(rows, y)
    assert (np.diff(model.cuts) > 0).all() and model.w[0] > 0
    tails = model.tails(rows)
    assert (np.diff(tails, axis=1) <= 0).all() and np.abs(tails.sum(1) - y).mean() < 0.35 and not math.isnan(model.w[0])
