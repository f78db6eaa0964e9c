"""Decontamination, fill-in-the-middle and whitening against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from curio.llm import decontaminate, fim, whiten
from tests.llm.test_exact import frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(LOW))


def plain_hits(docs, items, width=10):
    wanted = [(str("" if i is None else i), w[p : p + min(width, len(w))]) for i, t in items if (w := split(t)) for p in range(max(1, len(w) - width + 1))]
    out = []
    for i, text, *_ in docs:
        w = split(text)
        gone, names = np.zeros(len(w), bool), set()
        for name, window in wanted:
            for p in range(len(w) - len(window) + 1):
                if w[p : p + len(window)] == window:
                    gone[p : p + len(window)] = True
                    names.add(name)
        out.append((i, len(w), int(gone.sum()), sorted(names), bool(gone.any())))
    return out


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abÀé9") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(11, 30))) for i in range(12)] + [(20, "Zwölf kurze Worte"), (21, None), (22, " .,-"), (23, items_text := text(15)), (24, items_text), (None, "nur drei hier"), (100, text(10)), (9, text(12))]
    docs = [(i, text(rng.choice([0, 4, 40, 90])), "en", "a") for i in range(40)]
    for k, (i, t) in enumerate(items):
        noisy = (t or "").upper().replace(" ", ", ")
        docs.append((100 + k, f"{text(5)} {noisy} - {text(7)}", "en", "a"))
        docs.append((200 + k, f"{text(5)} {' '.join(split(t)[:9])} x {t} {t}", "en", "b"))
    docs += [(300, None, None, None), (301, "", "en", "a"), (302, "!!", "en", "a"), (303, text(4000) + " " + items_text + " " + text(4000), "en", "a"), (None, items_text, "en", "a"), docs[45], docs[45]]
    docs += [(400 + i, items_text, "en", "a") for i in range(20)]
    return docs, items


@pytest.mark.parametrize("most_bytes", [decontaminate.BROADCAST_BYTES, 4000])
def test_decontamination(spark, leaks, most_bytes):
    docs, items = leaks
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clashing = frame(spark, docs).withColumns({c: F.lit("clash") for c in ("w", "r1", "h", "items", "a")})
    got = decontaminate.decontaminated(clashing, benchmark, most_bytes=most_bytes)
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, plain_hits(docs, items)))
    assert all(r["n_items"] == len(r["items"]) for r in got.collect())


def test_decontamination_runs_no_python(spark, leaks):
    docs, items = leaks
    got = decontaminate.decontaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_decontamination_of_empty_tables(spark, leaks):
    docs, items = leaks
    none, bare = frame(spark, docs).limit(0), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    clean = decontaminate.decontaminated(frame(spark, docs), bare).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] or r["n_hit"] for r in clean)


def test_spans_and_documents_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before: {item.title()}, after that.", "en", "a"), (2, "clean text", "en", "a"), (3, None, None, None), (4, item, "en", "a"), (5, f"a {item} b {item}! c", "en", "a"), (2, "clean text", "en", "a")]
    table = frame(spark, docs).withColumns({"spans": F.lit("clash"), "_doc": F.lit(1)})
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate.remove_spans(table, benchmark)
    assert left.columns == table.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in left.where("doc_id <> 3").collect()) == [(1, "Before: after that.", 19), (2, "clean text", 10), (2, "clean text", 10), (4, "", 0), (5, "a b c", 5)]
    assert left.where("doc_id = 3 and text is null and n_chars is null").count() == 1
    assert sorted(r["doc_id"] for r in decontaminate.remove_documents(table, benchmark).collect()) == [2, 2, 3]
    assert sorted(r["doc_id"] for r in decontaminate.remove_documents(table, benchmark, most_hit=0.9).collect()) == [1, 2, 2, 3, 5]


def plain_fim(i, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if h[3] % 100 < 20:
        return n, "spm", a, z - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, z - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ab é\n<>SPM😀") for _ in range(n))
    docs = [(i, text(rng.choice([1, 2, 3, 30, 300])), "en", "a") for i in range(200)]
    docs += [(500, None, None, None), (501, "", "en", "a"), (502, "has <P> in it", "en", "a"), (503, "<S", "en", "a"), (504, "é" * 300_000, "en", "a"), (None, "null id", "en", "a"), docs[3], docs[3]]
    table = frame(spark, docs).withColumns({c: F.lit("clash") for c in ("n", "form", "output", "pieces")})
    both = fim.undo(fim.render(fim.describe(table)))
    hashes = fim.hashed(both, {"pieces": "o", "restoring": "r"}, keep=["doc_id", "n", "form", "prefix_chars", "middle_chars"])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *(w := plain_fim(i, t))[:4], sha(w[4]), sha(t or "")) for i, t, *_ in docs]
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert sorted(map(repr, map(tuple, hashes.collect()))) == sorted(map(repr, want))
    outputs = fim.fill_in_middle(table)
    assert sorted(repr((r["doc_id"], r["output"])) for r in outputs.collect()) == sorted(repr((i, plain_fim(i, t)[4])) for i, t, *_ in docs)
    assert sorted(repr((r["doc_id"], r["restored"])) for r in fim.restored(outputs).collect()) == sorted(repr((i, t or "")) for i, t, *_ in docs)
    assert fim.hashed(fim.describe(table.limit(0)), {"pieces": "o"}, keep=["doc_id"]).count() == 0


def test_piece_tables_move_no_text(spark):
    row = fim.describe(frame(spark, [(7, "ab" * 50, "en", "a")])).first()
    assert row["form"] != "plain" and sum(p["length"] for p in row["pieces"] if p["buffer"] == "text") == 100
    assert [fim.SENTINELS[p["start"] : p["start"] + p["length"]] for p in row["pieces"] if p["buffer"] == "marks"][-1] == "<M>"


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def plain_whitening(good):
    x = np.floor(np.array(good, np.float32).astype(np.float64) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, centred, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("size", [5, 40])
def test_whitening(spark, size):
    rng = np.random.default_rng(size)
    base = rng.normal(size=(400, size)) @ np.diag(np.geomspace(40, 0.3, size)) @ np.linalg.qr(rng.normal(size=(size, size)))[0]
    good = base.astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(good)]
    odd = [(900, None, 0), (901, [], 0), (902, [None, *rows[0][1][1:]], 0), (903, [float("nan"), *rows[0][1][1:]], 0), (904, [float("inf"), *rows[0][1][1:]], 0), (905, [1.0], 0), (906, [3e38, *rows[0][1][1:]], 0)]
    table = vectors(spark, rows + odd + [(None, rows[1][1], 0), rows[2]]).withColumns({"v": F.lit("clash"), "whitened": F.lit(0)})
    got = whiten.components(table).collect()
    x, n, s, centred, e, v = plain_whitening([*good, good[1], good[2]])
    count = min(32, size)
    assert len(got) == n * count and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(by) == list(range(1, count + 1))
    for k in range(count):
        want = centred @ v[:, k] / np.sqrt(e[k])
        mine = np.array([by[k + 1][i]["whitened"] for i in range(400)])
        sign = np.sign(mine @ want[:400])
        assert np.abs(mine * sign - want[:400]).max() < 1e-6
        assert abs(by[k + 1][0]["explained"] / (e[k] / e.sum()) - 1) < 1e-9
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x[:400]]
    assert [by[1][i]["deviation"] for i in range(400)] == exact


def test_whitening_of_nearly_dependent_dimensions(spark):
    """The smallest standard deviation is a 10^5th of the largest; the plain covariance loses five more digits."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(-3_000_000, 3_000_000, size=(2, 500)), rng.integers(-20, 20, size=500)
    good = np.stack([a[0] + b, a[0], a[1]], axis=1) / 64
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(good)], "vec_id long, embedding array<double>")
    got = whiten.components(table).collect()
    assert len(got) == 1500 and max(r["identity_error"] for r in got) < 1e-6
    centred = good - good.mean(axis=0)
    exact = np.linalg.svd(centred * 64, compute_uv=False) ** 2
    found = {r["component"]: r["explained"] for r in got}
    assert all(abs(found[k + 1] / (exact[k] / exact.sum()) - 1) < 1e-6 for k in range(3))


def test_whitening_of_fewer_directions(spark):
    same = whiten.components(vectors(spark, [(i, [1.0, 2.0], 0) for i in range(5)]))
    assert same.count() == 0 and whiten.components(vectors(spark, [(1, None, 0)])).count() == 0 and whiten.components(vectors(spark, [(1, [1.0], 0)]).limit(0)).count() == 0
    rng = np.random.default_rng(2)
    flat = rng.integers(-500, 500, size=(60, 2)) @ np.array([[1, 0, 2], [0, 1, 1]])
    got = whiten.components(vectors(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(flat)])).collect()
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-9


def test_solved_is_the_inverse():
    rng = np.random.default_rng(3)
    r, a = np.triu(rng.normal(size=(6, 6))) + 3 * np.eye(6), rng.normal(size=(9, 6))
    assert np.allclose(whiten.solved(r, a) @ r, a)


def test_deviations_beyond_longs():
    at = whiten.Center(3_000_000_000, 2, (3_000_000_000 * 1_000_000 + 1, 3_000_000_000 * 1_000_000))
    x = np.array([[1_000_005, 900_000]])
    assert at.deviations(x) == [sum((at.n * int(v) - s) ** 2 for v, s in zip(x[0], at.sums, strict=True))]
