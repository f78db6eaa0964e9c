import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_exact import frame


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, shared = text(200), text(60)
    rows = [(i, text(120), "en", "a" if i % 3 else "b") for i in range(60)]
    rows += [(100 + i, base, "en", "a") for i in range(5)] + [(110, base + " tail", "en", "a")]
    rows += [(120 + i, f"{text(60)} {shared} {text(60)}", "en", "b") for i in range(3)]
    rows += [(200, "too short", "en", "a"), (201, None, "en", None), (202, "again " * 90, "en", "a")]
    docs = frame(spark, rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["quality_rules"]) == {r[0] for r in rows} - {200, 201, 202}
    assert set(seen["near_dedup"]) == set(seen["quality_rules"]) - {101, 102, 103, 104, 110}
    assert all(shared not in seen["long_repeats"][i] for i in (120, 121, 122)) and seen["long_repeats"][0] == rows[0][1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == set(seen["mix_sources"]) and len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)


def test_stages_take_empty_tables(spark):
    docs = frame(spark, [(1, "x", "en", "a")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_stages_take_rows_that_repeat_and_clashing_names(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(i, text(80), "en", "a") for i in range(20)]
    names = ("rk", "th", "spans", "size", "copies", "kept", "_doc", "id", "key", "family")
    docs = frame(spark, rows + rows[:5] + [(None, text(80), None, None)]).withColumns({c: F.lit("clash") for c in names if c != "_doc"})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and docs.where("rk <> 'clash'").count() == 0
        if name == "near_dedup":
            assert docs.count() == 21
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
