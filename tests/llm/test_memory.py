"""What an executor holds beside its heap."""

import random

import corpus_pipeline
from tests.llm.test_exact import frame


def _deepest(node, above=0):
    """The most Python nodes in one stage of a plan: a task has a worker for each of them."""
    name, children = node.nodeName(), node.children()
    if name == "AdaptiveSparkPlan":
        return _deepest(node.executedPlan(), above)
    own = 0 if "Exchange" in name else above + ("InArrow" in name or "InPandas" in name)
    return max([above, own, *[_deepest(children.apply(i), own) for i in range(children.size())]])


def test_a_task_of_the_pipeline_has_one_python_worker(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))
    base, shared = text(200), text(60)
    rows = [(i, text(120), "en", "a" if i % 3 else "b") for i in range(40)] + [(100 + i, f"{base} {text(1)}", "en", "a") for i in range(4)]
    docs = frame(spark, rows + [(200 + i, f"{text(60)} {shared} {text(60)}", "en", "b") for i in range(3)])
    seen, original = [], type(docs).mapInArrow

    def counted(self, *args, **options):
        out = original(self, *args, **options)
        seen.append(_deepest(out._jdf.queryExecution().executedPlan()))
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, "")
        seen.append(_deepest(done._jdf.queryExecution().executedPlan()))
        done.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert len(seen) > 15 and max(seen) == 1
