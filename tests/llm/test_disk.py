"""What intermediate tables and shuffles leave on disk."""

import glob
import os
import random
import time

from pyspark.sql import functions as F

from curio.llm import rules, simhash
from curio.llm.common import cut_dir
from tests.llm.test_exact import frame


def _size(pattern):
    return sum(os.path.getsize(f) for f in glob.glob(pattern, recursive=True) if os.path.isfile(f))


def test_quality_rules_write_no_copy_of_the_documents(spark):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows = [(i, text(400), "en", "a" if i % 3 else None) for i in range(600)] + [(700 + i, "too short", None, "a") for i in range(3)]
    rows += [(None, text(400), None, "a"), (None, text(400), None, "a"), (5, rows[5][1], "en", "a"), (800, None, "en", "a")]
    docs = frame(spark, rows)
    folder = cut_dir(spark).removeprefix("file:")
    before = _size(f"{folder}/**")
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    got = sorted(map(repr, kept.collect()))
    assert _size(f"{folder}/**") - before < sum(len(r[1] or "") for r in rows) / 4
    verdicts = rules.judge(docs.select("doc_id", "lang", "source", "text", F.struct(*docs.columns).alias("_doc")))
    assert got == sorted(map(repr, verdicts.where("kept").select("_doc.*").collect())) and 500 < len(got) < len(rows) - 3


def test_components_free_the_shuffles_of_their_links(spark):
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffles = lambda: sum(_size(f"{d}/**/shuffle_*") for d in dirs)
    plan = simhash.similarity_plan()
    rows = spark.range(3000).select(F.array(*[F.xxhash64(F.lit(k), "id") for k in range(plan.words)]).alias("f"))
    before = shuffles()
    found = simhash.components(simhash.links(rows, plan))
    for _ in range(30):  # the cleaner works beside; nothing else collects garbage meanwhile
        if shuffles() < before + 2_000_000:
            break
        time.sleep(0.1)
    assert shuffles() < before + 2_000_000 and found.count() == 0
