import random

from pyspark.sql import functions as F

from curio.operators import query as Q
from curio.operators.index import GRAM, SearchIndex, grams
from tests.helpers import item, items


def test_grams(spark):
    got = spark.createDataFrame([("abcab",), ("ab",), ("",), ("a\n😀b",), (None,)], "t string").select(grams("t").alias("g")).collect()
    assert [r["g"] for r in got] == [["abc", "bca", "cab"], [], [], ["a\n😀", "\n😀b"], None]
    assert GRAM.count(".") == 3


def test_index_as_the_scan(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcÄß优惠 ") for _ in range(rng.randint(1, 8)))
    made = [item(f"i{k:03d}", f"https://example.org/{k}", title=word(), description=word(), notes=word(), content_text=" ".join(word() for _ in range(20)), keywords=[word(), word()], author=rng.choice([None, word()])) for k in range(120)]
    table = items(spark, made)
    index = SearchIndex.build(table, str(tmp_path / "x"), per_bucket=10, gram_buckets=4)
    hay = {r["id"]: r["h"] for r in table.select("id", Q.haystack().alias("h")).collect()}
    needles = [h[i : i + rng.choice([1, 2, 3, 5, 12, 40])] for h in rng.sample(sorted(hay.values()), 12) for i in [rng.randrange(len(h))]] + ["", None, "not there", "  ORG/7 "]
    for needle in needles:
        want = {i for i, h in hay.items() if (needle or "").strip().lower() in h}
        assert {r["id"] for r in index.search(needle).collect()} == want, needle
    assert {r["id"] for r in SearchIndex.open(spark, str(tmp_path / "x")).search("example.org/77").collect()} == {"i077"}


def test_texts_read_fall_with_selectivity(spark, tmp_path):
    table = items(spark, [item(f"i{k:03d}", f"https://example.org/{k}", content_text=f"text {'rare' if k == 5 else 'common'} words") for k in range(60)])
    index = SearchIndex.build(table, str(tmp_path / "x"), per_bucket=5, gram_buckets=2)
    files = lambda needle: sum("/texts/" in f for f in index.texts_for(index.candidates(needle)).inputFiles())
    assert files("rare words") == 1 and files("common words") == 12
    assert index.candidates("rare common").count() <= 1 and index.candidates("zzz").count() == 0
