import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from curio.operators import query as Q
from curio.operators.addressed import ITEMS, LISTED, Store
from curio.sources.schemas import EDIT_SCHEMA
from tests.helpers import START, item, items
from tests.test_addressed import batch_of, narrow, rows  # noqa: F401



def counts_of(store):
    whole = store.load()
    own = Q.label_rows(whole, "status").unionByName(whole.select("status", F.lit(ITEMS).alias("dim"), F.lit("").alias("label")))
    return rows(own.groupBy("status", "dim", "label").agg(F.count("*").alias("count")))


def agree(store):
    assert rows(store.label_counts()) == counts_of(store)
    now = F.timestamp_seconds(F.lit(1_710_000_000))
    assert rows(store.digest(now)) == rows(Q.collection_digest(store.load(), now))


def test_counts_after_random_batches(narrow, tmp_path):  # noqa: F811
    """Upserts, moves, edits and deletions: counts and digest are those of all items, also when few newest are left."""
    spark, rng = narrow, random.Random(5)
    store = Store.open(spark, str(tmp_path / "s"), buckets=2, counted=True, deltas=1, full_every=2, keep=14, least=8)
    names = EDIT_SCHEMA.fieldNames()
    for n in range(3):
        if n in (0, 2):
            made = [item(f"i{rng.randrange(40)}", f"https://example.org/{rng.randrange(40)}", rng.randrange(9), title=f"t{n}-{k}", category=rng.choice(["技术", " 美食", "", "旅行"]), keywords=rng.choice([[], ["a", "b ", "a"], ["优惠"], [" "]])) for k in range(30)]
            store.upsert(n, batch_of(spark, made))
        else:
            edits = [dict.fromkeys(names) | {"seq": s, "id": f"i{rng.randrange(40)}", "kind": rng.choice(["status", "metadata", "delete"]), "status": rng.choice(["archived", "favorite"]), "category": "新", "at": START + timedelta(days=s)} for s in range(16)]
            store.edit(n, spark.createDataFrame([tuple(e[c] for c in names) for e in edits], EDIT_SCHEMA))
        assert rows(store.label_counts()) == counts_of(store)
    want = counts_of(store)
    agree(store)
    store.upsert(2, batch_of(spark, made))
    assert rows(store.label_counts()) == want
    assert store.vacuum(3)
    again = store.rehash(str(tmp_path / "wide"), 4)
    agree(again)
    assert rows(again.stats("favorite")) == rows(Q.collection_stats(store.load(), status="favorite"))


def test_counts_of_an_empty_and_of_an_uncounted_store(narrow, tmp_path):  # noqa: F811
    spark = narrow
    empty = Store.open(spark, str(tmp_path / "e"), buckets=2, counted=True)
    assert empty.stats(LISTED).first()["total"] == 0
    empty.commit(0, items(spark, []), items(spark, []))
    agree(empty)
    plain = Store.open(spark, str(tmp_path / "p"), buckets=2)
    with pytest.raises(ValueError):
        plain.label_counts()
    assert Store.open(spark, str(tmp_path / "e")).counted and not Store.open(spark, str(tmp_path / "p"), counted=True).counted


@pytest.mark.parametrize("sort", ["newest", "oldest", "importance", None])
def test_pages_are_the_listing(narrow, sort):  # noqa: F811
    rng = random.Random(3)
    made = [item(f"i{k}", f"u{k}", rng.randrange(4), title=rng.choice("ab"), importance_score=rng.randrange(3), status=rng.choice(["active", "archived"])) for k in range(40)]
    table = items(narrow, made).cache()
    whole = [r["id"] for r in Q.sort_items(Q.filter_items(table, status="active"), sort).collect()]
    seen, after = [], None
    while True:
        page = Q.list_page(table, 7, after, sort, status="active").collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        after = page[-1].asDict()
    assert seen == whole
