import os
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from curio.operators.addressed import Store
from curio.operators.store import upsert_items
from curio.sources.schemas import EDIT_SCHEMA
from tests.helpers import START, item, items
from tests.test_store import sequential


def rows(df):
    return sorted(map(repr, df.collect()))


def batch_of(spark, made):
    return items(spark, made).withColumn("seq", F.element_at(F.create_map(*[x for k, r in enumerate(made) for x in (F.lit(r["title"]), F.lit(k))]), F.col("title")))


@pytest.fixture(scope="module")
def narrow(spark):
    """Few partitions: many small jobs."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_batches_as_one_table(narrow, tmp_path):
    """Batch after batch as the upsert of the whole store, with moves, conflicts, bases and full manifests; replays."""
    spark, rng = narrow, random.Random(7)
    store = Store.open(spark, str(tmp_path / "s"), buckets=3, deltas=2, full_every=2)
    plain = items(spark, [])
    for n in range(4):
        made = [item(f"i{rng.randrange(12)}", f"https://example.org/{rng.randrange(12)}", n, title=f"t{n}-{k}") for k in range(6)]
        batch = batch_of(spark, made)
        want, lost, _ = upsert_items(plain, batch)
        conflicts, _ = store.upsert(n, batch)
        plain = spark.createDataFrame(want.collect(), want.schema)
        assert rows(conflicts) == rows(lost)
        assert rows(store.load()) == rows(plain)
    assert {r["n"] for r in store.manifest().groupBy("kind", "bucket").agg(F.count("*").alias("n")).collect()} <= {1, 2, 3}
    before = rows(store.load())
    store.upsert(3, batch)
    assert rows(store.load()) == before
    assert rows(store.lookup(urls=plain.select("final_url"))) == before and rows(store.lookup(ids=plain.select("id").limit(1))) == rows(plain.limit(1))
    gone = store.vacuum(4)
    assert gone and rows(store.load()) == before and rows(store.lookup(urls=plain.select("final_url"))) == before
    assert rows(store.rehash(str(tmp_path / "wide"), 8).load()) == before


def test_files_of_a_batch_do_not_grow_with_the_store(narrow, tmp_path):
    spark = narrow
    batch = batch_of(spark, [item(f"i{k}", f"https://example.org/{k}", title=f"new {k}") for k in range(4)])
    read = {}
    for size in (100, 1000):
        store = Store.open(spark, str(tmp_path / str(size)), buckets=128)
        none = items(spark, [])
        store.commit(0, none, items(spark, [item(f"i{k}", f"https://example.org/{k}") for k in range(size)]))
        hit = lambda key: batch.select(store.bucket(key).alias("bucket"))
        read[size] = [len(store.read(kind, hit(key)).inputFiles()) for kind, key in (("items", "id"), ("urls", "final_url"))]
        store.commit(1, store.lookup(ids=batch), batch.drop("seq"))
        written = sum(len([f for f in names if f.endswith(".parquet")]) for kind in ("items", "urls") for _, _, names in os.walk(f"{store.path}/{kind}/batch=1"))
        assert written <= 8
    assert read[1000] == read[100] or max(read[1000]) <= 4
    assert max(read[1000]) <= 4


def test_edits_of_a_store(narrow, tmp_path):
    spark, rng = narrow, random.Random(2)
    made = [item(f"i{k}", f"https://example.org/{k}", k) for k in range(20)]
    store = Store.open(spark, str(tmp_path / "s"), buckets=4)
    store.upsert(0, batch_of(spark, [m | {"title": f"t{k}"} for k, m in enumerate(made)]))
    made = [m | {"title": f"t{k}"} for k, m in enumerate(made)]
    names = EDIT_SCHEMA.fieldNames()
    edits = [dict.fromkeys(names) | {"seq": s, "id": f"i{rng.randrange(24)}", "kind": rng.choice(["status", "metadata", "delete", "metadata"]), "status": "archived", "notes": f"n{s}", "at": START + timedelta(days=s)} for s in range(30)]
    told = store.edit(1, spark.createDataFrame([tuple(e[c] for c in names) for e in edits], EDIT_SCHEMA))
    want, results = sequential(made, edits)
    assert {r["id"]: r.asDict() for r in store.load().collect()} == want and {r["seq"]: r["result"] for r in told.collect()} == results
    # The URL of an item that is gone is free for another one.
    dead = next(f"i{k}" for k in range(20) if f"i{k}" not in want)
    store.upsert(2, batch_of(spark, [item("new", f"https://example.org/{dead[1:]}", title="again")]))
    assert store.lookup(ids=spark.createDataFrame([("new",)], "id string")).first()["title"] == "again"
