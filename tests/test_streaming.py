import glob
import json
import os
import shutil

from pyspark.sql import functions as F

from curio.operators import items as I
from curio.operators import store as S
from curio.operators.store import upsert_items
from curio.sources.schemas import ITEM_SCHEMA, PAGE_SCHEMA
from curio.streaming.ingest import compact, ingest, ingest_waiting, load, read_page_stream, read_share_stream
from tests.helpers import START, item, items


def shares(folder, batches):
    os.makedirs(folder)
    for k, rows in enumerate(batches):
        at = f"{folder}/{k}.json"
        with open(at, "w") as f:
            f.writelines(json.dumps({"shared_text": t, "source_app": "app"}, ensure_ascii=False) + "\n" for t in rows)
        os.utime(at, (1_700_000_000 + k, 1_700_000_000 + k))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_stream_is_the_batch_and_replays_change_nothing(spark, tmp_path):
    texts = [["看 https://github.com/a/b", "https://example.org/1"], ["again https://example.org/1", "b23.tv/x and https://github.com/a/b"], [], ["https://example.org/3 last", "no link"]]
    shares(str(tmp_path / "in"), texts)
    pages = spark.createDataFrame([("https://github.com/a/b", "https://github.com/a/b", 200, "<title>Repo page</title>", None), ("https://example.org/3", "https://example.org/1", 200, "<title>Moved to one</title>", None)], PAGE_SCHEMA)
    store, check = str(tmp_path / "store"), str(tmp_path / "check")
    run = lambda: ingest(read_share_stream(spark, str(tmp_path / "in"), 1), lambda: pages, store, check, lambda: F.lit(START)).awaitTermination()
    run()
    # The same shares at once: row after row, as the stream took them.
    whole = spark.createDataFrame([(None, t, "app", k) for k, t in enumerate(t for b in texts for t in b)], "url string, shared_text string, source_app string, seq long")
    want, _, _ = upsert_items(spark.createDataFrame([], ITEM_SCHEMA), I.ingest_shares(whole, pages, F.lit(START)))
    assert rows(load(spark, store)) == rows(want) and want.count() == 3
    # A batch holds what it touched, no more.
    sizes = {p: spark.read.parquet(p).count() for p in glob.glob(f"{store}/items/batch=*") if glob.glob(f"{p}/bucket=*")}
    assert sum(sizes.values()) == 2 + 3 + 1
    # The last batch again, as after a failure before it was noted down.
    done = sorted(int(os.path.basename(p)) for p in glob.glob(f"{check}/commits/[0-9]*"))
    os.remove(f"{check}/commits/{done[-1]}")
    for crc in glob.glob(f"{check}/commits/.{done[-1]}.crc"):
        os.remove(crc)
    before = rows(load(spark, store))
    run()
    assert rows(load(spark, store)) == before
    compact(spark, store, str(tmp_path / "new"))
    assert rows(load(spark, str(tmp_path / "new"))) == before
    shutil.rmtree(tmp_path / "new")


def test_upsert_changes_leaves_the_rest(spark):
    store = items(spark, [item("a", "https://e.org/1"), item("b", "https://e.org/2"), item("c", "https://e.org/3")])
    batch = items(spark, [item("x", "https://e.org/2", title="new"), item("y", "https://e.org/9")]).withColumn("seq", F.when(F.col("id") == "x", 0).otherwise(1))
    untouched, changed, conflicts, report = S.upsert_changes(store, batch)
    assert {r["id"] for r in untouched.collect()} == {"a", "c"} and {(r["id"], r["title"]) for r in changed.collect()} == {("b", "new"), ("y", "Title")}
    assert conflicts.count() == 0 and report.first()["total"] == 4


def test_tangled_fold_follows_moves(spark):
    """An item that moves to another URL frees its old one; the rows of one component, one after another."""
    rows_in = [item("a", "u1", title="1"), item("b", "u2", title="2"), item("a", "u3", title="3"), item("c", "u1", title="4"), item("a", "u2", title="5"), item("d", "u3", title="6")]
    batch = None
    for k, r in enumerate(rows_in):
        one = items(spark, [r]).withColumn("seq", F.lit(k))
        batch = one if batch is None else batch.union(one)
    store, conflicts, _ = upsert_items(spark.createDataFrame([], ITEM_SCHEMA), batch)
    assert {(r["id"], r["final_url"], r["title"]) for r in store.collect()} == {("a", "u3", "6"), ("b", "u2", "2"), ("c", "u1", "4")}
    assert [(r["id"], r["final_url"]) for r in conflicts.collect()] == [("a", "u2")]


def land(spark, folder, name, at, pages):
    """Fetches as one file that landed at that second."""
    spark.createDataFrame(pages, PAGE_SCHEMA).coalesce(1).write.parquet(f"{folder}-{name}")
    (part,) = glob.glob(f"{folder}-{name}/*.parquet")
    os.makedirs(folder, exist_ok=True)
    os.utime(part, (at, at))
    shutil.move(part, f"{folder}/{name}.parquet")


def share(folder, name, at, *texts):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps({"shared_text": t, "source_app": "app"}) + "\n" for t in texts)
    os.utime(f"{folder}/{name}.json", (at, at))


def test_shares_wait_for_their_pages(spark, tmp_path):
    """Either order of arrival gives the same store; what never lands gets its note, and state goes, after the bound."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    at, hour = 1_700_000_000, 3_600
    page = ("https://example.org/1", "https://example.org/moved", 200, "<title>The page's title</title>", None)
    stores = {}
    try:
        for order in ("share first", "page first"):
            base = str(tmp_path / order.replace(" ", "-"))
            folders = [f"{base}/shares", f"{base}/pages"]
            for f in folders:
                os.makedirs(f)

            def run():
                stream = ingest_waiting(read_share_stream(spark, folders[0]), read_page_stream(spark, folders[1]), f"{base}/store", f"{base}/check", now=lambda: F.lit(START), buckets=2)
                stream.awaitTermination()
                return stream

            steps = [lambda: share(folders[0], "a", at, "https://example.org/1", "https://example.org/never"), lambda: land(spark, folders[1], "a", at + 60, [page])]
            for step in steps if order == "share first" else steps[::-1]:
                step()
                run()
            assert {r["final_url"]: r["title"] for r in load(spark, f"{base}/store").collect()} == {"https://example.org/moved": "The page's title"}
            if order == "share first":  # nothing of the first hour is waited for any more
                share(folders[0], "z", at + 9 * hour, "https://example.org/z")
                land(spark, folders[1], "z", at + 9 * hour, [("https://example.org/z", "https://example.org/z", 200, "", None)])
                last = run().recentProgress
                found = {r["final_url"]: r for r in load(spark, f"{base}/store").collect()}
                assert set(found) == {f"https://example.org/{x}" for x in ("moved", "never", "z")} and "no landed page" in found["https://example.org/never"]["description"]
                assert last[-1].stateOperators[0].numRowsTotal <= 4  # what came in the last hours
            stores[order] = rows(load(spark, f"{base}/store").where("final_url like '%moved'"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert stores["share first"] == stores["page first"]
