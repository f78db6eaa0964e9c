import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from curio.operators import query as Q
from curio.operators import store as S
from curio.sources.schemas import EDIT_SCHEMA, ITEM_COLUMNS
from tests.helpers import START, item, items


def fold(store, batch, policy):
    """A store that takes row after row."""
    held, conflicts, created, merged = [dict(r) for r in store], [], 0, 0
    for row in batch:
        by_id = next((h for h in held if h["id"] == row["id"]), None)
        by_url = next((h for h in held if h["final_url"] == row["final_url"]), None)
        if by_id and by_url and by_id is not by_url:
            conflicts.append(row)
        elif by_id:
            by_id.update({**row, "created_at": by_id["created_at"] if policy == "existing" else row["created_at"]})
            merged += 1
        elif by_url:
            by_url.update({**row, "id": by_url["id"], "created_at": by_url["created_at"]})
            merged += 1
        else:
            held.append(dict(row))
            created += 1
    return held, conflicts, created, merged


@pytest.mark.parametrize("policy", ["existing", "incoming_on_id"])
def test_upsert_as_a_sequential_store(spark, policy):
    rng = random.Random(policy)
    key = lambda r: (r["id"], r["final_url"], r["title"], r["created_at"])
    for round_ in range(4):
        # Many small worlds at once: ids and URLs of one world meet only there.
        store, batch = [], []
        for world in range(60):
            n = rng.randint(1, 4)
            for i in range(rng.randint(0, n)):
                store.append(item(f"{round_}-{world}-id{i}", f"https://e.org/{world}/{i}", minutes=len(store), title="old"))
            for _ in range(rng.randint(0, 5)):
                batch.append(item(f"{round_}-{world}-id{rng.randint(0, n)}", f"https://e.org/{world}/{rng.randint(0, n)}", minutes=1000 + len(batch), title=f"t{len(batch)}"))
        want, conflicts, created, merged = fold(store, batch, policy)
        incoming = items(spark, batch).join(spark.createDataFrame([(r["title"], i) for i, r in enumerate(batch)], "title string, seq long"), "title").select(*ITEM_COLUMNS, "seq")
        got, lost, report = S.upsert_items(items(spark, store), incoming, policy)
        assert sorted(map(key, (r.asDict() for r in got.collect()))) == sorted(map(key, want))
        assert sorted(r["title"] for r in lost.collect()) == sorted(r["title"] for r in conflicts)
        r = report.first()
        assert (r["created"], r["merged"], r["total"]) == (created, merged, len(want))


def test_upsert_of_nothing(spark):
    one = items(spark, [item()])
    got, _, report = S.upsert_items(one, one.limit(0).withColumn("seq", F.lit(0)))
    assert got.count() == 1 and report.first().asDict() == {"imported": 0, "created": 0, "merged": 0, "total": 1}


def test_same_url_keeps_id(spark):
    new = items(spark, [item("b", title="new", minutes=5)]).withColumn("seq", F.lit(0))
    got = S.upsert_items(items(spark, [item("a", title="old")]), new)[0].first()
    assert (got["id"], got["title"], got["created_at"]) == ("a", "new", START)


def test_import_fails_on_a_bad_row(spark):
    bad = items(spark, [item("a"), item("b", url="https://e.org/2", title=" 　")]).withColumn("seq", F.monotonically_increasing_id())
    with pytest.raises(ValueError, match="empty title"):
        S.import_items(items(spark, []), bad)


def test_patches(spark):
    store = items(spark, [item("a", notes="n"), item("b", url="https://e.org/2")])
    now = F.lit(START + timedelta(days=1))
    got, missing = S.update_status(store, spark.createDataFrame([("a", "favorite"), ("z", "active")], "id string, status string"), now)
    assert {r["id"]: r["status"] for r in got.collect()} == {"a": "favorite", "b": "active"} and [r["id"] for r in missing.collect()] == ["z"]
    patches = spark.createDataFrame([("a", " 新 ", [" x", "x", ""], None), ("b", " ", ["y"], "q")], "id string, category string, keywords array<string>, notes string")
    rows = {r["id"]: r for r in S.update_metadata(store, patches, now)[0].collect()}
    assert (rows["a"]["category"], rows["a"]["keywords"], rows["a"]["notes"]) == ("新", ["x"], "n") and rows["b"]["category"] == "技术"
    left, found = S.delete_items(store, spark.createDataFrame([("a",), ("z",)], "id string"))
    assert [r["id"] for r in left.collect()] == ["b"] and [r["id"] for r in found.collect()] == ["a"]


def test_covers(spark):
    store = items(spark, [item("a", cover_checked_at=START - timedelta(hours=6)), item("b", url="https://e.org/2", cover_checked_at=START - timedelta(hours=6) + timedelta(seconds=1)), item("c", url="https://e.org/3")])
    assert sorted(r["id"] for r in S.covers_due(store, F.lit(START)).collect()) == ["a", "c"]
    one = items(spark, [item("a", image_url="/media/x.jpg", remote_image_url=" r ")])
    images = spark.createDataFrame([("https://example.org/1", "p")], "url string, image_url string")
    candidates = S.cover_candidates(one, images)
    assert candidates.first()["candidates"] == ["p", "r"]
    fetches = spark.createDataFrame([("p", True, 13 * 1024 * 1024), ("r", True, 5)], "url string, ok boolean, n_bytes long")
    assert S.pick_cover(candidates, fetches).first()["remote_image_url"] == "r"


def test_queries(spark):
    store = items(
        spark,
        [
            item("a", minutes=1, importance_score=10, keywords=["优惠", "k"], author="Ann", content_type="post"),
            item("b", url="https://e.org/2", minutes=2, importance_score=90, category=" 技术　", keywords=["k", "k"]),
            item("c", url="https://e.org/3", minutes=3, status="archived", category=""),
        ],
    )
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(Q.sort_items(store, "oldest")) == ["a", "b", "c"] and ids(Q.sort_items(store, "?")) == ["c", "b", "a"] and ids(Q.sort_items(store, "importance")) == ["b", "c", "a"]
    assert ids(Q.filter_items(store, query=" ANN post ")) == ["a"] and ids(Q.filter_items(store, query=" ", status="archived", category="")) == ["c"]
    assert [tuple(r) for r in Q.count_categories(store).collect()] == [("技术", 2)]
    assert [tuple(r) for r in Q.count_keywords(store).collect()] == [("k", 3), ("a", 1), ("优惠", 1)]
    digest = Q.collection_digest(store, F.lit(START)).first()
    assert digest["total"] == 2 and "技术 2" in digest["focus_summary"] and digest["suggestions"] == ["含优惠/券相关内容，建议在过期前集中检查。"] and [r["id"] for r in digest["recent_items"]] == ["b", "a"]
    empty = Q.collection_digest(store.limit(0), F.lit(START)).first()
    assert empty["total"] == 0 and empty["recent_items"] == [] and "还没有" in empty["focus_summary"] and len(empty["suggestions"]) == 1
    block = Q.export_markdown(store).first()["block"]
    assert block.startswith("### Title\n\n- Platform: GitHub\n") and "- Created: 2024-01-01 00:03:00 UTC\n" in block
    assert "- Total stored items: 3" in Q.markdown_header(store, F.lit(START)).first()["header"]


def test_long_chains_are_one_component(spark):
    """a1-u1, a1-u2, a2-u2, a2-u3, ...: one tangled component, found in few rounds, folded in order."""
    rows_in = [item(f"a{k // 2:03d}", f"u{(k + 1) // 2:03d}", title=str(k)) for k in range(80)]
    pairs = spark.createDataFrame([(r["id"], r["final_url"]) for r in rows_in], "id string, final_url string")
    labels = {r["component"] for r in S._tangled_labels(pairs).collect()}
    assert labels == {"a000"}


def sequential(rows, edits):
    """A store that takes one edit after another."""
    store, told = {r["id"]: dict(r) for r in rows}, {}
    for e in sorted(edits, key=lambda e: e["seq"]):
        tidy = lambda t: None if t is None else t.strip()
        bad = e["kind"] == "like" or (e["kind"] == "status" and e["status"] not in ("active", "archived", "favorite")) or (e["kind"] == "metadata" and tidy(e["category"]) == "")
        item = store.get(e["id"])
        told[e["seq"]] = "rejected" if bad else "missing" if item is None else "done"
        if told[e["seq"]] != "done":
            continue
        if e["kind"] == "delete":
            del store[e["id"]]
            continue
        new = {"status": {"status": e["status"]}, "metadata": {"category": tidy(e["category"]), "keywords": e["keywords"] and [k for k in dict.fromkeys(x.strip() for x in e["keywords"]) if k][:20], "notes": tidy(e["notes"])}}
        given = new.get(e["kind"]) or {c: e[c] for c in ("image_url", "remote_image_url", "cover_cached_at", "cover_checked_at")}
        item.update({k: v for k, v in given.items() if v is not None} | {"updated_at": e["at"]})
    return store, told


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_edits_as_one_after_another(spark, seed):
    rng = random.Random(seed)
    rows = [item(f"i{k}", f"https://example.org/{k}", k) for k in range(30)]
    some = lambda *values: rng.choice([None, *values])
    names = EDIT_SCHEMA.fieldNames()
    edits = []
    for seq in rng.sample(range(10_000), 400):
        at = START + timedelta(hours=seq)
        edits.append({
            "seq": seq, "id": f"i{rng.choice([0, 0, 0, rng.randrange(40)])}", "kind": rng.choices(["status", "metadata", "cover", "delete", "like"], [9, 9, 9, 1, 1])[0], "status": some("active", "archived", "favorite", "gone"), "category": some(" 新 ", "b", "　"),
            "keywords": some(["a", " a", " "], [], [str(k) for k in range(30)]), "notes": some("", " n "), "image_url": some("x", "y"), "remote_image_url": some("z"), "cover_cached_at": some(at), "cover_checked_at": at, "at": at,
        })
    log = spark.createDataFrame([tuple(e[c] for c in names) for e in edits], EDIT_SCHEMA).repartition(3)
    got, told = S.apply_edits(items(spark, rows), log)
    want, results = sequential(rows, edits)
    assert {r["id"]: r.asDict() for r in got.collect()} == want
    assert {r["seq"]: r["result"] for r in told.collect()} == results


def test_two_patches_of_one_id(spark):
    stored = items(spark, [item("i1"), item("i2", "https://example.org/2")])
    now = F.lit(START + timedelta(days=9))
    patches = spark.createDataFrame([(1, "i1", "c", None), (2, "i1", None, "n"), (3, "i9", "x", None)], "seq int, id string, category string, notes string").withColumn("keywords", F.lit(None).cast("array<string>"))
    got, missing = S.update_metadata(stored, patches, now)
    assert {r["id"]: (r["category"], r["notes"]) for r in got.collect()} == {"i1": ("c", "n"), "i2": ("技术", "")} and [r["id"] for r in missing.collect()] == ["i9"]
    states = spark.createDataFrame([(1, "i1", "archived"), (2, "i1", "favorite")], "seq int, id string, status string")
    assert S.update_status(stored, states, now)[0].where("id = 'i1'").first()["status"] == "favorite"
    with pytest.raises(Exception, match="need a seq"):
        S.update_status(stored, states.drop("seq"), now)[0].collect()
