import glob
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from curio.functions import classify as C
from curio.operators import query as Q
from curio.sources import tables as R
from curio.sources.schemas import ITEM_COLUMNS
from tests.helpers import START, item, items


def test_json_export_is_one_document(spark, tmp_path):
    store = items(spark, [item(f"i{k}", f"https://e.org/{k}", minutes=k % 3, title=f'T "{k}"\n', status="archived" if k == 2 else "active") for k in range(7)])
    Q.write_export_json(store, str(tmp_path / "x"), F.lit(START))
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/x/part-*")))
    doc = json.loads(text)
    assert doc["schema_version"] == 1 and doc["item_count"] == 7 and doc["digest"]["total"] == 6 and doc["digest"]["recent_items"][0]["id"] == "i5"
    assert [x["id"] for x in doc["items"]] == [r["id"] for r in Q.sort_items(store).collect()] and set(doc["items"][0]) == set(store.columns)
    Q.write_export_json(store.limit(0), str(tmp_path / "none"), F.lit(START))
    assert json.loads("".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/none/part-*"))))["items"] == []


def test_replies_are_typed(spark):
    good = {"summary": "s", "category": "c", "keywords": ["k", " "], "entities": [], "sentiment": "x", "content_type": "y", "importance_score": 130, "notes": ""}
    bad = [
        {**good, "summary": 5}, {**good, "summary": None}, {**good, "keywords": [1, 2]}, {**good, "keywords": "k"}, {**good, "keywords": ["k", None]}, {**good, "sentiment": True}, {**good, "importance_score": 50.0}, {**good, "importance_score": 256},
        {**good, "importance_score": -1}, {**good, "importance_score": "5"}, {**good, "notes": {}}, {k: v for k, v in good.items() if k != "notes"}, [], None, "text",
    ]
    texts = [json.dumps(good), json.dumps({**good, "more": [1]}), *map(json.dumps, bad), json.dumps(good) + " and", json.dumps(good) + "," + json.dumps(good), "{", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r["a"] for r in rows.select("i", C.normalize_analysis("t").alias("a")).collect()}
    assert got[0] == got[1] and got[0]["importance_score"] == 100 and got[0]["keywords"] == ["k"] and [i for i in got if got[i] is not None] == [0, 1]


def test_search_field_by_field(spark):
    store = items(spark, [item("a", title="Ünder the SUN"), item("b", keywords=["x", "sunny"]), item("c", content_text="no"), item("d", author="the", content_type="sun")])
    found = lambda q: {r["id"] for r in Q.search_items(store, q).collect()}
    assert found(" sun ") == {"a", "b", "d"} and found("THE sun") == {"a", "d"} and found("x sunny") == {"b"} and found("") == {"a", "b", "c", "d"} and found("zzz") == set()


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    store = items(spark, [item("a", author=None, keywords=["k", "优惠"]), item("b", "https://e.org/2", minutes=5)])
    try:
        R.write_items_jdbc(store, url, "staging", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception as e:  # the driver is one of Spark's own jars, but not of every build
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip("no embedded database")
        raise
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "item": '"item"'}
    assert sorted(map(repr, R.read_items_jdbc(spark, url, "staging", **options).collect())) == sorted(map(repr, store.collect()))
    split = R.read_items_jdbc(spark, url, "staging", parts=3, bounds=("2024-01-01 00:00:00", "2024-01-02 00:00:00"), **options)
    assert split.count() == 2 and split.rdd.getNumPartitions() == 3


def test_one_array_in_parts(spark, tmp_path):
    """Braces, quotes and backslashes in texts; files cut into parts of a few hundred bytes."""
    odd = ["}", "{", '"', "\\", '\\"}', "]}", "},{", "[", "é\n", "a", ":", '"items":[']
    rng = random.Random(4)
    made = [item(f"i{k}", f"https://example.org/{k}", k, title="".join(rng.choice(odd) for _ in range(rng.randint(0, 12))) or "t", notes="".join(rng.choice(odd) for _ in range(6)), keywords=["}", "{"], original_text="") for k in range(60)]
    form = lambda r: {k: (v.isoformat() + "Z" if isinstance(v, datetime) else v) for k, v in r.items()}
    for folder, value in (("bare", [form(r) for r in made]), ("envelope", {"digest": {"recent": [{"a": "}"}], "n": 1}, "items": [form(r) for r in made], "schema_version": 1}), ("pretty", {"schema_version": 1, "items": [form(r) for r in made]})):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.json").write_text(json.dumps(value, ensure_ascii=folder == "bare", indent=2 if folder == "pretty" else None))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        bare = R.read_items_array(spark, str(tmp_path / "bare")).collect()
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "bare")).rdd.getNumPartitions() > 4
        backups = [R.read_backup_parts(spark, str(tmp_path / f)).collect() for f in ("envelope", "pretty")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for got in (bare, *backups):
        assert [{k: r[k] for k in ITEM_COLUMNS} for r in sorted(got, key=lambda r: r["seq"])] == made and [r["seq"] for r in sorted(got, key=lambda r: r["seq"])] == list(range(60))
    assert all(r["schema_version"] == 1 for got in backups for r in got)
    (tmp_path / "bare" / "x.json").write_text("[]")
    assert R.read_items_array(spark, str(tmp_path / "bare")).count() == 0
