"""What a batch of the store leaves on disk besides the store, and what a reader leaves besides its file."""

import glob
import json
import os
import random
from datetime import datetime

from pyspark.sql import functions as F

from curio.operators.addressed import Store
from curio.plans.scratch import folder
from curio.sources import tables as R
from curio.sources.schemas import EDIT_SCHEMA
from tests.helpers import item, items
from tests.test_addressed import batch_of, narrow, rows  # noqa: F401


def size(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f))


def test_batches_leave_no_copies(narrow, tmp_path):  # noqa: F811
    """New items, changed and deleted ones, whole buckets: texts are in the store, and nowhere besides."""
    spark, rng = narrow, random.Random(6)
    text = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(20_000))
    made = {f"i{k}": item(f"i{k}", f"https://example.org/{k}", k, title=f"t{k}", content_text=text()) for k in range(30)}
    store = Store.open(spark, str(tmp_path / "s"), buckets=2, counted=True, deltas=1)
    held = folder(spark).removeprefix("file:")
    before, scratch = size(held), {}
    store.commit(0, items(spark, []), items(spark, list(made.values())[:20]))
    scratch["commit"], written = size(held) - before, size(tmp_path / "s" / "items")
    anew = {k: made[k] | {"title": f"anew {k}"} for k in ("i1", "i2")}
    conflicts, changed = store.upsert(1, batch_of(spark, [*list(made.values())[20:], *anew.values()]))
    scratch["upsert"] = size(held) - before
    names = EDIT_SCHEMA.fieldNames()
    edits = [dict.fromkeys(names) | {"seq": 1, "id": "i3", "kind": "delete"}, dict.fromkeys(names) | {"seq": 2, "id": "i4", "kind": "status", "status": "archived"}]
    told = store.edit(2, spark.createDataFrame([tuple(e[c] for c in names) for e in edits], EDIT_SCHEMA))
    scratch["edit"] = size(held) - before
    assert max(scratch.values()) < written / 10, (scratch, written)
    # A bucket written whole: its older items stay, those that changed are there once, and what came back can be read on.
    assert conflicts.count() == 0 and {r["id"] for r in changed.collect()} == {*list(made)[20:], "i1", "i2"} and told.count() == 2
    want = made | anew
    assert {r["id"]: (r["title"], r["content_text"]) for r in store.load().collect()} == {k: (v["title"], v["content_text"]) for k, v in want.items() if k != "i3"}
    assert store.folders("items").where("id = 'i1'").count() == 1 and rows(store.lookup(ids=store.load().select("id"))) == rows(store.load())
    assert store.load().where(F.col("status") == "archived").select("id").first()["id"] == "i4"


def test_one_array_is_copied_once(narrow, tmp_path):  # noqa: F811
    """Reading a backup in parts writes its texts once; only those of elements in several cuts are moved."""
    spark, rng = narrow, random.Random(7)
    text = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    made = [item(f"i{k}", f"https://example.org/{k}", k, original_text=text() + ("}{" if k % 10 == 0 else "")) for k in range(60)]
    form = lambda r: {k: (v.isoformat() + "Z" if isinstance(v, datetime) else v) for k, v in r.items()}
    (tmp_path / "x.json").write_text(json.dumps({"schema_version": 1, "items": [form(r) for r in made]}))
    held = folder(spark).removeprefix("file:")
    before = size(held)
    got = R.read_backup_parts(spark, str(tmp_path / "x.json")).collect()
    assert size(held) - before < os.path.getsize(tmp_path / "x.json") * 1.2
    assert [(r["id"], r["original_text"], r["schema_version"]) for r in sorted(got, key=lambda r: r["seq"])] == [(m["id"], m["original_text"], 1) for m in made]
