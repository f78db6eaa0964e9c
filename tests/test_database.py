import random
from dataclasses import replace
from datetime import timedelta

import pytest

from curio.operators.database import Database, Stale
from curio.operators.store import upsert_items
from curio.sources.schemas import EDIT_SCHEMA
from curio.sources.tables import read_items_jdbc
from tests.helpers import START, item, items
from tests.test_addressed import batch_of, narrow, rows  # noqa: F401
from tests.test_store import sequential

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "key_type": "varchar(200)", "item_out": '"item"', "item_in": "{}", "parts": 2}


class Watched(Database):
    """Someone else writes between the lookup and the merge, once for each statement given."""

    meanwhile: list = []

    def merge(self, *args):
        if self.meanwhile:
            self.meanwhile.pop()()
        super().merge(*args)


@pytest.fixture
def base(narrow, tmp_path):  # noqa: F811
    made = Watched(narrow, f"jdbc:derby:{tmp_path}/db;create=true", "stored", **DERBY)
    made.execute('create table stored ("id" varchar(200) primary key, "final_url" varchar(200) not null, "item" clob check (length("item") < 5000), "status" clob, "created_at" timestamp, "updated_at" timestamp)', 'create index by_url on stored ("final_url")')
    return made


def whole(base):
    return read_items_jdbc(base.spark, base.url, base.table, driver=base.driver, item=base.item_out)


def tables(base):
    with base.connection() as c:
        found, out = c.getMetaData().getTables(None, "APP", None, None), []
        while found.next():
            out.append(found.getString(3))
        return out


def test_batches_and_edits_in_a_database(base):
    """As the store in memory: moves, merges by URL, conflicts; then a log of edits with deletions."""
    spark, rng = base.spark, random.Random(11)
    plain = items(spark, [])
    for n in range(3):
        made = [item(f"i{rng.randrange(12)}", f"https://example.org/{rng.randrange(12)}", n, title=f"t{n}-{k}") for k in range(8)]
        batch = batch_of(spark, made)
        want, lost, told = upsert_items(plain, batch)
        plain = spark.createDataFrame(want.collect(), want.schema)
        conflicts, report = base.upsert(batch)
        assert rows(conflicts) == rows(lost) and rows(report) == rows(told.select("imported", "created", "merged"))
        assert rows(whole(base)) == rows(plain)
    ids = plain.select("id").limit(2)
    assert rows(base.lookup(ids=ids)) == rows(plain.join(ids, "id", "left_semi"))
    names = EDIT_SCHEMA.fieldNames()
    edits = [dict.fromkeys(names) | {"seq": s, "id": f"i{rng.randrange(14)}", "kind": rng.choice(["status", "metadata", "delete"]), "status": "archived", "notes": f"n{s}", "at": START + timedelta(days=s)} for s in range(12)]
    told = base.edit(spark.createDataFrame([tuple(e[c] for c in names) for e in edits], EDIT_SCHEMA))
    want, results = sequential([r.asDict() for r in plain.collect()], edits)
    assert {r["id"]: r.asDict() for r in whole(base).collect()} == want and {r["seq"]: r["result"] for r in told.collect()} == results
    assert tables(base) == ["STORED"]


def test_another_writer_and_a_failure(base):
    """A batch that comes too late is tried again on what is there now; a failing statement leaves all as it was."""
    spark = base.spark
    base.upsert(batch_of(spark, [item("a", "https://example.org/a", title="1"), item("b", "https://example.org/b", title="2")]))
    other = Database(spark, base.url, "stored", **DERBY)
    Watched.meanwhile = [lambda: other.upsert(batch_of(spark, [item("b", "https://example.org/c", 5, title="by another")]))]
    base.upsert(batch_of(spark, [item("z", "https://example.org/b", 9, title="3")]))
    assert {r["id"]: r["title"] for r in whole(base).collect()} == {"a": "1", "b": "by another", "z": "3"} and not Watched.meanwhile
    Watched.meanwhile = [lambda: base.execute("""delete from stored where "id" = 'a'""")]
    base.upsert(batch_of(spark, [item("n", "https://example.org/a", 9, title="4")]))
    assert {r["id"]: r["title"] for r in whole(base).collect()} == {"n": "4", "b": "by another", "z": "3"}
    before = rows(whole(base))
    with pytest.raises(Exception, match="(?i)check constraint"):
        base.upsert(batch_of(spark, [item("b", "https://example.org/b", 9, title="5"), item("x", "https://example.org/x", title="6", notes="n" * 6000)]))
    assert rows(whole(base)) == before and tables(base) == ["STORED"]
    # A writer that changes the row's time but not the item's: the item can't be told to be the one that was read.
    base.execute("""update stored set "updated_at" = {ts '2024-05-05 00:00:00'} where "id" = 'b'""")
    with pytest.raises(Stale):
        replace(base, tries=2).upsert(batch_of(spark, [item("b", "https://example.org/b", 9, title="7")]))
    assert {r["id"]: r["title"] for r in whole(base).collect()} == {"n": "4", "b": "by another", "z": "3"} and tables(base) == ["STORED"]
