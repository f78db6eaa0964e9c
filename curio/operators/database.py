"""A database's table of stored rows as the store: keyed lookups, and batches that are merged in one transaction."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.operators.store import apply_edits, upsert_changes
from curio.plans.scratch import cut
from curio.sources.schemas import ITEM_SCHEMA
from curio.sources.tables import pack_items, unpack_items

STORED = "id final_url item status created_at updated_at".split()
SERIALIZABLE = 8  # java.sql.Connection.TRANSACTION_SERIALIZABLE


class Stale(Exception):
    """Someone else changed an item after it was looked up."""


@dataclass(frozen=True)
class Database:
    """A table with the columns of pack_items() that a JDBC driver reaches; the defaults are Postgres's.

    item_out and item_in say how the database gives an item as text and takes one. key_type is the type of ids and URLs
    in staging tables, for databases whose long texts can't be compared. The table needs an index of id and one of
    final_url, so that a lookup costs what the batch costs. A unique constraint on final_url must be deferrable: items
    of one batch may swap URLs. updated_at is an item's version: a writer that changes an item must change it, in the
    item and in its column.
    """

    spark: SparkSession
    url: str
    table: str = "public.items"
    driver: str = "org.postgresql.Driver"
    item_out: str = '"item"::text'
    item_in: str = "{}::jsonb"
    key_type: str | None = None
    parts: int = 16
    tries: int = 5
    options: dict[str, str] = field(default_factory=dict)

    @contextmanager
    def connection(self) -> Iterator[JavaObject]:
        """A connection of the driver's in a transaction of its own: committed at the end, rolled back on any error."""
        jvm = self.spark._jvm
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.driver)
        known = jvm.java.util.Properties()
        for name, value in self.options.items():
            known.setProperty(name, value)
        made = jvm.java.sql.DriverManager.getConnection(self.url, known)
        try:
            made.setAutoCommit(False)
            made.setTransactionIsolation(SERIALIZABLE)
            yield made
            made.commit()
        except BaseException:
            made.rollback()
            raise
        finally:
            made.close()

    def execute(self, *statements: str) -> None:
        with self.connection() as c:
            for text in statements:
                c.createStatement().execute(text)

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[str]:
        """The name of a table with those rows, which Spark's tasks write and which is gone afterwards."""
        name = f"{self.table}_staged_{uuid.uuid4().hex[:12]}"
        keys = [f"{c} {self.key_type}" for c in ("id", "final_url", "looked_for") if c in rows.columns and self.key_type]
        more = {"createTableColumnTypes": ", ".join(keys)} if keys else {}
        try:
            rows.write.format("jdbc").options(url=self.url, dbtable=name, driver=self.driver, numPartitions=self.parts, **more, **self.options).save()
            yield name
        finally:
            with self.connection() as c:
                if c.getMetaData().getTables(None, None, name.rpartition(".")[2].upper(), None).next() or c.getMetaData().getTables(None, None, name.rpartition(".")[2], None).next():
                    c.createStatement().execute(f"drop table {name}")

    def lookup(self, ids: DataFrame | None = None, urls: DataFrame | None = None) -> DataFrame:
        """The items with one of those ids (id) or URLs (final_url), by joins with a staging table of keys in the
        database; `parts` tasks read a share of the keys each."""
        wanted = [d.select(F.lit(c).alias("kind"), F.col(c).alias("looked_for")).where("looked_for is not null").distinct() for d, c in ((ids, "id"), (urls, "final_url")) if d is not None]
        if not wanted:
            return self.spark.createDataFrame([], ITEM_SCHEMA)
        keys = wanted[0] if len(wanted) == 1 else wanted[0].unionByName(wanted[1])
        keys = keys.select(F.when(F.col("kind") == "id", 1).otherwise(0).alias("is_id"), "looked_for", F.pmod(F.xxhash64("looked_for"), F.lit(self.parts)).cast("int").alias("part"))
        columns = ", ".join(f't.{self.item_out} as "item"' if c == "item" else f't."{c}"' for c in STORED)
        with self.staged(keys) as name:
            by = " union all ".join(f'select k."part", {columns} from {name} k join {self.table} t on t."{c}" = k."looked_for" where k."is_id" = {n}' for c, n in (("id", 1), ("final_url", 0)))
            reader = self.spark.read.format("jdbc").options(url=self.url, driver=self.driver, dbtable=f"({by}) x", partitionColumn="part", lowerBound=0, upperBound=self.parts, numPartitions=self.parts, **self.options)
            found = cut(reader.load().drop("part"))
        return unpack_items(found.dropDuplicates(["id"]))

    def merge(self, touched: DataFrame, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """Makes the items `changed` (new or other) and deletes the ids `gone`, all in one statement. touched are the
        items as lookup() gave them. Raises Stale, and changes nothing, if one of them is no longer as it was, or a new
        id or URL is taken by now."""
        seen = touched.select("id", F.col("updated_at").alias("seen"))
        rows = pack_items(changed).withColumn("live", F.lit(1))
        if gone is not None:
            dead = touched.join(gone.select("id").distinct(), "id", "left_semi")
            rows = rows.unionByName(pack_items(dead).withColumn("live", F.lit(0)))
        with self.staged(rows.join(seen, "id", "left")) as name, self.connection() as c:
            for text in self.stale_sql(name):
                found = c.createStatement().executeQuery(text)
                found.next()
                if found.getLong(1):
                    raise Stale(f"{found.getLong(1)} items changed meanwhile")
            c.createStatement().execute(self.merge_sql(name))

    def stale_sql(self, staged: str) -> list[str]:
        """Queries that count the staged rows whose items are not as they were seen, or whose URL is another item's."""
        return [
            f'select count(*) from {staged} s left join {self.table} t on t."id" = s."id" where (s."seen" is null and t."id" is not null) or (s."seen" is not null and (t."id" is null or t."updated_at" <> s."seen"))',
            f'select count(*) from {staged} s join {self.table} t on t."final_url" = s."final_url" left join {staged} o on o."id" = t."id" where s."live" = 1 and o."id" is null',
        ]

    def merge_sql(self, staged: str) -> str:
        value = {c: self.item_in.format('s."item"') if c == "item" else f's."{c}"' for c in STORED}
        return f"""merge into {self.table} t using {staged} s on t."id" = s."id"
            when matched and s."live" = 0 then delete
            when matched then update set {', '.join(f'"{c}" = {value[c]}' for c in STORED if c != 'id')}
            when not matched then insert ({', '.join(f'"{c}"' for c in STORED)}) values ({', '.join(value[c] for c in STORED)})"""

    def _settled(self, attempt: Callable[[], tuple]) -> tuple:
        """attempt's result, tried again where another writer was quicker."""
        for left in reversed(range(self.tries)):
            try:
                return attempt()
            except Stale:
                if not left:
                    raise

    def upsert(self, incoming: DataFrame, created_at_policy: str = "existing") -> tuple[DataFrame, DataFrame]:
        """(conflicts, report) of a batch with seq, taken in as store.upsert_changes() does: only items with one of its
        ids or URLs are read, and only items that change are written. report: imported, created, merged."""
        batch = cut(incoming)

        def attempt():
            touched = cut(self.lookup(batch, batch))
            _, changed, conflicts, report = upsert_changes(touched, batch, created_at_policy)
            self.merge(touched, changed)
            return conflicts, report.select("imported", "created", "merged")

        return self._settled(attempt)

    def edit(self, edits: DataFrame) -> DataFrame:
        """The outcome of a log of edits, see store.apply_edits()."""
        log = cut(edits)

        def attempt():
            touched = cut(self.lookup(log))
            edited, outcome = apply_edits(touched, log)
            after, done = cut(edited), cut(outcome)
            self.merge(touched, after.join(done.where("result = 'done'").select("id").distinct(), "id", "left_semi"), touched.join(after.select("id"), "id", "left_anti"))
            return (done,)

        return self._settled(attempt)[0]
