"""A store addressed by hash: items in buckets of their id, keys in buckets of their final URL, a manifest of batches.

A batch reads the buckets that its ids and URLs fall into and writes the same buckets, so what it costs depends on the
batch, not on the store. Tables are plain Parquet folders:

    layout/                          one row: the number of buckets
    items/batch=<n>/bucket=<b>/      items that batch n made, changed or deleted (live = false); in files of a base, older ones too (fresh = false)
    urls/batch=<n>/bucket=<b>/       (final_url, id, live): whose URL it is since batch n, or no one's
    labels/batch=<n>/bucket=<b>/     if the store is counted: (status, dim, label, n), what batch n adds to a count or takes from it
    recent/batch=<n>/bucket=0/       if it is counted: the newest active items after batch n, a bounded number
    manifest/delta=<n>/, full=<n>/   (kind, bucket, batch, base): the folders that batch n wrote; now and then all that count

A folder marked base has all rows of its bucket, so older ones of that bucket no longer count. A bucket with `deltas`
folders is written as a base by the next batch that reads it anyway: a bucket is never more than deltas + 1 folders.

A counted store keeps the counts of its labels up to date: a batch takes the labels of the items as they were from the
counts and adds those of the items as they are. label_counts(), stats() and digest() read counts, not items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.functions import lists
from curio.operators import query as Q
from curio.operators.store import apply_edits, upsert_changes
from curio.plans.scratch import PACKED, cut, passing
from curio.sources.schemas import ITEM_COLUMNS, ITEM_SCHEMA

LIVE = T.StructField("live", T.BooleanType())
KINDS = {
    "items": ("id", T.StructType([*ITEM_SCHEMA.fields, LIVE])),
    "urls": ("final_url", T.StructType([T.StructField("final_url", T.StringType()), T.StructField("id", T.StringType()), LIVE])),
    "labels": ("label", T.StructType([*[T.StructField(c, T.StringType()) for c in ("status", "dim", "label")], T.StructField("n", T.LongType())])),
    # A row without an id has the floor: the place in the order down to which all active items are there; null: all are.
    "recent": ("id", T.StructType([ITEM_SCHEMA[c] for c in "id title platform category summary created_at".split()])),
}
#: The dimension under which items themselves are counted.
ITEMS = "item"
#: What stats() takes for all statuses but 'archived'.
LISTED = "active or favorite"


def label_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(status, dim, label, n): by how much counts change when the items `before` become those `after`."""
    own = lambda items: Q.label_rows(items, "status").unionByName(items.select("status", F.lit(ITEMS).alias("dim"), F.lit("").alias("label")))
    both = own(after).withColumn("n", F.lit(1)).unionByName(own(before).withColumn("n", F.lit(-1)))
    return both.groupBy("status", "dim", "label").agg(F.sum("n").alias("n")).where("n <> 0")
MANIFEST = T.StructType([T.StructField("kind", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("base", T.BooleanType())])
PLACES = [T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The n of the folders <name>=<n> in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(x.removeprefix(f"{name}=")) for x in found if x.startswith(f"{name}="))


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    buckets: int
    deltas: int = 8
    full_every: int = 16
    counted: bool = False
    #: Of the newest active items `keep` are held; with fewer than `least` left, they are looked up among all items.
    keep: int = 1024
    least: int = 64

    @staticmethod
    def open(spark: SparkSession, path: str, buckets: int = 64, counted: bool = False, **more) -> Store:
        """The store of a folder, with the number of buckets that it was made with; a new one is made with `buckets`.
        Some hundred thousand items a bucket are fine; rehash() makes a store with more buckets of one that has grown.
        Whether a store is counted is settled when it is made, too; rehash() can make a counted one of one that is not."""
        layout = f"{path}/layout"
        at = spark._jvm.org.apache.hadoop.fs.Path(layout)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(counted).alias("counted")).write.parquet(layout)
        made = spark.read.schema("buckets int, counted boolean").parquet(layout).first()
        return Store(spark, path, made["buckets"], counted=bool(made["counted"]), **more)

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def manifest(self, before: int | None = None) -> DataFrame:
        """The folders that count, of the batches before that number if one is given."""
        at = f"{self.path}/manifest"
        ok = lambda n: before is None or n < before
        full = max(filter(ok, _numbers(self.spark, at, "full")), default=None)
        parts = [f"{at}/full={full}"] if full is not None else []
        parts += [f"{at}/delta={n}" for n in _numbers(self.spark, at, "delta") if ok(n) and (full is None or n > full)]
        if not parts:
            return self.spark.createDataFrame([], MANIFEST)
        base = F.max(F.when(F.col("base"), F.col("batch"))).over(W.partitionBy("kind", "bucket"))
        rows = self.spark.read.schema(MANIFEST).parquet(*parts).withColumn("_base", base)
        return rows.where("_base is null or batch >= _base").drop("_base")

    def read(self, kind: str, hit: DataFrame, before: int | None = None) -> DataFrame:
        """All rows of the buckets in hit (bucket), with batch and bucket. Only their folders are listed and read: as many
        as buckets are hit, times deltas + 1 at most."""
        schema = T.StructType([*KINDS[kind][1].fields, *PLACES])
        folders = self.manifest(before).where(F.col("kind") == kind).join(hit.select("bucket").distinct(), "bucket").select("batch", "bucket").collect()
        if not folders:
            return self.spark.createDataFrame([], schema)
        root = f"{self.path}/{kind}"
        return self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/batch={r['batch']}/bucket={r['bucket']}" for r in folders])

    def latest(self, kind: str, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Of each key the row of the latest batch, also if it is not live; of labels the sums over all batches. With
        columns, which hold the key, only those are moved."""
        key, schema = KINDS[kind]
        if columns:
            schema = T.StructType([schema[c] for c in columns])
        if kind == "labels":
            return rows.groupBy("status", "dim", "label", "bucket").agg(F.sum("n").alias("n")).select(*schema.fieldNames(), "bucket")
        rest = [c for c in schema.fieldNames() if c != key]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest, "bucket"), "batch").alias("_r"))
        return newest.select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in [*schema.fieldNames(), "bucket"]])

    def lookup(self, ids: DataFrame | None = None, urls: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The items with one of those ids (id) or URLs (final_url). Rows that are not asked for are left out before
        anything wide is moved."""
        wanted = ids.select("id") if ids is not None else None
        if urls is not None:
            keys = cut(urls.select("final_url").distinct())
            held = self.read("urls", keys.select(self.bucket("final_url").alias("bucket")), before).join(keys, "final_url", "left_semi")
            owners = self.latest("urls", held).where("live").select("id")
            wanted = owners if wanted is None else wanted.union(owners)
        wanted = cut(wanted.distinct())
        rows = self.read("items", wanted.select(self.bucket("id").alias("bucket")), before).join(wanted, "id", "left_semi")
        return self.latest("items", rows).where("live").select(*ITEM_COLUMNS)

    def folders(self, kind: str, before: int | None = None) -> DataFrame:
        """All rows of the folders that count, with batch and bucket."""
        live = self.manifest(before).where(F.col("kind") == kind).select("batch", "bucket")
        schema = T.StructType([*KINDS[kind][1].fields, *PLACES])
        if live.isEmpty():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}").join(live, ["batch", "bucket"], "left_semi")

    def load(self, before: int | None = None, columns: list[str] = ITEM_COLUMNS) -> DataFrame:
        """All items, or those of their columns, id among them."""
        return self.latest("items", self.folders("items", before), [*columns, "live"]).where("live").select(*columns)

    def commit(self, number: int, touched: DataFrame, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """Writes a batch: changed, the items that are new or differ, and tombstones of the ids gone. touched are the
        items as they were that changed or gone may concern, as lookup() gave them. A batch that is written again
        replaces itself; its manifest, written last, makes it count. Items are written once, without a copy beside, and
        what else depends on them reads the few columns that it needs from there."""
        with passing(self.spark):
            self._commit(number, touched, changed, gone)

    def _commit(self, number: int, touched: DataFrame, changed: DataFrame, gone: DataFrame | None) -> None:
        none = self.spark.createDataFrame([], "id string")
        dead = touched.join((gone if gone is not None else none).select("id").distinct(), "id", "left_semi")
        marked = self._write_items(changed.select(*ITEM_COLUMNS).withColumn("live", F.lit(True)).unionByName(dead.select(*ITEM_COLUMNS).withColumn("live", F.lit(False))), number)
        items = self._fresh(number)
        now = items.where("live").select("final_url", "id", "live")
        # URLs that a touched item had: no longer its own, unless an item of this batch has it now.
        moved = touched.select("id", "final_url").join(items.select("id"), "id", "left_semi")
        left = moved.join(now.select("final_url"), "final_url", "left_anti").select("final_url", "id", F.lit(False).alias("live"))
        written = marked.unionByName(self._write("urls", now.unionByName(left), number))
        if self.counted:
            before = touched.join(items.select("id"), "id", "left_semi")
            written = written.unionByName(self._write("labels", label_changes(before, items.where("live")), number)).unionByName(self._write_recent(items, number))
        written.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/delta={number}")
        if number % self.full_every == self.full_every - 1:
            self.manifest(number + 1).write.mode("overwrite").parquet(f"{self.path}/manifest/full={number}")

    def _fresh(self, number: int) -> DataFrame:
        """The items that a batch made, changed or deleted, as it has written them."""
        schema = T.StructType([*KINDS["items"][1].fields, T.StructField("fresh", T.BooleanType()), PLACES[1]])
        return self.spark.read.schema(schema).parquet(f"{self.path}/items/batch={number}").where("fresh").drop("fresh")

    def _full(self, kind: str, hit: DataFrame, number: int) -> DataFrame:
        """Of the buckets in hit those that have so many folders that they are written whole."""
        folders = self.manifest(number).where(F.col("kind") == kind).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        return cut(hit.join(folders.where(F.col("n") >= self.deltas), "bucket", "left_semi"))

    def _marked(self, kind: str, hit: DataFrame, full: DataFrame, number: int) -> DataFrame:
        """The manifest's rows of a batch."""
        marked = hit.join(full.withColumn("base", F.lit(True)), "bucket", "left")
        return marked.select(F.lit(kind).alias("kind"), "bucket", F.lit(number).cast("long").alias("batch"), F.coalesce("base", F.lit(False)).alias("base"))

    def _write_items(self, rows: DataFrame, number: int) -> DataFrame:
        """As _write(), for rows with texts: the batch's own are dealt to their buckets once, a large bucket to several
        tasks. Older ones are in theirs already, so they go from folder to folder without a shuffle; which of them
        count is found by ids and batches alone."""
        fields = KINDS["items"][1].fieldNames()
        into = lambda df, fresh, mode: df.select(*fields, "bucket", F.lit(fresh).alias("fresh")).write.options(**PACKED).mode(mode).partitionBy("bucket").parquet(f"{self.path}/items/batch={number}")
        into(rows.select(*fields, self.bucket("id").alias("bucket")).hint("rebalance", F.col("bucket")), True, "overwrite")
        ids = cut(self._fresh(number).select("id", "bucket"))
        hit = ids.select("bucket").distinct()
        full = self._full("items", hit, number)
        if not full.isEmpty():
            older = self.read("items", full, number)
            known = cut(older.select("id", "batch", "live"))
            last = known.groupBy("id").agg(F.max("batch").alias("_last"), F.max_by("live", "batch").alias("_live"))
            stale = known.join(last, "id").where("batch < _last or not _live").select("id", "batch").union(known.join(ids, "id", "left_semi").select("id", "batch"))
            into(older.join(cut(stale.distinct()), ["id", "batch"], "left_anti"), False, "append")
        return self._marked("items", hit, full, number)

    def _write(self, kind: str, rows: DataFrame, number: int) -> DataFrame:
        """rows into their buckets; those that have many folders are written whole. Gives the manifest's rows."""
        key, schema = KINDS[kind]
        placed = cut(rows.select(*schema.fieldNames(), self.bucket(key).alias("bucket")))
        hit = placed.select("bucket").distinct()
        full = self._full(kind, hit, number)
        every = placed
        if not full.isEmpty():
            older = self.read(kind, full, number)
            if kind == "labels":
                every = self.latest(kind, placed.unionByName(older.select(*placed.columns)))
            else:
                older = self.latest(kind, older.join(placed.select(key), key, "left_anti"))
                every = placed.unionByName(older.where("live").select(*schema.fieldNames(), "bucket"))
        every.repartition("bucket").sortWithinPartitions("bucket", key).write.options(**PACKED).mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/batch={number}")
        return self._marked(kind, hit, full, number)

    def _write_recent(self, items: DataFrame, number: int) -> DataFrame:
        """The newest active items after a batch, of those before it and its own. Gives the manifest's row."""
        order, place = Q.order_of("newest"), F.struct((-F.unix_micros("created_at")).alias("micros"), "title", "id")
        fields = KINDS["recent"][1].fieldNames()
        bucket = self.spark.range(1).select(F.lit(0).alias("bucket"))
        held = cut(self.read("recent", bucket, number).select(*fields))
        floor = held.where("id is null and created_at is not null").first()
        fresh = Q.active_items(items.where("live")).select(*fields)
        ids = items.select("id")
        known = held.where("id is not null").join(ids, "id", "left_anti").unionByName(fresh)
        if floor is not None:
            known = known.where(place <= F.struct(-F.unix_micros(F.lit(floor["created_at"])), F.lit(floor["title"]), F.lit(floor["summary"])))
        top = cut(known.orderBy(*order).limit(self.keep + 1))
        if floor is not None and top.count() < self.least:
            every = Q.active_items(self.load(number, [*fields, "status"])).select(*fields).join(ids, "id", "left_anti").unionByName(fresh)
            floor, top = None, cut(every.orderBy(*order).limit(self.keep + 1))
        ranked = top.withColumn("_n", F.row_number().over(W.orderBy(*order)))  # at most keep + 1 rows
        if top.count() > self.keep:
            mark = ranked.where(F.col("_n") == self.keep).select("title", F.col("id").alias("summary"), "created_at")
        else:
            mark = held.where("id is null").select("title", "summary", "created_at").limit(1) if floor is not None else self.spark.createDataFrame([(None, None, None)], "title string, summary string, created_at timestamp")
        rows = ranked.where(F.col("_n") <= self.keep).select(*fields).unionByName(mark, allowMissingColumns=True)
        rows.withColumn("bucket", F.lit(0)).coalesce(1).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/recent/batch={number}")
        return bucket.select(F.lit("recent").alias("kind"), "bucket", F.lit(number).cast("long").alias("batch"), F.lit(True).alias("base"))

    def label_counts(self, before: int | None = None) -> DataFrame:
        """(status, dim, label, count) of all items, of the batches before that number if one is given: dim is category,
        platform or keyword, or ITEMS with an empty label for the items themselves. Reads the counts alone."""
        if not self.counted:
            raise ValueError("this store is not counted")
        rows = self.latest("labels", self.folders("labels", before))
        return rows.groupBy("status", "dim", "label").agg(F.sum("n").alias("count")).where("count <> 0")

    def stats(self, status: str | None = None, before: int | None = None) -> DataFrame:
        """As query.collection_stats() of all items, of one status, or of the status 'active or favorite', which are all
        that are not archived."""
        counts = self.label_counts(before)
        if status == LISTED:
            counts = Q.active_items(counts)
        elif status is not None:
            counts = counts.where(F.col("status") == status)
        held = cut(counts.groupBy("dim", "label").agg(F.sum("count").alias("count")))
        total = held.where(F.col("dim") == ITEMS).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
        return total.join(Q.buckets_of(Q.rank_labels(held.where(F.col("dim") != ITEMS))))  # two tables of one row

    def digest(self, generated_at: Column, first_hint: str = lists.HINT_FIRST, before: int | None = None) -> DataFrame:
        """As query.collection_digest() of all items, from the counts and the newest items that the store keeps."""
        stats = self.stats(LISTED, before)
        newest = self.folders("recent", before).where("id is not null")
        return Q.digest_row(stats, newest, generated_at, first_hint)

    def upsert(self, number: int, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(conflicts, changed items) of a batch with seq taken in as batch `number`, see store.upsert_changes()."""
        with passing(self.spark):
            batch = cut(incoming)
            touched = cut(self.lookup(batch.select("id"), batch.select("final_url"), number))
            _, changed, conflicts, _ = upsert_changes(touched, batch)
            self.commit(number, touched, changed)
            lost = cut(conflicts, keep=True)
        return lost, self._fresh(number).where("live").select(*ITEM_COLUMNS)

    def edit(self, number: int, edits: DataFrame) -> DataFrame:
        """The outcome of a log of edits taken in as batch `number`, see store.apply_edits()."""
        with passing(self.spark):
            log = cut(edits)
            touched = cut(self.lookup(log.select("id"), before=number))
            edited, outcome = apply_edits(touched, log)
            done = cut(outcome, keep=True)
            ids = cut(done.where("result = 'done'").select("id").distinct())
            left = cut(edited.select("id"))
            self.commit(number, touched, edited.join(ids, "id", "left_semi"), touched.join(left, "id", "left_anti"))
        return done

    def rehash(self, path: str, buckets: int, counted: bool | None = None) -> Store:
        """A new store of the same items with that many buckets, counted as this one or as told; for between two runs."""
        counted = self.counted if counted is None else counted
        out = Store.open(self.spark, path, buckets, counted, deltas=self.deltas, full_every=self.full_every, keep=self.keep, least=self.least)
        out.commit(-1, self.spark.createDataFrame([], ITEM_SCHEMA), self.load())
        return out

    def vacuum(self, before: int) -> list[str]:
        """Deletes the folders that do not count any more for batches from `before` on, and gives their names. Runs of
        earlier batches must be over."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        live = {(r["kind"], r["batch"]) for r in self.manifest(before).select("kind", "batch").distinct().collect()}  # a row for each batch that counts
        old = [f"{kind}/batch={n}" for kind in KINDS for n in _numbers(self.spark, f"{self.path}/{kind}", "batch") if n < before and (kind, n) not in live]
        full = max((n for n in _numbers(self.spark, f"{self.path}/manifest", "full") if n < before), default=None)
        if full is not None:
            old += [f"manifest/{name}={n}" for name in ("delta", "full") for n in _numbers(self.spark, f"{self.path}/manifest", name) if n < full or (n == full and name == "delta")]
        for name in old:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(conf).delete(at, True)
        return old
