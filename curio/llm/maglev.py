"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to this many slots (rows of under a hundred bytes) the table is broadcast; a larger one is joined by a shuffle.
BROADCAST_SLOTS = 131_071
#: Places of a preference order that a claim looks at before it looks at the whole order.
FEW = 64


def _number(text: Column) -> Column:
    """32 bits of a text's MD5, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: list[str], slots: int = 3209) -> DataFrame:
    """One row (slot, shard) for each of `slots` slots; slots must be prime.

    Each shard's preference order is the permutation offset + j * skip modulo the prime. The shards take turns: the
    one whose turn it is claims the first slot of its order that is free, until none is. One row's fold fills the table:
    a byte for each slot says whether it is taken, and each shard remembers how far down its order it has come. Every
    shard gets as many slots as any other, or one more. The table depends on the names only, and its size is a
    parameter, not a matter of data; the fold takes about slots * (slots / 64 + shards) steps.
    """
    if not shards or len(set(shards)) != len(shards) or any(not s for s in shards):
        raise ValueError("shards must be distinct non-empty names")
    if len(shards) > slots or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, at least the number of shards")
    one = spark.range(1, numPartitions=1).select(F.array(*[F.lit(s) for s in shards]).alias("names"))
    number = lambda end, most: F.transform("names", lambda s: _number(F.concat(s, F.lit(end))) % most)
    begun = one.select("names", number("/offset", slots).alias("offset"), F.transform(number("/skip", slots - 1), lambda x: x + 1).alias("skip"))
    taken_byte, free_byte = F.unhex(F.lit("01")), F.unhex(F.lit("00"))

    def turn(state: Column, at: Column) -> Column:
        shard = (at % len(shards)).cast("int")
        slot = lambda j: ((F.get("offset", shard) + j * F.get("skip", shard)) % slots).cast("int")
        is_free = lambda j: F.substring(state["taken"], slot(j) + 1, F.lit(1)) == free_byte
        # The first free place among some of the order from where the shard stands.
        first = lambda begin, end: F.aggregate(F.sequence(begin, end), F.lit(-1), lambda found, j: F.when(found >= 0, found).when(is_free(j), j).otherwise(F.lit(-1)))
        place, last = F.get(state["place"], shard), F.lit(slots - 1)
        few = first(place, F.least(place + FEW, last))

        def claimed(j: Column) -> Column:
            return F.struct(
                F.concat(F.substring(state["taken"], F.lit(1), slot(j)), taken_byte, F.substring(state["taken"], slot(j) + 2, F.lit(slots))).alias("taken"),
                F.transform(state["place"], lambda p, i: F.when(i == shard, j).otherwise(p)).alias("place"),
                F.concat(state["claims"], F.lit("#"), F.hex(slot(j))).alias("claims"),
            )

        # Each step is worked out once, for the next one to use.
        found = F.transform(F.array(few), lambda j: F.when(j >= 0, j).otherwise(first(F.least(place + FEW, last), last)))
        return F.element_at(F.transform(found, claimed), 1)

    start = F.struct(F.unhex(F.lit("00" * slots)).alias("taken"), F.transform("names", lambda s: F.lit(0)).alias("place"), F.lit("").alias("claims"))
    claims = F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), start, turn, lambda state: state["claims"])
    # The n-th claim is the turn of shard n modulo their number.
    rows = begun.select("names", claims.alias("claims")).select("names", F.posexplode(F.split(F.substring("claims", 2, 17 * slots), "#")).alias("at", "code"))
    return rows.select(F.conv("code", 16, 10).cast("long").alias("slot"), F.element_at("names", F.col("at") % len(shards) + 1).alias("shard"))


def assign(rows: DataFrame, key: str, shards: list[str], slots: int = 3209) -> DataFrame:
    """rows with slot (long) and shard (string): the slot is the key's hash modulo the number of slots.

    The lookup table has `slots` rows of under a hundred bytes; up to BROADCAST_SLOTS it is broadcast and rows are
    placed where they are read, without a shuffle; a key that a third of the rows share costs nothing more. A null key
    is placed like an empty one. Columns of rows named slot or shard are replaced. Equal keys, and rows that repeat,
    get equal shards; no rows in, no rows out.
    """
    kept = rows.select(*[c for c in rows.columns if c not in ("slot", "shard")])
    looked = kept.withColumn("slot", _number(F.coalesce(F.col(key).cast("string"), F.lit(""))) % slots)
    table = lookup_table(rows.sparkSession, shards, slots)
    return looked.join(F.broadcast(table) if slots <= BROADCAST_SLOTS else table, "slot")
