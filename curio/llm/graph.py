"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.llm.common import cut, cut_table, drop_shuffles


def forest(a: np.ndarray, b: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the links, taken in the given order, that join two trees: a spanning forest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)].tolist(), at[len(a) :].tolist()
    parent = list(range(len(nodes)))
    kept = []
    for i in range(len(a)) if order is None else order.tolist():
        x, y = left[i], right[i]
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, np.int64)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links without those that close a circle inside a block of rows."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        kept = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], names=["a", "b"])


#: A node with more than one of HEAVY links is joined on its own; up to FEW links (16 MB) are no matter for one task.
HEAVY, FEW = 1000, 1_000_000


def _with_least(links: DataFrame, n: int) -> DataFrame:
    """links (u, v) with m, the smallest v of each u.

    n is about half the number of links. Nodes with over n / HEAVY of them, so at most 2 * HEAVY, are broadcast with
    their m, so that the links of a hub stay where they are; the others meet in a shuffle.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
    if n <= FEW:
        return links.join(least.select("u", "m"), "u")
    hubs = F.col("d") > n // HEAVY
    some = cut(least)
    heavy = some.where(hubs).select(F.col("u").alias("h"), F.col("m").alias("hm"))
    if heavy.isEmpty():
        return links.join(some.select("u", "m"), "u")
    known = links.join(F.broadcast(heavy), F.col("u") == F.col("h"), "left")
    rest = known.where("h is null").select("u", "v").join(some.where(~hubs).select("u", "m"), "u")
    return rest.union(known.where("h is not null").select("u", "v", F.col("hm").alias("m")))


def components(links: DataFrame) -> DataFrame:
    """(node, component): each node of links (a, b: long, not null) with the smallest node that it reaches.

    Large-star and small-star steps in turn until nothing changes; each hangs nodes onto the smallest neighbour known,
    so the number of rounds grows with the logarithm of the links' longest path. A step keeps at most one link for
    each link it read, groups nothing but minima, and is written to the checkpoint folder. Only a count and a checksum
    reach the driver. No links, no rows.
    """
    now = cut_table(links.select("a", "b").where("a <> b").mapInArrow(_thin, "a bigint, b bigint"))
    seen, n = None, now.count()
    while n:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = _with_least(both, n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        small = _with_least(large, n).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        now = cut(small.select(F.col("e.u").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen, n = mark, mark[0]
    drop_shuffles(now.sparkSession)  # what the links came from, too
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
