"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.llm.common import column, cut, cut_table, keyed, slices, utf8
from curio.llm.graph import components, forest
from curio.llm.windows import by_bucket, gram_hashes

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fingerprints of one key that a task compares with each other; longer runs are compared block by block.
BLOCK = 4096
ROWS = 120_000


class Plan(NamedTuple):
    """How fingerprints of `words` longs are made and cut: `shingle` words are hashed, repeats included or not; a
    segment (first bit, length) that differs in one bit at most makes two fingerprints meet; their first `carry` longs
    travel with the keys, and links differ in at most `differ` bits of these."""

    shingle: int
    repeats: bool
    words: int
    carry: int
    differ: int
    segments: tuple[tuple[int, int], ...]


def exact_plan(shingle: int = 4, differ: int = 4) -> Plan:
    """64 bits; every pair that differs in at most `differ` bits meets: with differ // 2 + 1 segments, one of them
    holds at most one of the differing bits."""
    n = differ // 2 + 1
    edges = [round(i * 64 / n) for i in range(n + 1)]
    return Plan(shingle, True, 1, 1, differ, tuple((a, b - a) for a, b in zip(edges, edges[1:], strict=False)))


def similarity_plan(shingle: int = 5, similarity: float = 0.8, miss: float = 0.005, length: int = 16) -> Plan:
    """For links by Jaccard similarity of shingle sets: so many segments of `length` bits that a pair at the similarity
    shares a key but for `miss`; more similar ones share one more surely.

    128 bits tell pairs at the similarity from unlike ones, however many bits the segments take; so only these travel
    with a key. differ leaves 3.5 standard deviations, beyond which 0.02 % of the pairs at the similarity lie.

    The plan is the same for every table. A key's rows are the texts over 2 ** (length - 1), so its work grows with
    the square of that; much larger tables want longer segments, at the price of more keys for each row: 272 of 16
    bits, 580 of 20, 1,176 of 24. Only time depends on that choice, up to `miss` not the links.
    """
    wrong = math.acos(2 * similarity / (1 + similarity)) / math.pi  # a bit's chance to differ
    meet = (1 - wrong) ** length + length * wrong * (1 - wrong) ** (length - 1)
    n = math.ceil(math.log(miss) / math.log(1 - meet))
    differ = int(128 * wrong + 3.5 * math.sqrt(128 * wrong * (1 - wrong)))
    return Plan(shingle, False, max(2, -(-n * length // 64)), 2, differ, tuple((i * length, length) for i in range(n)))


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 (seed 42) of every run of `size` words, repeats included; of all words if there are fewer."""
    words = text.translate(LOWER).split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = [0, *[e + 1 for e in ends[: len(words) - size]]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :], strict=True)]


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Another hash, which arrays give at once, of every different run of `size` words; of all words if there are fewer."""
    words = text.translate(LOWER).split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not words:
        return hashes
    with np.errstate(over="ignore"):
        return np.unique(gram_hashes(hashes, min(size, len(words))))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the same shingles: the finalizer of a 64-bit mix of h and k."""
    if not k:
        return h
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_LANES = np.uint64(0x0101010101010101)


def _counts(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of each text's hashes (n of them, one text after another, none of 0) have each bit set.

    Eight bits are counted at once, each in a byte of its own, over stretches that are too short for it to overflow."""
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(n) - n, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    out = np.zeros((len(n), 64), np.int32)
    for b in range(8):
        sums = np.add.reduceat((h >> np.uint64(b)) & _LANES, starts)
        out[:, b::8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int32)
    return out


def majority(texts: list[bytes], size: int, words: int, repeats: bool = True) -> np.ndarray:
    """Fingerprints, one row of `words` 64-bit words a text: bits set in over half of the shingles' hashes; 0 without
    words. Without `repeats` equal shingles count once."""
    each = [np.array(shingle_hashes(t, size), np.uint64) if repeats else shingle_set(t, size) for t in texts]
    n = np.array([len(x) for x in each], np.int64)
    out = np.zeros((len(texts), words), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        h = np.concatenate(each)
        for k in range(words):
            ones = _counts(_mixed(h, k), n[some])
            out[some, k] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, rk and th (see keyed()), t2 (another hash of the text), bytes (the text's) and f, the fingerprint's words
    as longs, of every row of docs."""
    names = ["doc_id", "rk", "th", "t2", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            f = majority(utf8(batch), plan.shingle, plan.words, plan.repeats).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in names], pa.array(list(f), pa.list_(pa.int64()))], names=[*names, "f"])

    rows = keyed(docs).withColumns({"t2": F.xxhash64(F.lit(1), "text"), "bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, rk bigint, th bigint, t2 bigint, bytes bigint, f array<bigint>")


def _matrix(lists: pa.Array, words: int) -> np.ndarray:
    return lists.flatten().to_numpy().view(np.uint64).reshape(-1, words)


def _segment(f: np.ndarray, at: int, length: int) -> np.ndarray:
    word, shift = divmod(at, 64)
    value = f[:, word] >> np.uint64(shift)
    if shift + length > 64:
        value = value | (f[:, word + 1] << np.uint64(64 - shift))
    return value & np.uint64((1 << length) - 1)


def variants(f: np.ndarray, plan: Plan) -> np.ndarray:
    """The keys of each fingerprint: for each segment and each bit in it, the segment with that bit left out."""
    keys = []
    for s, (at, length) in enumerate(plan.segments):
        value = _segment(f, at, length)
        for p in range(length):
            keys.append((value & ~np.uint64(1 << p)) | np.uint64((s * 64 + p) << 40))
    return np.stack(keys, 1).view(np.int64)


def _index(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 2000):
            f = _matrix(batch.column(0).slice(begin, 2000), plan.words)
            keys = variants(f, plan)
            columns = [np.repeat(f[:, k], keys.shape[1]).view(np.int64) for k in range(plan.carry)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[pa.array(c) for c in columns]], names=["key", *[f"f{k}" for k in range(plan.carry)]])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def node_of(f: np.ndarray) -> np.ndarray:
    """One long that names a fingerprint: itself if it has one word."""
    h = f[:, 0].copy()
    for k in range(1, f.shape[1]):
        h = _mixed(h, k) ^ f[:, k]
    return h.view(np.int64)


def _nearest_first(f: np.ndarray, others: np.ndarray | None, differ: int) -> tuple[list, list, list]:
    """Links of a spanning forest with the smallest distances (Prim): among f's rows, or between f's and others' rows
    besides. Holds one distance for each row, never all pairs."""
    every = f if others is None else np.concatenate([f, others])
    side = np.arange(len(every)) >= len(f)
    n = len(every)
    best, parent, out = np.full(n, 1 << 20), np.full(n, -1), np.ones(n, bool)
    a, b, d = [], [], []
    for _ in range(n):
        i = int(np.where(out, best, 1 << 21).argmin())
        out[i] = False
        if best[i] <= differ:
            a.append(int(parent[i]))
            b.append(i)
            d.append(int(best[i]))
        away = _distance(every, every[i])
        if others is not None:
            away[side == side[i]] = 1 << 20
        closer = out & (away < best)
        best[closer], parent[closer] = away[closer], i
    return a, b, d


def _pairs(key: np.ndarray, f: np.ndarray, differ: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links among rows (sorted by key) with equal keys: node, node, distance; a spanning forest of nearest ones."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(first, len(key)))
    left, right, dist = [], [], []
    for i in np.flatnonzero(length > 256):
        a, b, d = _nearest_first(f[first[i] : first[i] + length[i]], None, differ)
        left.append(np.array(a, np.int64) + first[i])
        right.append(np.array(b, np.int64) + first[i])
        dist.append(np.array(d, np.int64))
    rest = np.repeat(np.where(length > 256, 0, length), length)  # rows' run lengths, long runs done
    place = np.arange(len(key)) - np.repeat(first, length)
    alive = np.flatnonzero(place + 1 < rest)
    step = 1
    while len(alive):
        away = _distance(f[alive], f[alive + step])
        near = away <= differ
        left.append(alive[near])
        right.append(alive[near] + step)
        dist.append(away[near])
        step += 1
        alive = alive[place[alive] + step < rest[alive]]
    if not left:
        return (np.zeros(0, np.int64),) * 3
    node = node_of(f)
    a, b, d = node[np.concatenate(left)], node[np.concatenate(right)], np.concatenate(dist)
    a, b = np.minimum(a, b), np.maximum(a, b)
    some = a != b
    a, b, d = a[some], b[some], d[some]
    _, once = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
    a, b, d = a[once], b[once], d[once]
    kept = forest(a, b, np.argsort(d, kind="stable"))
    return (a[kept], b[kept], d[kept]) if len(kept) else (np.zeros(0, np.int64),) * 3


def _out(a, b, d, key=(), block=(), packed=()) -> pa.RecordBatch:
    n, m = len(a), len(key)
    none = [None] * n
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([pa.array(a, pa.int64()), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([pa.array(d, pa.int64()), pa.nulls(m, pa.int64())]), pa.array([*none, *key], pa.int64()), pa.array([*none, *block], pa.int64()), pa.array([*none, *packed], pa.binary()),
        ],
        names=["a", "b", "d", "key", "block", "packed"],
    )


OUT = "a bigint, b bigint, d bigint, key bigint, block bigint, packed binary"


def _meet(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Links among the rows of each key, from rows sorted by key; of a run of over BLOCK rows, its blocks instead."""
    keys, fs, held, hot = [], [], 0, None

    def load(final: bool):
        nonlocal keys, fs, held, hot
        key, f = np.concatenate(keys), np.concatenate(fs)
        end = len(key) if final else int(np.searchsorted(key, key[-1]))  # the last run may go on
        said = []
        # What belongs to a run already known to be long, or is longer than a block by now, leaves as packed blocks.
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        small = np.ones(len(key), bool)
        for at, n in zip(first.tolist(), size.tolist(), strict=True):
            k = int(key[at])
            if n > BLOCK or (hot and hot[0] == k):
                block = hot[1] if hot and hot[0] == k else 0
                for i in range(at, at + n, BLOCK):
                    said.append((k, block, f[i : min(i + BLOCK, at + n)].tobytes()))
                    block += 1
                hot = (k, block)
                small[at : at + n] = False
        done = small.copy()
        done[end:] = False
        left = small.copy()
        left[:end] = False
        links = _pairs(key[done], f[done], plan.differ) if done.any() else ((), (), ())
        keys, fs, held = ([key[left]], [f[left]], int(left.sum())) if left.any() else ([], [], 0)
        return _out(*links, *zip(*said, strict=True)) if said else _out(*links)

    for batch in batches:
        if batch.num_rows:
            keys.append(batch.column(0).to_numpy())
            fs.append(np.stack([batch.column(1 + k).to_numpy().view(np.uint64) for k in range(plan.carry)], 1))
            held += batch.num_rows
            if held >= ROWS:
                yield load(False)
    if keys:
        yield load(True)


def _tiles(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, y, same in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            f, g = (np.frombuffer(v, np.uint64).reshape(-1, plan.carry) for v in (x, y))
            a, b, d = _nearest_first(f, None if same else g, plan.differ)
            node = node_of(f if same else np.concatenate([f, g]))
            yield _out(node[a] if a else [], node[b] if b else [], d)


def links(distinct: DataFrame, plan: Plan) -> DataFrame:
    """(a, b, d): links between fingerprints (column f of distinct, all different in the longs that travel), named by
    node_of() of these longs.

    Every pair within plan.differ bits that shares a key is joined by a path of links at most as long, bit for bit:
    of each key's pairs a spanning forest of the nearest is kept, so that a group of g copies gives g - 1 links, not
    all its pairs. Keys with over BLOCK fingerprints are compared in tiles of two blocks, spread over tasks.
    """
    rows = distinct.select("f").mapInArrow(lambda x: _index(x, plan), ", ".join(["key bigint", *[f"f{k} bigint" for k in range(plan.carry)]]))
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = cut_table(rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda x: _meet(x, plan), OUT))
    near = met.where("a is not null").select("a", "b", "d")
    blocks = met.where("packed is not null").select("key", "block", "packed")
    if not blocks.isEmpty():
        one, two = blocks.alias("x"), blocks.alias("y")
        tiles = one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")))
        # Spread by what a tile is, so that a task that is run again gets the same tiles.
        tiles = tiles.select("x.packed", F.col("y.packed").alias("other"), (F.col("x.block") == F.col("y.block")).alias("same"), "x.key", F.col("x.block").alias("i"), F.col("y.block").alias("j")).repartition(parts, "key", "i", "j")
        near = near.union(cut(tiles.mapInArrow(lambda x: _tiles(x, plan), OUT)).select("a", "b", "d"))
    return near.groupBy("a", "b").agg(F.min("d").alias("d"))


def hamming_groups(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row of docs, for a plan of 64 bits.

    component_id is the smallest doc_id among the documents whose fingerprints are linked, over any number of links;
    null if all of those are null. Texts without words, null ones too, have fingerprint 0 and are linked like others.
    Rows that repeat are in one component. No rows in, no rows out.
    """
    found = cut(fingerprints(docs, plan).select("doc_id", F.col("f")[0].alias("f0")))
    distinct = found.groupBy("f0").agg(F.min("doc_id").alias("least"))
    parts = components(links(distinct.select(F.array("f0").alias("f")), plan))
    linked = distinct.join(parts, F.col("f0") == F.col("node"), "left").select("f0", "least", F.coalesce("component", "f0").alias("component"))
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of = linked.select("f0", "component").join(named, "component").select(F.col("f0").alias("g0"), "component_id")
    hexed = F.lower(F.lpad(F.hex("f0"), 16, "0"))
    return found.join(of, F.col("f0") == F.col("g0")).select("doc_id", hexed.alias("fingerprint"), "component_id")


#: Texts, and bytes of text, of a family that are compared with each other in one task; larger families are cut into
#: parts, and each two parts meet in a task of their own.
FAMILY, FAMILY_BYTES = 1024, 16_000_000


def _compare(batch: pa.RecordBatch, plan: Plan, similarity: float) -> Iterator[pa.RecordBatch]:
    """a, b: links of whole tiles (rows with one key): texts whose shingle sets are that similar. Pairs go by distance,
    nearest first; what links have joined by then isn't compared any more, so a tile gives less links than texts."""
    batch = batch.take(pa.array(np.lexsort((column(batch, "family").to_numpy(), column(batch, "key").to_numpy()))))
    key, family, ids, part = (column(batch, c).to_numpy() for c in ("key", "family", "id", "part"))
    f = np.stack([column(batch, f"f{k}").to_numpy().view(np.uint64) for k in range(plan.carry)], 1)
    sets = [shingle_set(t, plan.shingle) for t in utf8(batch, "s")]
    size = np.array([len(x) for x in sets])
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    left, right = [], []
    begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (family[1:] != family[:-1])]))
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(key)], strict=True):
        apart = part[begin] != part[begin:end].max() or part[begin] != part[begin:end].min()
        near = []
        for i in range(begin, end - 1):
            away = _distance(f[i + 1 : end], f[i])
            low, high = np.minimum(size[i], size[i + 1 : end]), np.maximum(size[i], size[i + 1 : end])
            fits = (away <= plan.differ) & (low >= similarity * high)
            if apart:
                fits &= part[i + 1 : end] != part[i]
            js = np.flatnonzero(fits)
            near.append(np.stack([away[js], np.full(len(js), i), js + i + 1]))
        pairs = np.concatenate(near, 1) if near else np.zeros((3, 0), np.int64)
        for i, j in pairs[1:, np.argsort(pairs[0], kind="stable")].T.tolist():
            x, y = root(i), root(j)
            if x != y:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                    parent[y] = x
                    left.append(i)
                    right.append(j)
    yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(left, np.int64)]), pa.array(ids[np.array(right, np.int64)])], names=["a", "b"])


def _grouped(docs: DataFrame, similarity: float, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rk, th, t2 of every row; id, th, t2, row, group of every different text, where row is the smallest
    (doc_id, th, rk) of its rows)."""
    found = cut(fingerprints(docs, plan))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _matrix(column(batch, "f"), plan.words)[:, : plan.carry]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node_of(f))], names=[*batch.schema.names, "node"])

    once = found.groupBy("th", "t2").agg(F.first("bytes").alias("bytes"), F.first("f").alias("f"), F.min(F.struct("doc_id", "th", "rk")).alias("row")).withColumn("id", F.monotonically_increasing_id())
    kind = dict(docs.dtypes)["doc_id"]
    texts = cut_table(once.mapInArrow(named, f"th bigint, t2 bigint, bytes bigint, f array<bigint>, row struct<doc_id:{kind},th:bigint,rk:bigint>, id bigint, node bigint"))

    # Families: texts that proposed links hold together, over any number of links.
    nodes = components(links(texts.groupBy("node").agg(F.first("f").alias("f")).select("f"), plan))
    of = texts.join(nodes.withColumnRenamed("component", "family"), "node", "left").withColumn("family", F.coalesce("family", "node"))
    carried = [F.col("f")[k].alias(f"f{k}") for k in range(plan.carry)]
    narrow = cut_table(of.select("id", "family", "bytes", "row.rk", "row.th", *carried))
    many = F.greatest(F.ceil(F.count(F.lit(1)) / FAMILY), F.ceil(F.sum("bytes") / FAMILY_BYTES))
    parts = narrow.groupBy("family").agg(many.alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = narrow.join(parts, "family").drop("bytes")
    # One row's text for each, by two hashes; rows that repeat stand in one place after the join.
    rows = keyed(docs).select("rk", "th", F.coalesce("text", F.lit("")).alias("s")).join(members, ["rk", "th"]).dropDuplicates(["rk", "th", "id"])
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), "m")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    # A text of part p is in the tiles (p, q) of all q; the tile (p, p) compares its own texts.
    tiles = dealt.withColumn("key", F.xxhash64("family", F.least("part", "other"), F.greatest("part", "other")))
    near = by_bucket(tiles.select("key", "family", "id", "part", "s", *[f"f{k}" for k in range(plan.carry)]), lambda b: _compare(b, plan, similarity), "a bigint, b bigint")
    joined = components(cut_table(near))  # else a task would hold two Python workers, one for either's helper
    out = texts.select("id", "th", "t2", "row").join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
    return found.select("doc_id", "rk", "th", "t2"), out.withColumn("group", F.coalesce("component", "id")).drop("component")


def near_groups(docs: DataFrame, similarity: float = 0.8, plan: Plan | None = None) -> DataFrame:
    """doc_id, rk, th and group (long) of every row of docs: rows in a group are equal or linked, over any number of
    links, by sets of shingles of at least that Jaccard similarity.

    Fingerprints only propose: texts that proposals hold together are a family, and in it every pair of texts that may
    be similar by its fingerprints is judged by its whole texts, unless they are in one group by then. Families are
    compared tile by tile; only links that hold come out. So proposals may be thinned, and no link is lost but those
    that share no key, see similarity_plan().

    Null texts are empty, and texts without words are alike; rows that repeat are in one group; null ids are ids like
    others; other columns of docs, whatever their names, are not read; no rows in, no rows out.
    """
    rows, texts = _grouped(docs, similarity, plan or similarity_plan(similarity=similarity))
    return rows.join(texts.select("th", "t2", "group"), ["th", "t2"]).select("doc_id", "rk", "th", "group")


def keep_one(docs: DataFrame, similarity: float = 0.8, plan: Plan | None = None) -> DataFrame:
    """docs with one row of each group of near_groups(): that of the smallest doc_id (null counts as smaller than any).

    Of rows with that doc_id in the group the smallest text hash stays, and one of rows that are equal in both.
    Null and empty texts have equal shingles, none, and so are one group.
    """
    _, texts = _grouped(docs, similarity, plan or similarity_plan(similarity=similarity))
    chosen = texts.groupBy("group").agg(F.min("row").alias("c")).select(F.col("c.rk").alias("rk"), F.col("c.th").alias("th"))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rk"), F.xxhash64("text").alias("th"), F.struct(*docs.columns).alias("_doc"))
    return rows.join(chosen, ["rk", "th"]).groupBy("rk", "th").agg(F.first("_doc").alias("_doc")).select("_doc.*")
