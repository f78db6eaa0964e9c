"""Repeated windows of bytes or words: consecutive windows with one minimiser travel as one string to its bucket.

A window is `width` units (bytes or words) long. Its minimiser is the smallest hash of the runs of `gram` units in it,
so equal windows have equal minimisers. Consecutive windows of a document with one minimiser make a piece. Every
window is in exactly one piece, and all windows equal to it are in pieces of the same bucket.

A minimiser that too many different pieces have is a crowd: its windows are cut into pieces anew, by longer grams, which
fewer of them share. What is a crowd for the longest grams, too, is counted window by window, by 128 bits of hashes.

Names: a document is its doc_id and a 64-bit hash of doc_id and text; a piece's contents are its minimiser and another
64-bit hash. So two different things are mixed up only where both parts agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.llm.common import column, cut_table, keyed, slices, utf8

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
OTHER_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
#: Windows in one piece at most; a longer stretch with one minimiser (a period) is cut, which changes no window.
LONGEST = 1024
#: A minimiser that more pieces have is a crowd, so no bucket gets more strings than this.
HOT = 16_384
#: So is one with more pieces than one for SHARE documents of a sample of about SAMPLE: these are dealt by their
#: contents from the start. The sample says where rows go, not what comes out.
SAMPLE, SHARE = 16_384, 256
#: Bytes of a bucket's strings, or of several buckets' together, that a task looks at at once.
CHUNK = 1_000_000
#: Contents that a task has seen often and remembers.
REMEMBERED = 100_000


class Kind(NamedTuple):
    """units(text) gives a document's units and their hashes; join(units, begin, end) packs some. `grams` are tried in
    turn, from short to long, all shorter than `width`."""

    units: Callable
    join: Callable
    width: int
    grams: tuple[int, ...]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def gram_hashes(units: np.ndarray, gram: int, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of every run of `gram` units, from hashes of runs half as long."""
    power = {0: np.uint64(1)}
    for i in range(gram):
        power[i + 1] = power[i] * base
    have, size = units, 1
    known = [(1, units)]
    while size * 2 <= gram:
        have = have[:-size] * power[size] + have[size:]
        size *= 2
        known.append((size, have))
    for part, h in reversed(known[:-1]):
        if size + part <= gram:
            n = len(units) - size - part + 1
            have = have[:n] * power[part] + h[size : size + n]
            size += part
    return mix(have)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have, size = h, 1
    while size * 2 <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    if size < width:
        have = np.minimum(have[: len(h) - width + 1], have[width - size : width - size + len(h) - width + 1])
    return have


def stretches(units: np.ndarray, lengths: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, minimiser, times) of all pieces of documents whose units stand one after
    another. times is 2 where the minimiser occurs in the piece again, so that the piece may repeat a window, else 1."""
    none = np.zeros(0, np.int64)
    if len(units) < width:
        return none, none, none, none.view(np.uint64), none
    grams = width - gram + 1  # in a window
    with np.errstate(over="ignore"):
        hashes = gram_hashes(units, gram)
    least = sliding_min(hashes, grams)
    begins = np.cumsum(lengths) - lengths
    many = np.maximum(lengths - width + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), many)
    at = np.repeat(begins, many) + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    key = least[at]
    if not len(at):
        return none, none, none, none.view(np.uint64), none
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
    n = np.diff(np.append(first, len(at)))
    # Grams that are some window's smallest: the largest minimiser of the windows around them is their own hash.
    around = ~sliding_min(np.concatenate([np.full(grams - 1, ~np.uint64(0)), ~least, np.full(grams - 1, ~np.uint64(0))]), grams)
    small = np.flatnonzero(around == hashes)
    again = np.flatnonzero((hashes[small[1:]] == hashes[small[:-1]]) & (np.diff(small) <= grams))
    left, right = small[again], small[again + 1]
    doc = np.searchsorted(begins + lengths, left, "right")
    some = (doc < len(lengths)) & (many[np.minimum(doc, len(lengths) - 1)] > 0)
    left, right, doc = left[some], right[some], doc[some]
    window = np.clip(np.minimum(left, right - grams + 1), begins[doc], begins[doc] + many[doc] - 1)
    place = np.searchsorted(at, window)
    times = np.ones(len(first), np.int64)
    times[np.searchsorted(first, place[key[place] == hashes[left]], "right") - 1] = 2
    if n.max() > LONGEST:
        parts = -(-n // LONGEST)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        n = np.minimum(np.repeat(n, parts) - step * LONGEST, LONGEST)
        first, times = np.repeat(first, parts) + step * LONGEST, np.repeat(times, parts)
    return owner[first], (at - begins[owner])[first], n, key[first], times


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _content_hash(units: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the units [begin, end) for each pair, from sums of units over powers of an odd base."""
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        powers = np.full(len(units) + 1, BASE, np.uint64)
        powers[0] = 1
        back = np.full(len(units) + 1, inverse, np.uint64)
        back[0] = 1
        powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * back[:-1], dtype=np.uint64)])
        return mix((sums[end] - sums[begin]) * powers[begin] + (end - begin).astype(np.uint64))


#: Of a piece of the scan: its minimiser occurs in it again; equal pieces were left out of the slice; its minimiser is
#: a crowd by the sample; an equal piece that comes before it has been sent, so nothing else must be known.
TWICE, EQUALS, CROWDED, SETTLED = 1, 2, 4, 8
#: Of a place: first of the equal pieces; there are equal ones; its minimiser is a crowd.
FIRST, AGAIN, CROWD = 1, 2, 4


def order_of(ids: pa.Array) -> np.ndarray:
    """Ranks of ids; null ones come first."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    out = np.full(len(ids), -1, np.int64)
    if known.any():
        out[known] = np.unique(np.array(ids.drop_null().to_pylist()), return_inverse=True)[1]
    return out


class _Seen:
    """The first place of contents that were frequent in some slice of a task; bounded, so it may forget."""

    def __init__(self) -> None:
        self.first: dict[tuple[int, int], tuple] = {}

    def flags(self, key: np.ndarray, sid: np.ndarray, which: np.ndarray, start: np.ndarray, ids: pa.Array, rk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """EQUALS and SETTLED of each piece of a slice, and whether it is sent: rows that repeat send a place once."""
        place = np.lexsort((start, rk[which], order_of(ids)[which], sid, key))
        k, s = key[place], sid[place]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(place)))
        head = np.repeat(heads, size)
        same = (rk[which[place]] == rk[which[place[head]]]) & (start[place] == start[place[head]])
        flags = np.where(np.repeat(size, size) > 1, EQUALS, 0)
        flags[~same] |= SETTLED
        sent = new | ~same
        # Contents that a slice has often are remembered; whether others are is looked up by their keys first.
        known = np.isin(k[heads], np.fromiter((x for x, _ in self.first), np.int64, len(self.first)))
        for at, n, often in zip(heads[known | (size > 3)].tolist(), size[known | (size > 3)].tolist(), (size > 3)[known | (size > 3)].tolist(), strict=True):
            what, i = (int(k[at]), int(s[at])), which[place[at]]
            name = ids[int(i)].as_py()
            own = (name is not None, 0 if name is None else name, int(rk[i]), int(start[place[at]]))
            held = self.first.get(what)
            if held is not None and held < own:
                flags[at : at + n] |= SETTLED | EQUALS
            elif held is not None or often:
                self.first[what] = own
        if len(self.first) > REMEMBERED:
            self.first.clear()
        out, keep = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        out[place], keep[place] = flags, sent
        return out, keep


def _scan(batches: Iterator[pa.RecordBatch], kind: Kind, gram: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pieces of the texts; with a column runs (start, n), those of these windows only."""
    seen = _Seen()
    for batch in slices(batches, at_most=1_000_000):  # a dozen numbers are held for each unit
        hashes = [kind.units(t)[1] for t in utf8(batch)]
        lengths = np.array([len(h) for h in hashes], np.int64)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        which, start, n, key, times = stretches(every, lengths, kind.width, gram)
        if "runs" in batch.schema.names:
            which, start, n, key, times = _inside(which, start, n, key, times, column(batch, "runs").to_pylist(), lengths)
        begin = (np.cumsum(lengths) - lengths)[which] + start
        sid = _content_hash(every, begin, begin + n + kind.width - 1).view(np.int64)
        key, ids, rk = key.view(np.int64), column(batch, "doc_id"), column(batch, "rk").to_numpy()
        flags, sent = seen.flags(key, sid, which, start, ids, rk) if len(key) else (np.zeros(0, np.int64), np.zeros(0, bool))
        flags |= np.where(times > 1, TWICE, 0) | np.where(np.isin(key, hot), CROWDED, 0)
        at = pa.array(which[sent])
        columns = [ids.take(at), column(batch, "rk").take(at), pa.array(start[sent], pa.int32()), pa.array(n[sent], pa.int32()), pa.array(key[sent]), pa.array(sid[sent]), pa.array(flags[sent], pa.int8())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rk", "start", "n", "key", "sid", "flags"])


def _inside(which, start, n, key, times, runs: list, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces cut down to the windows of each document's runs."""
    wanted = np.zeros(int(lengths.sum()) + 1, np.int64)
    begins = np.cumsum(lengths) - lengths
    for i, own in enumerate(runs):
        for r in own or ():
            wanted[begins[i] + r["start"]] += 1
            wanted[begins[i] + r["start"] + r["n"]] -= 1
    wanted = np.cumsum(wanted) > 0
    piece = np.repeat(np.arange(len(n)), n)
    at = begins[which[piece]] + start[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    keep = wanted[at]
    piece, at = piece[keep], at[keep]
    if not len(piece):
        return which[:0], start[:0], n[:0], key[:0], times[:0]
    first = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)]))
    of = piece[first]
    return which[of], at[first] - begins[which[of]], np.diff(np.append(first, len(piece))), key[of], times[of]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by (key, sid, order), those whose key occurs again, in the piece or elsewhere, with kind: FIRST
    of the equal pieces, AGAIN if there are equal ones, CROWD if the key is known for one or occurs more than HOT times.

    Rows pass in order; at most HOT of a key are held until it is known what they are."""
    held: list[pa.RecordBatch] = []
    crowd = None  # a key known to be one
    names = ["doc_id", "rk", "start", "n", "key", "sid"]

    def judge(table: pa.RecordBatch, upto: int, last: tuple | None) -> tuple[pa.RecordBatch, tuple]:
        key, sid, flags = (column(table, c).to_numpy() for c in ("key", "sid", "flags"))
        same = np.concatenate([[last is not None and last[0] == key[0]], key[1:] == key[:-1]])
        equal = same & np.concatenate([[last is not None and last[:2] == (key[0], sid[0])], sid[1:] == sid[:-1]])
        again = equal | np.append(equal[1:], False) | (flags & EQUALS > 0)
        begin = np.flatnonzero(~same) if not same[0] else np.concatenate([[0], np.flatnonzero(~same)])
        size = np.diff(np.append(begin, len(key)))
        many = np.repeat((size > HOT) | (key[begin] == crowd if crowd is not None else np.zeros(len(begin), bool)), size) | (flags & CROWDED > 0)
        wanted = same | np.append(same[1:], False) | (flags > 0)
        # Rows that repeat are the same place, so all of them are first.
        rk, start = column(table, "rk").to_numpy(), column(table, "start").to_numpy()
        group = np.maximum.accumulate(np.where(equal, 0, np.arange(len(key))))
        first_rk, first_start = rk[group], start[group]
        if equal[0]:
            old = group == 0
            first_rk, first_start = np.where(old, last[2], first_rk), np.where(old, last[3], first_start)
        first = (rk == first_rk) & (start == first_start)
        kind = np.where(first, FIRST, 0) | np.where(again, AGAIN, 0) | np.where(many, CROWD, 0)
        out = table.slice(0, upto)
        made = pa.RecordBatch.from_arrays([*[column(out, c) for c in names], pa.array(kind[:upto].astype(np.int8))], names=[*names, "kind"])
        return made.filter(pa.array(wanted[:upto])), (key[upto - 1], sid[upto - 1], first_rk[upto - 1], first_start[upto - 1])

    last = None
    for batch in batches:
        settled = column(batch, "flags").to_numpy() & SETTLED > 0
        if settled.any():
            some = batch.filter(pa.array(settled))
            yield pa.RecordBatch.from_arrays([*[column(some, c) for c in names], pa.array(np.full(some.num_rows, AGAIN), pa.int8())], names=[*names, "kind"])
            batch = batch.filter(pa.array(~settled))
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.concat_batches(held)
        key = column(table, "key").to_numpy()
        # A row is settled once the next row is there; a key's rows once the key is over, or is known to be a crowd.
        begin = int(np.searchsorted(key, key[-1]))
        if len(key) - begin > HOT or crowd == key[-1]:
            crowd = key[-1]
            begin = len(key) - 1
        if begin:
            made, last = judge(table, begin, last)
            yield made
        held = [table.slice(begin)]
    if held:
        table = pa.concat_batches(held)
        yield judge(table, table.num_rows, last)[0]


def _crowds(rows: DataFrame, kind: Kind, n: int) -> list[np.ndarray]:
    """For each gram, the minimisers with more pieces than one for SHARE documents of a sample, sorted. There are at most
    SHARE times as many as a sampled document has pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at_most=1_000_000):
            hashes = [kind.units(t)[1] for t in utf8(batch)]
            lengths = np.array([len(h) for h in hashes], np.int64)
            every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            for level, gram in enumerate(kind.grams):
                keys, times = np.unique(stretches(every, lengths, kind.width, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), level), pa.int32()), pa.array(keys.view(np.int64)), pa.array(times)], names=["level", "key", "n"])

    if not n:
        return [np.zeros(0, np.int64) for _ in kind.grams]
    some = rows if n <= SAMPLE else rows.sample(SAMPLE / n, seed=1)
    least = max(8, min(n, SAMPLE) // SHARE)
    found = some.mapInArrow(count, "level int, key bigint, n bigint").groupBy("level", "key").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect()
    return [np.sort(np.array([r["key"] for r in found if r["level"] == level], np.int64)) for level in range(len(kind.grams))]


def _window_rows(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """doc_id, rk, start, n, two hashes and flags of the windows of the runs: a row for each that must be looked for
    elsewhere (n is 1; EQUALS if the slice has equal ones), and one for each stretch of n that an earlier one in the
    task settles (SETTLED, no hashes)."""
    seen = _Seen()
    for batch in slices(batches, at_most=1_000_000):
        hashes = [kind.units(t)[1] for t in utf8(batch)]
        lengths = np.array([len(h) for h in hashes], np.int64)
        begins = np.cumsum(lengths) - lengths
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        runs = sorted({(i, p) for i, own in enumerate(column(batch, "runs").to_pylist()) for r in own for p in range(r["start"], r["start"] + r["n"])})
        if not runs:
            continue
        which, start = np.array(runs, np.int64).T
        with np.errstate(over="ignore"):
            h, i = (gram_hashes(every, kind.width, base)[begins[which] + start].view(np.int64) for base in (BASE, OTHER_BASE))
        flags, sent = seen.flags(h, i, which, start, column(batch, "doc_id"), column(batch, "rk").to_numpy())
        done = sent & (flags & SETTLED > 0)
        single, many = np.flatnonzero(sent & ~done), np.flatnonzero(done)
        first = many[np.concatenate([[True], (np.diff(many) > 1) | (which[many[1:]] != which[many[:-1]]) | (np.diff(start[many]) > 1)])] if len(many) else many
        length = np.diff(np.append(np.searchsorted(many, first), len(many)))
        rows = np.concatenate([single, first])
        at, none = pa.array(which[rows]), pa.nulls(len(first), pa.int64())
        n = np.concatenate([np.ones(len(single), np.int64), length])
        columns = [column(batch, "doc_id").take(at), column(batch, "rk").take(at), pa.array(start[rows], pa.int32()), pa.array(n, pa.int32())]
        columns += [pa.concat_arrays([pa.array(x[single]), none]) for x in (h, i)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(flags[rows], pa.int8())], names=["doc_id", "rk", "start", "n", "h", "i", "flags"])


def _pack(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """The strings of the runs. Rows that repeat stand side by side after the join: they are packed once."""
    last = None
    for batch in slices(batches):
        out, strings = [], []
        ids, rk = column(batch, "doc_id").to_pylist(), column(batch, "rk").to_pylist()
        for i, (text, runs) in enumerate(zip(utf8(batch), column(batch, "runs").to_pylist(), strict=True)):
            if last == (ids[i], rk[i]):
                continue
            last = (ids[i], rk[i])
            parts = kind.units(text)[0]
            for r in {(r["start"], r["n"], r["key"], r["again"]) for r in runs}:
                strings.append(kind.join(parts, r[0], r[0] + r[1] + kind.width - 1))
                out.append((i, *r))
        which, start, n, key, again = zip(*out, strict=True) if out else ((),) * 5
        at = pa.array(which, pa.int64())
        columns = [column(batch, "doc_id").take(at), column(batch, "rk").take(at), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(key, pa.int64()), pa.array(again, pa.bool_()), pa.array(strings, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rk", "start", "n", "key", "again", "s"])


class Level(NamedTuple):
    """places: doc_id, rk, start, n, key, sid, kind of every piece that may repeat. strings: of the first of equal ones,
    not of crowds: doc_id, rk, start, n, key, again (there are equal ones), s."""

    places: DataFrame
    strings: DataFrame


def levels(docs: DataFrame, kind: Kind) -> tuple[list[Level], DataFrame | None]:
    """The pieces of a corpus whose windows may occur more than once, for each gram in turn, and for what is a crowd
    with all of them a table of its windows, see _window_rows(), or None.

    Two passes over the texts for each gram: one makes a narrow row for each piece and brings equal minimisers together;
    only where these repeat, the other packs strings, and of equal pieces only the first one (by doc_id, null first,
    then rk, then place). Equal pieces of a slice of texts are combined before they are sent.
    """
    spark, id_kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = keyed(docs).select("doc_id", "rk", "text")
    head = f"doc_id {id_kind}, rk bigint, start int, "
    bit = lambda c, b: F.col(c).bitwiseAND(F.lit(b).cast("tinyint")) > 0

    def with_runs(pieces: DataFrame, crowd: bool, *columns) -> DataFrame:
        runs = pieces.groupBy(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk")).agg(F.collect_set(F.struct(*columns)).alias("runs"))
        runs = cut_table(runs) if crowd else runs  # so that its size is known: if small enough, Spark sends it instead of the texts
        return rows.join(runs, (F.col("rk") == F.col("_rk")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "rk", "text", "runs")

    out, texts = [], rows
    for gram, hot in zip(kind.grams, _crowds(rows, kind, docs.count()), strict=True):
        found = texts.mapInArrow(lambda b, gram=gram, hot=hot: _scan(b, kind, gram, hot), head + "n int, key bigint, sid bigint, flags tinyint")
        to = F.when(bit("flags", SETTLED), F.col("rk")).when(bit("flags", CROWDED), F.xxhash64("key", "sid")).otherwise(F.col("key"))
        places = cut_table(found.repartition(parts, to).sortWithinPartitions("key", "sid", "doc_id", "rk", "start").mapInArrow(_repeated, head + "n int, key bigint, sid bigint, kind tinyint"))
        first = places.where(bit("kind", FIRST))
        packed = with_runs(first.where(~bit("kind", CROWD)), bool(out), "start", "n", "key", bit("kind", AGAIN).alias("again"))
        out.append(Level(places, packed.mapInArrow(lambda b: _pack(b, kind), head + "n int, key bigint, again boolean, s binary")))
        crowd = first.where(bit("kind", CROWD))
        if crowd.isEmpty():
            return out, None
        texts = with_runs(crowd, True, "start", "n")
    return out, cut_table(texts.mapInArrow(lambda b: _window_rows(b, kind), head + "n int, h bigint, i bigint, flags tinyint"))


def gathered(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (with doc_id and rk) and spans (array of a, b; null without one), from spans (doc_id, rk, a, b)."""
    lists = spans.groupBy(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return rows.join(lists, (F.col("rk") == F.col("_rk")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id", "_rk")


def by_bucket(distinct: DataFrame, look: Callable, schema: str) -> DataFrame:
    """look(batch) over whole buckets, as many as fit in CHUNK bytes together; rows are sent and sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = None, 0
        for batch in slices(batches, "s", CHUNK // 2):
            held = batch if held is None else pa.concat_batches([held, batch])
            size += batch.nbytes
            if size >= CHUNK:
                key = column(held, "key").to_numpy()
                end = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                if end:
                    yield from look(held.slice(0, end))
                    held = pa.concat_batches([held.slice(end)])
                    size = held.nbytes
        if held is not None and held.num_rows:
            yield from look(held)

    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return distinct.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, schema)
