"""Best-fit packing of tokenized documents into sequences, improved by swap-based local search."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.llm.common import column, cut, slices

#: Rows that one task packs at once. What its bins leave open goes on to the next round, across groups.
GROUP = 16_384
END_ID = 2
#: Characters of stretches whose ids a worker keeps; a fuller memory starts anew.
KEPT = 8_000_000


#: Letters in every version of Unicode that a library may know, as a class of a pattern.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Symbols, none of which stands next to a letter in a special token.
_MARK = ",.;:!?#$%&*"


class Encoder:
    """Text -> ids as little-endian bytes, all of them from the tokenizer at path; those of frequent words once.

    The vocabulary is byte-level BPE: a pattern splits the text and merges stay inside its parts. A part is letters,
    digits or other marks, with at most a space before them, or white space, or an apostrophe and letters. So after a
    letter, what is no letter or apostrophe begins a part, and after a mark a space does; one line feed between either
    and a letter is a part. A text may thus be cut between a letter and a mark, between either and a space before a
    letter, and around such a line feed: the ids of its stretches, in turn, are those of the text. No special token has
    such a place in it (else texts stay whole).

    Most of a text is words between single spaces, so these are looked up first, each with the space before it; only
    what stands around words of another form is searched for the other places.
    """

    BREAK = re.compile(f"(?<=[{_LETTER}{_MARK}])(?=[ \n][{_LETTER}])|(?<=[{_LETTER}])(?=[{_MARK}])|(?<=[{_LETTER}{_MARK}]\n)(?=[{_LETTER}])")
    #: A stretch that is one part of the pattern; the merges may be asked for it without the rest of the library.
    PART = re.compile(f" ?[{_LETTER}]+")
    #: Between spaces: letters and marks behind them; and all that may be cut from the like at the space before it.
    WORD = re.compile(f"([{_LETTER}]+)([{_MARK}]*)")
    APART = re.compile(f"[{_LETTER}](?:.*[{_LETTER}{_MARK}])?", re.DOTALL)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.whole = any(self.BREAK.search(t.content) for t in self.exact.get_added_tokens_decoder().values()) or "ByteLevel" not in str(self.exact.pre_tokenizer) or self.exact.normalizer is not None
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # the ids of a word with a space before it
        self.held = 0
        if not self.whole:
            letters = [chr(c) for c in range(32, 0x250) if self.PART.fullmatch(chr(c))]
            self.bytes_as_letters = {ord(c): self.exact.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in [" ", *letters]}

    def ids(self, text: str) -> bytes:
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, part: str) -> bytes:
        return array("I", [t.id for t in self.exact.model.tokenize(part.translate(self.bytes_as_letters))]).tobytes()

    def stretches(self, text: str) -> bytes:
        known, stretches = self.known, self.BREAK.split(text)
        for part in set(stretches).difference(known):
            known[part] = self.merged(part) if self.PART.fullmatch(part) else self.ids(part)
            self.held += len(part)
        return b"".join(map(known.__getitem__, stretches))

    def word(self, word: str) -> bytes | None:
        """The ids of a word with a space before it; None if it may not be cut from the words beside it."""
        spaced = self.spaced
        ids = spaced.get(word)
        if ids is None and (form := self.WORD.fullmatch(word)):
            letters, marks = form.groups()
            ids = spaced.get(letters)
            if ids is None:
                ids = spaced[letters] = self.merged(" " + letters)
                self.held += len(letters)
            if marks:
                ids = spaced[word] = ids + self.stretches(marks)
                self.held += len(word)
        elif ids is None and self.APART.fullmatch(word):
            line, feed, more = word.partition("\n")
            if feed and self.WORD.fullmatch(line) and self.PART.match(more):
                return self.word(line) + self.stretches(feed) + self.stretches(more)
            return self.stretches(" " + word)
        return ids

    def encode(self, text: str) -> bytes:
        if self.whole:
            return self.ids(text)
        words = text.split(" ")
        ids = list(map(self.spaced.get, words))
        ids[0] = self.stretches(words[0]) if self.APART.fullmatch(words[0]) else None  # no space before it
        odd = []
        if None in ids:
            for i in [i for i, x in enumerate(ids) if x is None]:
                ids[i] = self.word(words[i]) if i else None
                if ids[i] is None:
                    odd.append(i)
        if odd:  # each stays with its neighbours, and what neighbours it has in common with the next, with that, too
            out, at, k = [], 0, 0
            while k < len(odd):
                begin, end = max(odd[k] - 1, 0), odd[k] + 2
                while (k := k + 1) < len(odd) and odd[k] <= end:
                    end = odd[k] + 2
                out += ids[at:begin]
                out.append(self.stretches(" " * (begin > 0) + " ".join(words[begin:end])))
                at = end
            ids = out + ids[at:]
        if self.held > KEPT:
            self.known.clear()
            self.spaced.clear()
            self.held = 0
        return b"".join(ids)


_encoders: dict[str, Encoder] = {}


def tokenizer_file() -> str:
    """The installed 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, path: str, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the documents' ids and END_ID, cut where longer than capacity.

    The first piece takes what is left over, all others are full. Null texts are empty: one piece with END_ID alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        end_id = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            whose, rows = [], []
            for i, text in enumerate(column(batch, "text").to_pylist()):
                ids = encoder.encode(text or "") + end_id  # four bytes each
                n = len(ids) // 4
                for k, end in enumerate(range(n % capacity or capacity, n + 1, capacity)):
                    begin = end - capacity if k else 0
                    whose.append(i)
                    rows.append((k, begin, end - begin, zlib.crc32(ids[4 * begin : 4 * end])))
            values = np.array(rows, np.int64).reshape(-1, 4).T
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [column(batch, "doc_id").take(pa.array(whose, pa.int64())), *[pa.array(v, pa.int64()).cast(k) for v, k in zip(values, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the open bin that it fills most."""
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by their room
    rooms = 0  # bit r: some bin has room r
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            at = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            at, room = len(bins), capacity
            bins.append([item])
        if room > n:
            open_at[room - n].append(at)
            rooms |= 1 << (room - n)
    return bins


class _Underfull:
    """The bins that are not full, found by what they hold: single lengths, and sums of two."""

    def __init__(self, bins: list[list[int]], lengths: list[int]):
        self.lengths = lengths
        self.items = dict(enumerate(bins))
        self.fill = {b: sum(lengths[i] for i in held) for b, held in self.items.items()}
        #: By number of documents (1, 2): the bins that hold a length or a sum, and the lengths held as bits.
        self.holders = {1: defaultdict(set), 2: defaultdict(set)}
        self.bits = {1: 0, 2: 0}
        self.own: dict[int, dict[int, set[int]]] = {}
        for b in bins and list(self.items):
            self._enter(b)

    def _enter(self, b: int) -> None:
        sizes = sorted(self.lengths[i] for i in self.items[b])
        distinct = set(sizes)
        pairs = {x + y for x in distinct for y in distinct if x < y} | {2 * x for x, y in zip(sizes, sizes[1:], strict=False) if x == y}
        self.own[b] = {1: distinct, 2: pairs}
        for k, values in self.own[b].items():
            for v in values:
                self.holders[k][v].add(b)
                self.bits[k] |= 1 << v

    def leave(self, b: int) -> None:
        for k, values in self.own.pop(b).items():
            for v in values:
                held = self.holders[k][v]
                held.discard(b)
                if not held:
                    self.bits[k] &= ~(1 << v)

    def gain(self, taker: int, room: int) -> tuple | None:
        """The step that adds most to taker, at most room: (gain, giver, documents given, their length, documents given
        back, theirs); it must raise the sum of squared fills. None without one."""
        best, window = None, (1 << room) - 1
        own = self.own[taker]
        for given, back, values in ((1, 0, (0,)), (1, 1, own[1]), (2, 0, (0,)), (2, 1, own[1]), (1, 2, own[2])):
            for r in values:
                found = (self.bits[given] >> (r + 1)) & window
                while found and (best is None or found.bit_length() > best[0]):
                    d = found.bit_length()
                    giver = min(self.holders[given][r + d] - {taker}, key=lambda b: (self.fill[b], b), default=None)
                    if giver is not None and self.fill[taker] + d > self.fill[giver]:
                        best = (d, giver, given, r + d, back, r)
                        break
                    found ^= 1 << (d - 1)
            if best and best[0] == room:
                break
        return best

    def _pick(self, b: int, many: int, total: int) -> list[int]:
        """Documents of bin b: none, one, or two, of that total length."""
        at: dict[int, int] = {}
        for i in self.items[b] if many else ():
            n = self.lengths[i]
            if many == 1 and n == total:
                return [i]
            if many == 2 and total - n in at:
                return [at[total - n], i]
            at.setdefault(n, i)
        return []

    def exchange(self, taker: int, step: tuple) -> None:
        d, giver, given, length, back, returned = step
        out, home = self._pick(giver, given, length), self._pick(taker, back, returned)
        for b in (giver, taker):
            self.leave(b)
        self.items[giver] = [i for i in self.items[giver] if i not in out] + home
        self.items[taker] = [i for i in self.items[taker] if i not in home] + out
        self.fill[giver] -= d
        self.fill[taker] += d
        for b in (giver, taker):
            self._enter(b)


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """The same items in as many bins or fewer.

    Each underfull bin, fullest first, takes what it gains most by from any other: a document moved over, or exchanged
    one for one, two for one, or one for two, so that the sum of squared fills rises. Lengths and sums of two are looked
    up in an index of all underfull bins, so no partner is left out. That sum is bounded, so the search ends: where no
    step is left, or where a bin less can't be had, by the total length or by the documents of over half a bin.
    """
    least = max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))
    fills = [sum(lengths[i] for i in b) for b in bins]
    full = [b for b, n in zip(bins, fills, strict=True) if n >= capacity]
    left = _Underfull([b for b, n in zip(bins, fills, strict=True) if n < capacity], lengths)
    moved = True
    while moved and len(full) + len(left.items) > least:
        moved = False
        for taker in sorted(left.own, key=lambda b: (-left.fill[b], b)):
            while taker in left.own and (step := left.gain(taker, capacity - left.fill[taker])):
                moved = True
                left.exchange(taker, step)
                if not left.items[step[1]]:
                    left.leave(step[1])
                    del left.items[step[1]]
                if left.fill[taker] == capacity:
                    left.leave(taker)
    return full + list(left.items.values())


def _pack(group: pd.DataFrame, capacity: int, first: int) -> pd.DataFrame:
    lengths = group["length"].tolist()
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    number, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, items in enumerate(bins):
        at = 0
        for i in items:
            number[i], offset[i] = k, at
            at += lengths[i]
        fill[items] = at
    base = first + (int(group["_group"].iloc[0]) << 20 if len(group) else 0)
    return group.drop(columns="_group").assign(sequence_id=base + number, offset=offset, _fill=fill)


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024) -> DataFrame:
    """One row for each piece: pieces()'s columns, sequence_id and offset.

    Pieces are dealt evenly into groups of about GROUP rows, by row number, so equal ids or lengths make no large
    group; each is packed by itself. The pieces of bins that are not full go on to another round, for as long as that
    leaves fewer sequences; there the emptiest bins of all groups come together, then the next ones. The pieces are
    written once; the texts are tokenized once; a round brings the driver one row for each fill below capacity.

    Null texts are a piece of one id; a null doc_id stays null; rows that repeat are packed one by one; other columns
    of docs, whatever their names, are not read; no rows in, no rows out.
    """
    rows = cut(pieces(docs, path or tokenizer_file(), capacity))
    names = [*rows.columns]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, _fill bigint"

    def packed(some: DataFrame, round_: int) -> DataFrame:
        return cut(some.groupBy("_group").applyInPandas(lambda group: _pack(group, capacity, round_ << 50), schema))

    groups = max(1, -(-rows.count() // GROUP))
    now = packed(rows.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))), 0)
    done, round_ = [], 0
    while True:
        low = now.where(F.col("_fill") < capacity)
        fills = low.groupBy("_fill").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).orderBy("_fill").collect()
        bins = sum(r["tokens"] // r["_fill"] for r in fills)
        if bins <= -(-sum(r["tokens"] for r in fills) // capacity):
            done.append(now)  # so many sequences are needed
            break
        # The groups of each fill: the next one, or several where a fill has more pieces than a group takes.
        before = accumulate((r["n"] for r in fills), initial=0)
        spans = {r["_fill"]: (at // GROUP, -(-r["n"] // GROUP)) for r, at in zip(fills, before, strict=False)}
        of = F.create_map(*[x for f, (first, many) in spans.items() for x in (F.lit(f), F.array(F.lit(first), F.lit(many)))])[F.col("_fill")]
        again = packed(low.withColumn("_group", of[0] + F.pmod(F.xxhash64("sequence_id"), of[1])).select(*names, "_group"), round_ + 1)
        if again.where("offset = 0").count() >= bins:
            done.append(now)  # this round won nothing
            break
        done.append(now.where(F.col("_fill") >= capacity))
        now, round_ = again, round_ + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("_fill")
