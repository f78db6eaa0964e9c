"""Media columns: ISO media containers are written, walked and described without decoding payloads."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curio.llm.common import slices, utf8

#: The boxes that hold boxes, with the bytes of their own fields before the first.
CONTAINERS = {
    b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0,
    b"mvex": 0, b"moof": 0, b"traf": 0, b"mfra": 0, b"meta": 4, b"stsd": 8, b"dref": 8,
}
FRAME = 64  # bytes of a sample written here: 8 by 8 pixels of 8 bits
DEPTH = 16


def walk(data: bytes, begin: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of box types, begin, end of the content) of every box, outer ones first.

    Takes 64-bit sizes and a last box that runs to the end. A size that leaves the enclosing box ends the walk there.
    """
    end = len(data) if end is None else end
    while end - begin >= 8:
        size, kind, head = *struct.unpack_from(">I4s", data, begin), 8
        if size == 1 and end - begin >= 16:
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            return
        yield (*path, kind), begin + head, begin + size
        if kind in CONTAINERS and len(path) < DEPTH:
            yield from walk(data, begin + head + CONTAINERS[kind], begin + size, (*path, kind))
        begin += size


def _table(data: bytes, at: tuple[int, int] | None, fields: int, kind: str = ">u4") -> np.ndarray:
    """The rows of a table box: version and flags, a count, and `fields` numbers a row."""
    if at is None or at[1] - at[0] < 8:
        return np.zeros((0, fields), np.int64)
    width = np.dtype(kind).itemsize * fields
    n = min(struct.unpack_from(">I", data, at[0] + 4)[0], (at[1] - at[0] - 8) // width)
    return np.frombuffer(data, kind, n * fields, at[0] + 8).reshape(n, fields).astype(np.int64)


def _timing(data: bytes, at: tuple[int, int]) -> tuple[int, int]:
    """Timescale and duration of an mdhd or mvhd box."""
    long = data[at[0]] == 1
    if at[1] - at[0] < (32 if long else 20):
        return 0, 0
    return struct.unpack_from(">IQ", data, at[0] + 20) if long else struct.unpack_from(">II", data, at[0] + 12)


def _sizes(data: bytes, at: tuple[int, int] | None) -> np.ndarray:
    if at is None or at[1] - at[0] < 12:
        return np.zeros(0, np.int64)
    same, n = struct.unpack_from(">II", data, at[0] + 4)
    if same:
        return np.full(min(n, len(data)), same, np.int64)
    return np.frombuffer(data, ">u4", min(n, (at[1] - at[0] - 12) // 4), at[0] + 12).astype(np.int64)


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]], entry: bytes | None) -> dict:
    """Codec, timing, and offset, size and sync flag of each sample of a track."""
    sizes = _sizes(data, boxes.get(b"stsz"))
    chunks = _table(data, boxes.get(b"stco"), 1)[:, 0] if b"stco" in boxes else _table(data, boxes.get(b"co64"), 1, ">u8")[:, 0]
    runs = _table(data, boxes.get(b"stsc"), 3)
    per_chunk = np.zeros(len(chunks), np.int64)
    for i, (first, n, _) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunks)
        per_chunk[max(first - 1, 0) : max(last, 0)] = min(n, len(sizes))
    per_chunk = np.diff(np.minimum(np.concatenate([[0], np.cumsum(per_chunk)]), len(sizes)))
    sizes = sizes[: per_chunk.sum()]
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]  # bytes of the samples before each
    firsts = np.cumsum(per_chunk) - per_chunk
    used = per_chunk > 0
    base = np.repeat(chunks[used] - before[firsts[used]], per_chunk[used]) if len(sizes) else sizes
    sync = np.ones(len(sizes), bool)
    if b"stss" in boxes:
        keys = _table(data, boxes[b"stss"], 1)[:, 0] - 1
        sync[:] = False
        sync[keys[(keys >= 0) & (keys < len(sizes))]] = True
    scale, duration = _timing(data, boxes[b"mdhd"]) if b"mdhd" in boxes else (0, 0)
    times = _table(data, boxes.get(b"stts"), 2)
    if len(times):
        duration = int((times[:, 0] * times[:, 1]).sum())
    kind = data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12] if b"hdlr" in boxes else b""
    return {"codec": (entry or b"").decode("latin-1"), "kind": kind.decode("latin-1"), "timescale": int(scale), "duration": int(duration), "offset": base + before if len(sizes) else sizes, "size": sizes, "sync": sync}


def tracks(data: bytes) -> list[dict]:
    """The tracks of a container, as _track(); [] for bytes that are none."""
    found: list[tuple[dict, list]] = []
    for path, begin, end in walk(data):
        if path == (b"moov", b"trak"):
            found.append(({}, []))
        elif found and path[:2] == (b"moov", b"trak"):
            if path[-2:-1] == (b"stsd",):
                found[-1][1].append(path[-1])
            else:
                found[-1][0].setdefault(path[-1], (begin, end))
    return [_track(data, boxes, entries[0] if entries else None) for boxes, entries in found]


def describe(data: bytes) -> dict:
    """What the media column keeps of a container: for each track codec, kind, seconds, samples and the byte ranges of
    its keyframes, neighbours in the file joined. Sample contents are never looked at."""
    out = []
    for t in tracks(data):
        begin, size = t["offset"][t["sync"]], t["size"][t["sync"]]
        new = np.ones(len(begin), bool)
        new[1:] = begin[1:] != begin[:-1] + size[:-1]
        at = np.flatnonzero(new)
        ranges = np.stack([begin[at], np.add.reduceat(size, at)], 1).tolist() if len(at) else []
        out.append({"codec": t["codec"], "kind": t["kind"], "seconds": t["duration"] / t["timescale"] if t["timescale"] else None, "samples": len(t["size"]), "keyframes": int(t["sync"].sum()), "ranges": ranges})
    return {"tracks": out}


def samples(data: bytes) -> bytes:
    """The stored bytes of the first track, sample after sample, read through its sample tables."""
    found = tracks(data)
    if not found:
        return b""
    offset, size = found[0]["offset"], found[0]["size"]
    if not len(size):
        return b""
    new = np.ones(len(size), bool)
    new[1:] = offset[1:] != offset[:-1] + size[:-1]
    at = np.flatnonzero(new)
    return b"".join(data[o : o + n] for o, n in zip(offset[at].tolist(), np.add.reduceat(size, at).tolist(), strict=True))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def store(payload: bytes, every: int = 16, per_chunk: int = 64, fps: int = 25) -> bytes:
    """An ISO media file whose frames of 8 by 8 pixels of 8 bits hold the payload, of a positive multiple of FRAME
    bytes: an uncompressed grey video track, each `every`-th frame a sync sample, chunks of `per_chunk` frames with a
    free box of 8 bytes after each. Equal payloads give equal files."""
    n = len(payload) // FRAME
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    step = per_chunk * FRAME
    pieces = [payload[i : i + step] for i in range(0, len(payload), step)]
    gap = _box(b"free")
    media = _box(b"mdat", *[x for p in pieces for x in (p, gap)])
    first = len(kind) + 8
    offsets = first + np.arange(len(pieces), dtype=np.int64) * (step + len(gap))
    keys = np.arange(1, n + 1, every)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), b"\0" * 32, struct.pack(">Hh", 8 + 32, -1))
    runs = [(1, per_chunk, 1)] if n % per_chunk == 0 or len(pieces) == 1 else [(1, per_chunk, 1), (len(pieces), n % per_chunk, 1)]
    if len(pieces) == 1:
        runs = [(1, n, 1)]
    table = lambda kind, rows: _full(kind, struct.pack(">I", len(rows)), np.asarray(rows, ">u4").tobytes())
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        table(b"stts", [(n, 1)]),
        table(b"stss", keys),
        table(b"stsc", runs),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
        table(b"stco", offsets),
    )
    minf = _box(b"minf", _full(b"vmhd", b"\0" * 8, flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, fps, n, 0x55C4, 0)), _full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 13), minf)
    tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), b"\0" * 16, matrix, struct.pack(">II", 8 << 16, 8 << 16), flags=3)
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, fps, n, 0x10000, 0x100), b"\0" * 10, matrix, b"\0" * 24, struct.pack(">I", 2))
    return kind + media + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of FRAME."""
    return data + b"\0" * (-len(data) % FRAME or (0 if data else FRAME))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text (null: empty) as UTF-8 in a container of its own. Rows stay where they
    are; rows that repeat, null ids and long texts are stored like any other, so equal texts are equal containers; other
    columns of docs, whatever their names, are not read; no rows in, no rows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = utf8(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([store(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, media binary")


FEATURES = (
    "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
    "codec string, duration double, n_keyframes bigint, keyframe_ranges array<struct<offset: bigint, length: bigint>>"
)


def probe(stored: DataFrame, media: str = "media") -> DataFrame:
    """stored without its media column, with what FEATURES names, of the container in that column.

    codec, duration (seconds) and keyframe_ranges describe the first track; payload_* and tail_crc32 are digests of
    its samples' bytes as stored, read through the sample tables; feature is a JSON object of all tracks. Null or
    broken containers have no tracks: null codec and duration, no bytes. Columns of stored that clash are replaced; rows
    that repeat are described one by one; no rows in, no rows out.
    """
    names = [f.split()[0] for f in FEATURES.split(", ") if not f.startswith("length")]
    rest = [c for c in stored.columns if c != media and c not in names]
    kinds = dict(stored.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, media):
            rows = []
            for data in utf8(batch, media):
                found, payload = describe(data)["tracks"], samples(data)
                one = found[0] if found else {"codec": None, "seconds": None, "keyframes": 0, "ranges": []}
                rows.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(data), hashlib.sha256(data).hexdigest(),
                    json.dumps(found, separators=(",", ":")), one["codec"], one["seconds"], one["keyframes"], [{"offset": o, "length": n} for o, n in one["ranges"]],
                ))
            kinds_out = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))]
            values = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds_out, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in rest], *values], names=[*rest, *names])

    return stored.select(*rest, media).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], FEATURES]))
