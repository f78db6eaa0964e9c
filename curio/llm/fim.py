"""Fill-in-the-middle by a piece table: documents stay as they are, descriptors over them move."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curio.llm.common import column, slices

#: The sentinels, in the order in which they stand in their buffer; each is as long as any other.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: For each form the order of prefix, middle and suffix (0, 1, 2), each after its own sentinel. A plain text has none.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
MARKS = (PREFIX, MIDDLE, SUFFIX)
PIECES = "array<struct<buffer:string,start:bigint,length:bigint>>"


def _draw(key: Column, nth: int) -> Column:
    """The nth (from 1) 32 bits of a key's SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 8 * nth - 7, 8), 16, 10).cast("long")


def _piece(buffer: str, start: Column, length: Column) -> Column:
    return F.struct(F.lit(buffer).alias("buffer"), start.cast("long").alias("start"), length.cast("long").alias("length"))


def describe(docs: DataFrame, epoch: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """docs (doc_id, text) with n, form, prefix_chars, middle_chars and pieces, the piece table of the output.

    The two cuts of a text split its one descriptor into three: prefix, middle and suffix, of code points; draws from
    the hash of "epoch:doc_id" place them. The form permutes the descriptors and puts one of a sentinel before each.
    Descriptors name a buffer ("text" or "marks", which never change), the first byte and the number of bytes. A null
    text counts as empty, a null doc_id as no digits. Empty texts, texts with a sentinel in them and plain_from and over
    of 100 draws are plain: one descriptor, no cuts. Equal ids with equal texts get equal pieces; no rows in, no rows
    out. Only doc_id and text are read, so other columns can have any name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat(F.lit(f"{epoch}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = docs.select("doc_id", text.alias("text"), F.char_length(text).cast("long").alias("n"), *[_draw(key, i).alias(f"h{i}") for i in range(1, 5)])
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.col("text").contains(mark)
    form = F.when((F.col("n") == 0) | marked | (F.col("h3") % 100 >= plain_from), "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cut = drawn.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))
    bytes_to = lambda c: F.octet_length(F.substring("text", F.lit(1), F.col(c).cast("int"))).cast("long")
    split = cut.select("*", bytes_to("first").alias("_a"), bytes_to("second").alias("_b"), F.octet_length("text").cast("long").alias("_z"))
    parts = [(F.lit(0), F.col("_a")), (F.col("_a"), F.col("_b") - F.col("_a")), (F.col("_b"), F.col("_z") - F.col("_b"))]

    def arranged(order: tuple[int, ...]) -> Column:
        mark = lambda i: _piece("marks", F.lit(SENTINELS.index(MARKS[i])), F.lit(len(MARKS[i])))
        return F.array(*[x for i in order for x in (mark(i), _piece("text", *parts[i]))])

    pieces = F.when(F.col("form") == "psm", arranged(ORDERS["psm"])).when(F.col("form") == "spm", arranged(ORDERS["spm"])).otherwise(F.array(_piece("text", F.lit(0), F.col("_z"))))
    moved = F.col("form") != "plain"
    return split.select(
        "doc_id", "text", "n", "form", F.when(moved, F.col("first")).alias("prefix_chars"), F.when(moved, F.col("second") - F.col("first")).alias("middle_chars"), pieces.cast(PIECES).alias("pieces")
    )


def render(described: DataFrame) -> DataFrame:
    """described with output, the text that its pieces spell."""
    marks, text = F.lit(SENTINELS).cast("binary"), F.col("text").cast("binary")

    def spelt(i: int) -> Column:
        p = F.get("pieces", F.lit(i))
        some = lambda b: F.substring(b, (p["start"] + 1).cast("int"), p["length"].cast("int"))
        return F.when(p.isNull(), F.lit("").cast("binary")).when(p["buffer"] == "marks", some(marks)).otherwise(some(text))

    return described.withColumn("output", F.concat(*[spelt(i) for i in range(2 * len(MARKS))]).cast("string"))


def undo(rendered: DataFrame) -> DataFrame:
    """rendered with restoring, the piece table over output that spells the text. It reads output and form only.

    A text that was cut has no sentinel, and none can begin or end inside another, so the first of each kind is the one
    that was put there. They cut output; the inverse of the form's permutation brings prefix, middle and suffix back in
    order, and the descriptors of the sentinels are left out."""
    output, end = F.col("output"), F.octet_length("output").cast("long")

    def back(order: tuple[int, ...]) -> Column:
        at = {i: F.octet_length(F.substring(output, F.lit(1), (F.locate(MARKS[i], output) - 1).cast("int"))).cast("long") for i in order}
        until = {i: at[order[k + 1]] if k + 1 < len(order) else end for k, i in enumerate(order)}
        inverse = sorted(range(len(order)), key=order.__getitem__)
        return F.array(*[_piece("output", at[i] + len(MARKS[i]), until[i] - at[i] - len(MARKS[i])) for i in (order[k] for k in inverse)])

    pieces = F.when(F.col("form") == "psm", back(ORDERS["psm"])).when(F.col("form") == "spm", back(ORDERS["spm"])).otherwise(F.array(_piece("output", F.lit(0), end)))
    return rendered.withColumn("restoring", pieces.cast(PIECES))


def _digests(batches: Iterator[pa.RecordBatch], tables: list[tuple[str, str]], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Each hash reads its pieces one after another from the buffers; what they spell is never put together."""
    marks = memoryview(SENTINELS.encode())
    for batch in slices(batches):
        found = {}
        buffers = {c: [memoryview(v.as_buffer()) for v in column(batch, c).cast(pa.binary())] for c in ("text", "output") if c in batch.schema.names}
        for pieces, name in tables:
            values = []
            for i, row in enumerate(column(batch, pieces).to_pylist()):
                digest = hashlib.sha256()
                for p in row:
                    buffer = marks if p["buffer"] == "marks" else buffers[p["buffer"]][i]
                    digest.update(buffer[p["start"] : p["start"] + p["length"]])
                values.append(digest.hexdigest())
            found[name] = pa.array(values, pa.string())
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), *found.values()], [*keep, *found])


def hashed(rows: DataFrame, tables: dict[str, str], keep: list[str]) -> DataFrame:
    """The columns keep of rows, and for each (column of pieces: name) the SHA-256 of the bytes that they spell. rows have
    the buffers that pieces name: text, and output where it is there. A worker holds slices of about 2 MB of texts; one
    that is longer stands alone."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep], *[f"`{name}` string" for name in tables.values()]])
    ordered = [f.name for f in rows.schema if f.name in keep]
    buffers = [c for c in ("text", "output") if c in rows.columns and c not in keep]
    return rows.select(*ordered, *buffers, *tables).mapInArrow(lambda batches: _digests(batches, list(tables.items()), ordered), schema)


def fill_in_middle(docs: DataFrame, epoch: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the training texts, see describe(). restored() takes them back."""
    return render(describe(docs, epoch, plain_from, spm_below)).drop("text", "pieces")


def restored(outputs: DataFrame) -> DataFrame:
    """outputs (form, output and other columns) with restored, the text that was cut."""
    binary = F.col("output").cast("binary")
    some = lambda i: F.substring(binary, (F.get("restoring", F.lit(i))["start"] + 1).cast("int"), F.get("restoring", F.lit(i))["length"].cast("int"))
    spelt = F.concat(*[F.coalesce(some(i), F.lit("").cast("binary")) for i in range(len(MARKS))])
    return undo(outputs).withColumn("restored", spelt.cast("string")).drop("restoring")
