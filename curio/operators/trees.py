"""JSON trees as rows of leaves, and what page states and API payloads say, chosen from leaves in columns.

A leaf knows the steps to it. Every question ("the first readable title, by the order of these keys, else of the tree")
is then a choice of the least leaf by (source, key, place of the object, way below the key), the same for all fields.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.functions import lists
from curio.functions.text import clean_original_text, clean_text, first_meaningful_line, html_to_formatted_text, once, plain_text_preview, trim, truncate_chars

FOUND = ["title", "description", "author", "image_url", "original_text"]
#: The keys by which an object is read as text or as an image.
TEXT_KEYS, WHOLE_KEYS, IMAGE_KEYS = ["text", "simpleText", "name", "title", "url"], ["text", "simpleText", "name", "title"], ["url", "urlDefault", "urlPre", "src"]
PICTURE_SIZES = ["largest", "large", "original", "bmiddle", "thumbnail"]

LEAVES = T.ArrayType(
    T.StructType(
        [
            T.StructField("source", T.IntegerType()), T.StructField("steps", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.IntegerType())]))),
            T.StructField("text", T.StringType()), T.StructField("plain", T.BooleanType()),
        ]
    )
)
_ARROW = pa.list_(pa.struct([("source", pa.int32()), ("steps", pa.list_(pa.struct([("key", pa.string()), ("at", pa.int32())]))), ("text", pa.string()), ("plain", pa.bool_())]))


def _no_number(name: str):
    raise ValueError(name)


def _leaves(tree, source: int) -> Iterator[dict]:
    """Texts and numbers of a tree with the steps to them; an object's entries in the order of their keys."""
    waiting = [([], tree)]
    while waiting:
        steps, value = waiting.pop()
        if isinstance(value, dict):
            waiting += [([*steps, {"key": k, "at": i}], value[k]) for i, k in reversed(list(enumerate(sorted(value))))]
        elif isinstance(value, list):
            waiting += [([*steps, {"key": None, "at": i}], v) for i, v in reversed(list(enumerate(value)))]
        elif isinstance(value, str):
            value.encode()  # half a surrogate pair is no text
            yield {"source": source, "steps": steps, "text": value, "plain": True}
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            yield {"source": source, "steps": steps, "text": json.dumps(value), "plain": False}


@F.arrow_udf(LEAVES)
def json_leaves(texts: pa.Array) -> pa.Array:
    """The leaves of each row's JSON texts. A text is preceded by "=" if all of it must be JSON, by "<" if what follows
    the JSON is something else. An array's elements are sources of their own, and those of an object's @graph come
    after it. What can't be parsed has no leaves."""
    out, decoder = [], json.JSONDecoder(parse_constant=_no_number)
    for row in texts.to_pylist():
        found, source = [], 0
        for text in row or []:
            try:
                tree, end = decoder.raw_decode(text, 1)
                if text[0] == "=" and text[end:].strip(" \t\n\r"):
                    continue
                graph = tree.get("@graph") if isinstance(tree, dict) else None
                trees = tree if isinstance(tree, list) else [tree, *graph] if isinstance(graph, list) else [tree]
                own = [leaf for i, t in enumerate(trees) for leaf in _leaves(t, source + i)]
            except (ValueError, RecursionError, AttributeError):
                continue
            found += own
            source += len(trees)
        out.append(found)
    return pa.array(out, _ARROW)


def _scripts(body: Column, attribute: str, value: str) -> Column:
    """What stands in the script elements with that attribute."""
    named = rf"(?is)<script\b[^>]*\b{attribute}\s*=\s*[\"']{value}[\"'][^>]*>(.*?)</script>"
    return F.transform(F.regexp_extract_all(body, F.lit(named), F.lit(1)), trim)


def _decoded(text: Column) -> Column:
    """Percent signs decoded; a text that isn't UTF-8 then stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _sources(body: Column, platform: str) -> Column:
    """The JSON texts of a platform's page in their order, as json_leaves() takes them."""
    parts = []
    for how, names in lists.PAGE_STATES[platform][0]:
        if how == "ld":
            parts.append(F.transform(_scripts(body, "type", r"application/ld\+json"), lambda t: F.concat(F.lit("="), t)))
        elif how == "script":
            parts += [F.transform(_scripts(body, "id", name), lambda t: F.concat(F.lit("="), _decoded(t))) for name in names]
        else:
            for name in names:
                rest = F.substring(body, F.locate(name, body) + len(name), F.char_length(body))
                at = F.locate("{", rest)
                parts.append(F.when((F.locate(name, body) > 0) & (at > 0), F.array(F.concat(F.lit("<"), F.substring(rest, at, F.char_length(rest))))).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def state_sources(body: Column, platform: Column) -> Column:
    """_sources() of the row's platform; none of other platforms."""
    out = F.when(platform.isNull() | body.isNull(), F.array().cast("array<string>"))
    for name in lists.PAGE_STATES:
        out = out.when(platform == name, _sources(body, name))
    return out.otherwise(F.array().cast("array<string>"))


def _order(rest: Column, keys: list[str], others: bool = False) -> Column:
    """The way below a key as numbers: an array's places, and for objects the rank of the key. others lets keys that
    have no rank follow, in their order."""
    named = F.array(*[F.lit(k) for k in keys])
    rank = lambda s: F.array_position(named, s["key"]).cast("int")
    return F.transform(rest, lambda s: F.when(s["key"].isNull(), s["at"]).when(rank(s) > 0, rank(s)).otherwise(len(keys) + 1 + s["at"] if others else F.lit(-1)))


def _some(text: Column) -> Column:
    """text, or null if it is empty."""
    return once(text, lambda t: F.when(t != "", t))


def _image(text: Column) -> Column:
    """A text as an image's URL, or null."""
    return once(clean_text(text), lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("http://") | u.startswith("https://"), u))


def _ranked(reads: Column, keys: Column, mode: str) -> Column:
    """The readable leaves of reads (key, parent, rest, text, plain) under one of keys, as (rank, parent, order, value,
    steps); mode is how a value is read: clean, whole or image."""
    names, others = {"clean": (TEXT_KEYS, False), "whole": (WHOLE_KEYS, False), "image": (IMAGE_KEYS, True)}[mode]
    value = {"clean": lambda c: _some(clean_text(c)), "whole": lambda c: _some(clean_original_text(c)), "image": _image}[mode]
    under = F.filter(reads, lambda r: F.array_contains(keys, r["key"]) & (r["plain"] if mode == "image" else F.lit(True)))
    told = F.transform(under, lambda r: F.struct(F.array_position(keys, r["key"]).alias("rank"), r["parent"].alias("parent"), _order(r["rest"], names, others).alias("order"), value(r["text"]).alias("value"), F.transform(r["rest"], lambda s: s["key"].isNotNull()).alias("named")))
    return F.filter(told, lambda r: r["value"].isNotNull() & ~F.array_contains(r["order"], -1))


def _first(reads: Column, keys: Column, mode: str) -> Column:
    return F.array_min(_ranked(reads, keys, mode))["value"]


def _joined(reads: Column, keys: Column) -> Column:
    """The first value that can be read as a whole text: an array's texts in lines, of an object the first key's.

    In order of their ways, a leaf follows the last one kept unless they part inside an object, where one key counts."""
    ranked = F.array_sort(_ranked(reads, keys, "whole"))

    def fold(state: Column, r: Column) -> Column:
        parts = F.array_position(F.zip_with(state["order"], r["order"], lambda a, b: ~a.eqNullSafe(b)), True).cast("int")
        follows = ~F.coalesce(F.get(r["named"], parts - 1), F.lit(True))
        return (
            F.when(state["value"].isNull(), F.struct(r["rank"].alias("rank"), r["parent"].alias("parent"), r["order"].alias("order"), r["value"].alias("value")))
            .when((state["rank"] == r["rank"]) & (state["parent"] == r["parent"]) & follows, F.struct(state["rank"].alias("rank"), state["parent"].alias("parent"), r["order"].alias("order"), F.concat(state["value"], F.lit("\n"), r["value"]).alias("value")))
            .otherwise(state)
        )

    start = F.struct(F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("array<int>").alias("parent"), F.lit(None).cast("array<int>").alias("order"), F.lit(None).cast("string").alias("value"))
    return F.aggregate(ranked, start, fold, lambda s: s["value"])


def _reads(leaves: Column, wanted: Column) -> Column:
    """Every place on the way to a leaf where a wanted key stands: (source, key, parent, rest, text, plain)."""

    def places(leaf: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(leaf["steps"]), F.lit(1))), lambda i: F.coalesce(F.array_contains(wanted, F.get(leaf["steps"], i - 1)["key"]), F.lit(False)))
        steps = leaf["steps"]
        return F.transform(
            at,
            lambda i: F.struct(
                leaf["source"].alias("source"), F.get(steps, i - 1)["key"].alias("key"), F.transform(F.slice(steps, F.lit(1), i - 1), lambda s: s["at"]).alias("parent"),
                F.slice(steps, i + 1, F.size(steps)).alias("rest"), leaf["text"].alias("text"), leaf["plain"].alias("plain"),
            ),
        )

    return F.flatten(F.transform(leaves, places))


def _keys(platform: Column, nth: int) -> Column:
    """A platform's key list: titles 1, descriptions 2, authors 3, images 4."""
    out = None
    for name, spec in lists.PAGE_STATES.items():
        words = F.array(*[F.lit(k) for k in spec[nth]])
        out = F.when(platform == name, words) if out is None else out.when(platform == name, words)
    return out.otherwise(F.array().cast("array<string>"))


def meaningful(found: Column) -> Column:
    """A struct of FOUND, or null if it says nothing."""
    return once(found, lambda f: F.when(F.coalesce(f["title"], f["description"], f["image_url"], f["original_text"]).isNotNull(), f))


def state_found(leaves: Column, platform: Column) -> Column:
    """What page states say (FOUND), or null. Of each field the first source that has it counts; sources after the one
    that completes title, description and image count for nothing."""

    def told(reads: Column, source: Column, keys: Column) -> Column:
        titles, descriptions, authors, images = (keys[c] for c in ("t", "d", "a", "i"))
        of = lambda f: once(F.filter(reads, lambda r: r["source"] == source), f)
        return of(
            lambda own: F.struct(
                F.coalesce(first_meaningful_line(_joined(own, titles)), _first(own, titles, "clean")).alias("title"), plain_text_preview(_first(own, descriptions, "clean")).alias("description"),
                truncate_chars(_some(plain_text_preview(_first(own, authors, "clean"))), 80).alias("author"), _first(own, images, "image").alias("image_url"),
                _some(html_to_formatted_text(_joined(own, descriptions))).alias("original_text"),
            )
        )

    def chosen(each: Column) -> Column:
        first = lambda c, rows: F.get(F.filter(rows, lambda s: s[c].isNotNull()), F.lit(0))[c]
        place = lambda c: F.array_position(F.transform(each, lambda s: s[c].isNotNull()), True)
        places = [place(c) for c in ("title", "description", "image_url")]
        last = F.when((places[0] > 0) & (places[1] > 0) & (places[2] > 0), F.greatest(*places)).otherwise(F.size(each).cast("long"))
        seen = F.slice(each, F.lit(1), last.cast("int"))
        whole = F.coalesce(first("original_text", seen), _some(clean_original_text(first("description", seen))))
        return F.struct(*[(whole if c == "original_text" else first(c, seen)).alias(c) for c in FOUND])

    def by_source(keys: Column) -> Column:
        sources = lambda reads: F.array_sort(F.array_distinct(F.transform(reads, lambda r: r["source"])))
        return once(_reads(leaves, F.concat(*[keys[c] for c in "tdai"])), lambda reads: F.transform(sources(reads), lambda s: told(reads, s, keys)))

    each = once(F.struct(*[_keys(platform, i + 1).alias(c) for i, c in enumerate("tdai")]), by_source)
    return meaningful(once(each, chosen))


def _at(leaves: Column, *path: str) -> Column:
    """Leaves at or below a path of keys, as the reads of its last key."""
    def along(leaf: Column) -> Column:
        out = F.lit(True)
        for i, key in enumerate(path):
            out = out & F.coalesce(F.get(leaf["steps"], F.lit(i))["key"] == key, F.lit(False))
        return out

    return F.transform(
        F.filter(leaves, along),
        lambda leaf: F.struct(F.lit(path[-1]).alias("key"), F.array().cast("array<int>").alias("parent"), F.slice(leaf["steps"], len(path) + 1, F.size(leaf["steps"])).alias("rest"), leaf["text"].alias("text"), leaf["plain"].alias("plain")),
    )


def _pictures(leaves: Column) -> Column:
    """The URLs below pic_infos: pictures in the order of their keys, of each the sizes in the order of PICTURE_SIZES."""
    sizes = F.array(*[F.lit(s) for s in PICTURE_SIZES])
    step = lambda leaf, i: F.get(leaf["steps"], F.lit(i))
    fits = lambda leaf: F.coalesce((step(leaf, 0)["key"] == "pic_infos") & step(leaf, 1)["key"].isNotNull() & F.array_contains(sizes, step(leaf, 2)["key"]) & (step(leaf, 3)["key"] == "url"), F.lit(False))
    return F.transform(
        F.filter(leaves, fits),
        lambda leaf: F.struct(F.lit("url").alias("key"), F.array(step(leaf, 1)["at"], F.array_position(sizes, step(leaf, 2)["key"]).cast("int")).alias("parent"), F.slice(leaf["steps"], 5, F.size(leaf["steps"])).alias("rest"), leaf["text"].alias("text"), leaf["plain"].alias("plain")),
    )


def payload_found(leaves: Column, platform: Column, payload: Column) -> Column:
    """What an answer's or a status's API payload says (FOUND), or null."""

    def read(mode: str, *path: str) -> Column:
        keys = F.array(F.lit(path[-1]))
        return _joined(_at(leaves, *path), keys) if mode == "whole" else _first(_at(leaves, *path), keys, mode)

    said = lambda c: F.coalesce(*c)
    answer = {
        "title": read("clean", "question", "title"), "author": read("clean", "author", "name"), "description": said([read("clean", "excerpt"), truncate_chars(plain_text_preview(read("clean", "content")), 1_200)]),
        "original_text": once(read("whole", "content"), lambda t: F.when(t.isNotNull(), truncate_chars(html_to_formatted_text(t), 12_000)).otherwise(read("whole", "excerpt"))),
        "image_url": said([read("image", "thumbnail"), read("image", "author", "avatar_url")]),
    }
    status = {
        "author": read("clean", "user", "screen_name"), "description": said([read("clean", "text_raw"), plain_text_preview(read("clean", "text"))]), "original_text": said([read("whole", "text_raw"), html_to_formatted_text(read("whole", "text"))]),
        "image_url": said([_first(_pictures(leaves), F.array(F.lit("url")), "image"), read("image", "page_info", "page_pic")]),
    }
    row = lambda values: F.struct(*[values[c].alias(c) for c in FOUND])
    # A status is titled by what it says.
    titled = once(F.struct(*[v.alias(c) for c, v in status.items()]), lambda f: F.struct(truncate_chars(f["description"], 80).alias("title"), *[f[c].alias(c) for c in FOUND[1:]]))
    failed = F.coalesce(F.array_contains(F.json_object_keys(payload), "error"), F.lit(False))
    return meaningful(F.when(platform == "知乎", row(answer)).when((platform == "微博") & ~failed, titled))


@functools.cache
def _state_column(body: str, platform: str) -> Column:
    """Thousands of expressions, which a stream's batches need not put together again."""
    return once(json_leaves(state_sources(F.col(body), F.col(platform))), lambda leaves: state_found(leaves, F.col(platform)))


@functools.cache
def _payload_column(platform: str, payload: str) -> Column:
    leaves = json_leaves(F.array_compact(F.array(F.concat(F.lit("="), F.col(payload)))))
    return once(leaves, lambda own: payload_found(own, F.col(platform), F.col(payload)))


def with_page_state(rows: DataFrame, name: str, body: str = "body", platform: str = "platform") -> DataFrame:
    """rows with the struct FOUND of a page's state, null where there is none. A generator of one row keeps later
    filters and columns from working it out again."""
    return rows.select("*", F.explode(F.array(_state_column(body, platform))).alias(name))


def with_api_payload(rows: DataFrame, name: str, platform: str = "platform", payload: str = "payload") -> DataFrame:
    """rows with the struct FOUND of an API payload, null where it says nothing."""
    return rows.select("*", F.explode(F.array(_payload_column(platform, payload))).alias(name))
