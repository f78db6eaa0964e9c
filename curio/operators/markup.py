"""Markup as rows: tags with their places, nesting by running depth, blocks by the span of tags that they contain.

A body is split at its tags. Only the names of the tags that open or close something that counts are exploded, a row
each, by the hash of the body, so that like bodies are read once and no text is moved with them. Windows over those rows
give each element its span; the few spans that can count go back to the body, where the text between the tags is cut out.
It is no browser's tree. An element that was not closed ends so:

- p before the next tag, start or end, of p or of an element that stands around paragraphs (AROUND);
- li before the next li or end of li of the same depth of lists, or at the end of that list;
- title, h1 and h2 before the next tag of their own name.

A comment, script or style is one tag, whatever stands in it; what a script says belongs to the block around it. A tag
that the body ends in is none. A null or empty body has no title, description, author or image, and empty texts.
"""

from __future__ import annotations

import html
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curio.functions.text import clean_original_text, clean_text, first_non_empty, once

#: A tag, as Java and RE2 read it. Quoted values may hold a >; of a tag with over 200 of them the first > is the end.
TAG = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script[^>]*>|\z)|<style\b[^>]*>.*?(?:</style[^>]*>|\z)"
    r"""|</?[a-z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*){0,200}>|<[a-z/!?][^>]*(?:>|\z)"""
)
NAME = "^<(/?[A-Za-z][A-Za-z0-9]*)"
SCRIPT = r"(?is)^<(?:script|style)\b[^>]*>(.*?)(?:</(?:script|style)[^>]*>)?\z"
ATTRIBUTE = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
AROUND = (
    "address article aside blockquote body caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol pre section table tbody td "
    "tfoot th thead tr ul"
).split()
#: Attributes of meta entries that count.
META = ("name", "property", "content")
#: As many elements of a kind as any text looks at.
MOST = 120
#: Kinds of blocks in the order in which a page's text is made of them: name, and the element around it.
GROUPS = (("p", "article"), ("p", "main"), ("p", None), ("h1", None), ("h2", None), ("li", None))

_LEGACY = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
REFERENCE = rf"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;|{_LEGACY})"
#: What names and the lowest numbers stand for, as one text: a map of thousands of literals would take the planner long.
_COMMON = ("amp;", "quot;", "lt;", "gt;", "nbsp;")
_MEANINGS = "\x01" + "".join(f"{n}={v}\x01" for n, v in [*((n, html5[n]) for n in _COMMON), *sorted(html5.items()), *((f"#{n}", html.unescape(f"&#{n};")) for n in range(160))])


def decoded(c: Column) -> Column:
    """Character references replaced by what they stand for, each once; unknown names stay as they are."""
    def named(key: Column) -> Column:
        whole = F.concat(F.lit("\x01"), key, F.lit("="))
        found = lambda at: F.when(at > 0, F.substring_index(F.substr(F.lit(_MEANINGS), at + F.char_length(whole), F.lit(12)), "\x01", 1))
        return once(F.position(whole, F.lit(_MEANINGS)), found)

    def meaning(ref: Column) -> Column:
        body = F.regexp_replace(ref, "^&#?[xX]?|;$", "")
        number = F.when(ref.rlike("^&#[xX]"), F.conv(body, 16, 10)).otherwise(body)
        point = F.when(F.length(body) > 9, F.lit(1 << 30)).otherwise(number.cast("long"))
        said = lambda n: F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("�")).when(n < 160, named(F.concat(F.lit("#"), n.cast("string")))).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        return F.when(ref.startswith("&#"), once(point, said)).otherwise(F.coalesce(named(F.substring(ref, 2, 1 << 30)), ref))

    def replaced(s: Column) -> Column:
        refs = F.transform(F.regexp_extract_all(s, F.lit(REFERENCE), F.lit(0)), meaning)
        return F.array_join(F.zip_with(F.split(s, REFERENCE, -1), refs, lambda text, ref: F.concat(text, F.coalesce(ref, F.lit("")))), "")

    return F.when(c.contains("&"), once(c, replaced)).otherwise(c)


def tags_of(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(TAG), F.lit(0))


def element_spans(bodies: DataFrame) -> DataFrame:
    """(key, elements): of bodies (key, body) the first MOST of each kind in the order of the page, as structs of place
    (the number of the tag that opens it, from 0), end (of the first tag that is not in it, null at the body's end), name,
    article, main (whether it stands in one)."""
    wanted = F.lit("|".join(["", *AROUND, "p", "title", ""]))
    name = lambda t: F.lower(F.regexp_extract(t, NAME, 1))
    counts = lambda m: (m["name"] != "") & F.contains(wanted, F.concat(F.lit("|"), F.replace(m["name"], F.lit("/"), F.lit("")), F.lit("|")))
    marks = F.filter(F.transform(tags_of(F.col("body")), lambda t, i: F.struct(i.alias("place"), name(t).alias("name"))), counts)
    once_each = bodies.select("key", marks.alias("marks")).groupBy("key").agg(F.any_value("marks").alias("marks"))
    tags = once_each.select("key", F.explode("marks").alias("m")).select("key", "m.place", "m.name")

    upto = W.partitionBy("key").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    later = lambda *keys: W.partitionBy("key", *keys).orderBy(F.desc("place")).rowsBetween(W.unboundedPreceding, -1)
    kinds = {"article": ["article"], "main": ["main"], "lists": ["ul", "ol"]}
    step = lambda names: F.when(F.col("name").isin(names), 1).when(F.col("name").isin([f"/{n}" for n in names]), -1).otherwise(0)
    tags = tags.withColumns({f"_{k}": F.sum(step(names)).over(upto) for k, names in kinds.items()})
    # An end without a start closes nothing: depth counts from the lowest sum so far.
    tags = tags.withColumns({k: F.col(f"_{k}") - F.least(F.lit(0), F.min(f"_{k}").over(upto)) for k in kinds}).drop(*[f"_{k}" for k in kinds])
    tags = tags.withColumn("level", F.col("lists") + F.when(F.col("name").isin("/ul", "/ol"), 1).otherwise(0))
    ends_p = F.col("name").isin([x for n in ("p", *AROUND) for x in (n, f"/{n}")])
    after = lambda when, *keys: F.min(F.when(when, F.col("place"))).over(later(*keys))
    tags = tags.withColumns({"_p": after(ends_p), **{f"_{n}": after(F.col("name").isin(n, f"/{n}")) for n in ("title", "h1", "h2")}})
    tags = tags.withColumn("_li", after(F.col("name").isin("li", "/li", "/ul", "/ol"), "level"))
    end = F.coalesce(*[F.when(F.col("name") == n, F.col(f"_{n}")) for n in ("p", "title", "h1", "h2", "li")])
    found = tags.where(F.col("name").isin("p", "title", "h1", "h2", "li")).select("key", "place", end.alias("end"), "name", (F.col("article") > 0).alias("article"), (F.col("main") > 0).alias("main"))
    nth = W.partitionBy("key", "name").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    near = lambda when: when & (F.count(F.when(when, 1)).over(nth) <= MOST)
    found = found.withColumn("near", near(F.lit(True)) | near(F.col("article")) | near(F.col("main"))).where("near")
    return found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "end", "name", "article", "main"))).alias("elements"))


def _meta(tags: Column) -> Column:
    """The page's meta entries: array of (name, property, content), null where there is no such attribute."""

    def entry(tag: Column) -> Column:
        given = F.regexp_extract_all(F.regexp_replace(tag, "(?i)^<meta", ""), F.lit(ATTRIBUTE), F.lit(0))
        named = lambda n: F.try_element_at(F.filter(given, lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == n), F.lit(1))
        value = lambda a: decoded(F.regexp_replace(F.regexp_replace(a, r"^[^=]*(=\s*|\z)", ""), r"""^["']|["']\z""", ""))
        values = F.transform(F.transform(F.array(*map(F.lit, META)), named), value)
        return once(values, lambda v: F.struct(*[v[i].alias(n) for i, n in enumerate(META)]))

    return F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<meta[\s/>]")), entry)


def _blocks(chunks: Column, joint: str, enough: int, cap: int = 12_000) -> Column:
    """Chunks (nth, text) of 12 characters or more, each once, joined: another as long as the text isn't over cap, and
    another group as long as it isn't over enough."""
    state = F.struct(F.lit(0).alias("size"), F.lit(-1).alias("nth"), F.lit(0).alias("base"), F.array().cast("array<string>").alias("said"))

    def take(s: Column, x: Column) -> Column:
        base = F.when(s["nth"] == x["nth"], s["base"]).otherwise(s["size"])
        new = (F.char_length(x["text"]) >= 12) & (base <= enough) & (s["size"] <= cap) & ~F.array_contains(s["said"], x["text"])
        size = s["size"] + F.char_length(x["text"]) + F.when(s["size"] > 0, len(joint)).otherwise(0)
        return F.struct(F.when(new, size).otherwise(s["size"]).alias("size"), x["nth"].alias("nth"), base.alias("base"), F.when(new, F.array_append(s["said"], x["text"])).otherwise(s["said"]).alias("said"))

    return F.aggregate(chunks, state, take, lambda s: F.array_join(s["said"], joint))


def with_page_metadata(rows: DataFrame, body: str = "body", name: str = "page") -> DataFrame:
    """rows with a struct of title, description, author, image_url, content_text and original_text: what the page says."""
    keyed = rows.withColumn("_body", F.coalesce(body, F.lit(""))).withColumn("_key", F.sha2("_body", 256))
    spans = element_spans(keyed.select(F.col("_key").alias("key"), F.col("_body").alias("body"))).withColumnRenamed("elements", "_elements")
    joined = keyed.join(spans, F.col("_key") == F.col("key"), "left")

    raw = lambda tag, text: F.when(tag.rlike(r"(?i)^<(script|style)\b"), F.concat(F.regexp_extract(tag, SCRIPT, 1), F.lit(" "), text)).otherwise(text)
    texts = F.zip_with(tags_of(F.col("_body")), F.slice(F.split("_body", TAG, -1), 2, 1 << 30), raw)
    said = lambda data, e: F.array_join(F.slice(data, e["place"] + 1, F.coalesce(e["end"], F.size(data)) - e["place"]), " ")
    told = once(texts, lambda data: F.transform("_elements", lambda e: F.struct(*[e[c].alias(c) for c in ("name", "article", "main")], decoded(said(data, e)).alias("text"))))
    none = F.array().cast("array<struct<name:string,article:boolean,main:boolean,text:string>>")
    parts = joined.select(*rows.columns, F.struct(F.coalesce(told, none).alias("elements"), _meta(tags_of(F.col("_body"))).alias("meta")).alias("_parts"))

    def page(p: Column) -> Column:
        elements, meta = p["elements"], p["meta"]

        def text(clean, most: int, joint: str, enough: int) -> Column:
            cleaned = F.transform(elements, lambda e: F.struct(e["name"].alias("name"), e["article"].alias("article"), e["main"].alias("main"), clean(e["text"]).alias("text")))
            fitting = lambda held, kind, inside: F.slice(F.filter(held, lambda e: (e["name"] == kind) & (e[inside] if inside else F.lit(True))), 1, most)
            group = lambda held, nth, of: F.transform(fitting(held, *of), lambda e: F.struct(F.lit(nth).alias("nth"), e["text"].alias("text")))
            return once(cleaned, lambda held: _blocks(F.concat(*[group(held, n, of) for n, of in enumerate(GROUPS)]), joint, enough))

        first = lambda kind: clean_text(F.try_element_at(F.filter(elements, lambda e: e["name"] == kind), F.lit(1))["text"])
        entry = lambda key, value: F.try_element_at(F.filter(meta, lambda m: (m[key] == value) & m["content"].isNotNull()), F.lit(1))["content"]
        content = text(clean_text, 80, "\n", 1_500)
        original = text(clean_original_text, MOST, "\n\n", 2_000)
        return once(content, lambda shown: F.struct(
            first_non_empty(entry("property", "og:title"), entry("name", "twitter:title"), first("title"), first("h1")).alias("title"),
            first_non_empty(entry("property", "og:description"), entry("name", "description"), entry("name", "twitter:description")).alias("description"),
            first_non_empty(entry("name", "author"), entry("property", "article:author")).alias("author"),
            first_non_empty(entry("property", "og:image"), entry("name", "twitter:image")).alias("image_url"),
            shown.alias("content_text"), F.when(shown == "", F.lit("")).otherwise(original).alias("original_text"),
        ))

    return parts.select(*rows.columns, once("_parts", page).alias(name))
