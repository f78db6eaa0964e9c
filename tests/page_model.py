"""A page read tag by tag on a stack, and text rules on single strings: what the column forms are held against."""

import json
import re
from collections.abc import Callable
from html.parser import HTMLParser

_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_WS}]+")
_RUN_IN_LINE = re.compile(f"[{_WS.replace(chr(10), '')}]+")


# Text, as the column functions of the same names, for values that only turn up inside a page.
def _line(s: str) -> str:
    return _RUN.sub(" ", s).strip(" ")


def _clean(s: str) -> str:
    return _line(s.replace("&nbsp;", " ").replace("&amp;", "&"))


def _original(s: str) -> str:
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("\r\n", "\n"), ("\r", "\n")):
        s = s.replace(entity, plain)
    s = re.sub(" ?\n ?", "\n", _RUN_IN_LINE.sub(" ", s))
    return re.sub("\n{2,}", "\n\n", s).strip(" \n")


def _cut(s: str, n: int) -> str:
    return s[:n] + "..." if len(s) > n else s


def _preview(s: str) -> str:
    return _clean(re.sub("<[^>]+>", " ", s))


def _formatted(s: str) -> str:
    s = re.sub("<br(/| /)?>", "\n", s.replace("\r\n", "\n").replace("\r", "\n"))
    s = re.sub(r"</?(p|div|section|article|li|h[1-6])\b[^>]*>", "\n", s, flags=re.I)
    return _original(re.sub("<[^>]+>", " ", s))


def _first_line(s: str) -> str | None:
    lines = (x.strip(_WS) for x in s.split("\n"))
    return next((_cut(x, 120) for x in lines if len(x) >= 4 and not x.startswith("http")), None)


class _Page(HTMLParser):
    """A page's meta entries, and the text of the elements that carry content, with the elements around them.

    No tree of a browser: void elements and raw text are known, and a new block or item closes an open p or li; what is
    left open at the end of its parent ends there.
    """

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
    WANTED = frozenset("title h1 h2 p li".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: list[dict] = []
        self.found: list[tuple[str, frozenset, list[str]]] = []
        self.open: list[tuple[str, list[str] | None]] = []

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "meta":
            self.meta.append({k: v or "" for k, v in reversed(attrs)})
        names = [t for t, _ in self.open]
        if tag in self.CLOSES_P and "p" in names:
            self._close("p")
        if tag == "li" and "li" in names and not {"ul", "ol"} & set(names[len(names) - names[::-1].index("li") :]):
            self._close("li")
        if tag not in self.VOID:
            texts = [] if tag in self.WANTED else None
            if texts is not None:
                self.found.append((tag, frozenset(t for t, _ in self.open), texts))
            self.open.append((tag, texts))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        for _, texts in self.open:
            if texts is not None:
                texts.append(data)

    def content(self, key: str, value: str) -> str | None:
        """The first content of a meta entry whose attribute key is value, trimmed; null if empty."""
        got = next((m["content"] for m in self.meta if m.get(key) == value and "content" in m), None)
        return (got or "").strip(_WS) or None

    def text(self, tag: str) -> str | None:
        got = next((x for t, _, x in self.found if t == tag), None)
        return _clean(" ".join(got)) or None if got is not None else None

    def blocks(self, most: int, clean: Callable[[str], str], joint: str, enough: int, cap: int = 12_000) -> str:
        chunks: list[str] = []
        seen: set[str] = set()
        size = 0
        for tag, inside in (("p", "article"), ("p", "main"), ("p", None), ("h1", None), ("h2", None), ("li", None)):
            fitting = [x for t, around, x in self.found if t == tag and (inside is None or inside in around)]
            for texts in fitting[:most]:
                chunk = clean(" ".join(texts))
                if len(chunk) >= 12 and chunk not in seen:
                    seen.add(chunk)
                    size += len(chunk) + (len(joint) if chunks else 0)
                    chunks.append(chunk)
                if size > cap:
                    break
            if size > enough:
                break
        return joint.join(chunks)


def parse_page(html: str) -> dict:
    page = _Page()
    page.feed(html)
    page.close()
    first = lambda *values: next((c for v in values if v is not None and (c := _clean(v))), None)
    text = page.blocks(80, _clean, "\n", 1_500)
    return {
        "title": first(page.content("property", "og:title"), page.content("name", "twitter:title"), page.text("title"), page.text("h1")),
        "description": first(page.content("property", "og:description"), page.content("name", "description"), page.content("name", "twitter:description")),
        "author": first(page.content("name", "author"), page.content("property", "article:author")),
        "image_url": first(page.content("property", "og:image"), page.content("name", "twitter:image")),
        "content_text": text,
        "original_text": page.blocks(120, _original, "\n\n", 2_000) if text else "",
    }


def _raw_field(section: str, key: str) -> str | None:
    m = re.search(rf'"{re.escape(key)}"\s*:\s*"((?:\\.|[^"\\])*)"', section)
    try:
        return json.loads(f'"{m[1]}"') or None if m else None
    except ValueError:
        return None


def note_metadata(html: str, note_id: str | None) -> dict | None:
    """A note's fields, from 120,000 bytes of page state after its id; null without title and description."""
    data = html.encode()
    marks = [f'"{note_id}"'] if note_id else []
    at = next((i for m in [*marks, '"noteDetailMap"', '"noteCard"'] if (i := data.find(m.encode())) >= 0), -1)
    if at < 0:
        return None
    try:
        section = data[at : at + 120_000].decode("utf-8")
    except UnicodeDecodeError:  # the window ends inside a character
        return None
    field = lambda *keys: next((c for k in keys if (v := _raw_field(section, k)) and (c := _clean(v))), None)
    raw = _raw_field(section, "desc")
    out = {
        "title": field("title", "displayTitle"), "description": field("desc"), "author": field("nickname", "nickName"),
        "image_url": field("urlDefault", "urlPre"), "original_text": raw and _original(raw),
    }
    return out if out["title"] is not None or out["description"] is not None else None
