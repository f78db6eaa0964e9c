"""Page parsing against pages that are put together from known parts, and the two forms of the text rules."""

import json
import random

from curio.functions import text as T
from curio.operators.markup import with_page_metadata
from tests import page_model as M
from tests.test_pages import one

ODD = ["a", "Bc", " ", "  ", "\n", "\r\n", "\t", "　", " ", "&nbsp;", "&amp;", "&lt;b&gt;", "&quot;", "&#39;", "<b>", "</p>", "<br>", "<br/>", "<H2 x='1'>", "http", "链接", "é", "...", "<", ">"]


def odd_texts(n):
    rng = random.Random(5)
    return ["", " ", *["".join(rng.choice(ODD) for _ in range(rng.randint(1, 60))) for _ in range(n)], "x" * 200, "http://a\n  four  \n"]


def test_python_text_rules_are_the_columns(spark):
    texts = odd_texts(400)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = rows.select("i", T.one_line("t"), T.clean_text("t"), T.clean_original_text("t"), T.plain_text_preview("t"), T.html_to_formatted_text("t"), T.first_meaningful_line("t"), T.truncate_chars("t", 20)).collect()
    for r in got:
        t = texts[r[0]]
        assert tuple(r)[1:] == (M._line(t), M._clean(t), M._original(t), M._preview(t), M._formatted(t), M._first_line(t), M._cut(t, 20)), repr(t)


def pages(n):
    """(html, what is in it): random pages whose parts are known."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    line = lambda k: " ".join(word() for _ in range(k))
    for _ in range(n):
        head, want = [], dict.fromkeys(("title", "description", "author", "image_url"))
        if rng.random() < 0.5:
            want["title"] = line(3)
            head.append(f"<meta property='og:title' content=' {want['title']} '>")
        if rng.random() < 0.7:
            title = line(4)
            head.append(f"<title>{title.replace(' ', '  ', 1)}</title>")
            want["title"] = want["title"] or title
        for key, attr, name in (("description", "name", "description"), ("author", "name", "author"), ("image_url", "property", "og:image")):
            if rng.random() < 0.6:
                want[key] = line(2)
                head.append(f'<META {attr}="{name}" content="{want[key]}">')
        rng.shuffle(head)
        parts = {"article": [], "main": [], None: []}
        body = []
        for place in rng.choices(["article", "main", None], k=rng.randint(1, 8)):
            own = [line(rng.randint(1, 8)) for _ in range(rng.randint(1, 4))]
            parts[place] += own
            inner = "".join(f"<p class=x>{t[: len(t) // 2]}<b></b>{t[len(t) // 2 :]}" + ("</p>" if rng.random() < 0.7 else "") for t in own)
            body.append(f"<{place}><div>{inner}</div></{place}>" if place else f"<div>{inner}</div>")
        lists = [line(rng.randint(1, 5)) for _ in range(rng.randint(0, 4))]
        body.append("<ul>" + "".join(f"<li>{t}" for t in lists) + "</ul><script>var x = '<p>never shown at all</p>'</script>")
        want["in order"] = parts, lists
        yield f"<html><head>{''.join(head)}</head><body>{''.join(body)}</body></html>", want


def test_pages_of_known_parts(spark):
    made = list(pages(200))
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(made)], "i long, html string")
    got = {r["i"]: r["page"] for r in with_page_metadata(rows, "html").collect()}
    for i, (html, want) in enumerate(made):
        page = got[i]
        assert {k: page[k] for k in ("title", "description", "author", "image_url")} == {k: want[k] for k in ("title", "description", "author", "image_url")}, html
        parts, lists = want["in order"]
        # Paragraphs of articles, of main, all paragraphs in the order of the page, list entries; each once, none that is short.
        told = set(page["content_text"].split("\n")) if page["content_text"] else set()
        lines = [t.replace("  ", " ") for own in (parts["article"], parts["main"], parts["article"] + parts["main"] + parts[None], lists) for t in own]
        halves = {t: f"{t[: len(t) // 2]} {t[len(t) // 2 :]}".replace("  ", " ").strip() for t in lines}
        fit = {halves[t] if t not in lists else t for t in lines}
        assert told == {t for t in fit if len(t) >= 12}, html
        first = [halves[t] for t in [*parts["article"], *parts["main"]] if len(halves[t]) >= 12]
        assert page["content_text"].split("\n")[: len(dict.fromkeys(first))] == list(dict.fromkeys(first)) or not first


def test_note_on_a_foreign_host(spark):
    state = {"noteDetailMap": {"x": {"title": "周末", "desc": "第一行", "user": {"nickname": "某人"}}}}
    html = f"<title>other title</title><script>{json.dumps(state, ensure_ascii=False)}</script>"
    got = one(spark, "https://example.org/r?to=xiaohongshu.com", html)
    assert (got["title"], got["author"], got["platform"]) == ("周末", "某人", "example.org")
    assert one(spark, "https://example.org/r", html)["title"] == "other title"
    gone = one(spark, "https://example.org/r?to=xiaohongshu.com", "<p>你访问的页面不见了</p>")
    assert "笔记不可浏览" in gone["description"]
