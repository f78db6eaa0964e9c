import html
import json

from pyspark.sql import functions as F

from curio.operators import items as I
from curio.operators import pages as P
from curio.operators import trees as X
from curio.operators.markup import decoded, with_page_metadata
from curio.plans import catalog
from curio.sources import tables as R
from curio.sources.schemas import PAGE_SCHEMA
from tests.helpers import START, item, items

LONG = "这一段正文足够长，可以作为可见文本保留下来。"


def one(spark, url, html, text=None, status=200):
    seeds = P.seed_metadata(spark.createDataFrame([(url, text)], "source_url string, shared_text string"))
    pages = spark.createDataFrame([(url, url, status, html, None)], PAGE_SCHEMA)
    return P.finish_metadata(P.merge_pages(seeds, pages)).first()


def read(spark, *pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, body string")
    return [r["page"] for r in with_page_metadata(rows).orderBy("i").collect()]


def test_generic_page(spark):
    html = f"<html><head><meta property='og:title' content=' A &amp; B '><meta name=author content=Ann></head><body><script>var x = '<p>{LONG}</p>'</script><article><p>{LONG}<p><b>second</b> paragraph here</article><p>short</body>"
    got = one(spark, "https://example.org/a", html)
    assert (got["title"], got["author"], got["image_url"]) == ("A & B", "Ann", None)
    assert got["content_text"] == f"{LONG} second paragraph here" or got["content_text"].split("\n") == [f"{LONG} second paragraph here"]


def test_visible_text_has_no_repeats_and_prefers_articles(spark):
    page = read(spark, f"<main><p>{LONG}</p></main><ul><li>{LONG}<li>another list entry</ul>")[0]
    assert page["content_text"] == f"{LONG}\nanother list entry" and page["original_text"] == f"{LONG}\n\nanother list entry"


def test_wall_keeps_shared_text(spark):
    html = "<script>byted_acrawler</script>"
    bare = one(spark, "https://www.toutiao.com/a", html)
    assert bare["title"] == "今日头条链接（网页验证拦截）" and "无法从公开网页" in bare["content_text"]
    said = one(spark, "https://www.toutiao.com/a", html, "真正的标题\n正文")
    assert said["title"] == "真正的标题" and said["content_text"] == "真正的标题 正文" and "浏览器验证" in said["description"]


def test_failed_fetch_leaves_a_note(spark):
    got = one(spark, "https://example.org/a", "<p>gone</p>", status=404)
    assert "HTTP 404" in got["description"] and got["content_text"] == "gone"


def test_note_state(spark):
    state = {"noteDetailMap": {"abc": {"title": "周末", "desc": "第一行\n第二行", "user": {"nickname": "某人"}, "urlDefault": "https://i.org/1.jpg"}}}
    got = one(spark, "https://www.xiaohongshu.com/explore/abc", f"<script>{json.dumps(state, ensure_ascii=False)}</script>")
    assert (got["title"], got["author"], got["image_url"]) == ("周末", "某人", "https://i.org/1.jpg")
    assert got["original_text"] == "第一行\n第二行" and got["content_text"] == "周末 第一行 第二行"


def states(spark, *pages):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "i int, platform string, body string").coalesce(1)
    return [r["f"] and r["f"].asDict() for r in sorted(X.with_page_state(rows, "f").collect())]


def payloads(spark, *said):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(said)], "i int, platform string, payload string").coalesce(1)
    return [r["f"] and r["f"].asDict() for r in sorted(X.with_api_payload(rows, "f").collect())]


def tree(value):
    return "哔哩哔哩", f"x window.__INITIAL_STATE__={json.dumps(value)};(function(){{}})()"


def test_platform_states(spark):
    bili, ld, douyin, *nothing, zhihu = states(
        spark, tree({"v": {"title": "标题够长", "desc": "<b>d</b>", "pic": "//i.org/p", "owner": {"name": "up"}}}),
        ("YouTube", '<script type="application/ld+json">{"@graph":[{"name":"Video name","description":"d e","thumbnailUrl":["https://i.org/t"],"author":"ch"}]}</script>'),
        ("抖音", '<script id="RENDER_DATA">%7B%22desc%22%3A%22hello%20there%22%7D</script>'), ("GitHub", ""), ("微博", "<p>"), ("微博", None), ("哔哩哔哩", "window.__INITIAL_STATE__={broken"),
        ("知乎", '<script id="js-initialData">{"a":{"name":"Ann","question":{"title":"Why though"}},"excerpt":"short"}</script>'),
    )
    assert bili == {"title": "标题够长", "description": "d", "author": "up", "image_url": "https://i.org/p", "original_text": "d"}
    assert (ld["title"], ld["image_url"], ld["author"]) == ("Video name", "https://i.org/t", "ch")
    assert douyin["title"] == "hello there" and nothing == [None] * 4
    assert (zhihu["title"], zhihu["author"], zhihu["description"]) == ("Why though", "Ann", "short")


def test_order_of_a_tree(spark):
    """Key by key; for a key an object's own entry before those of its children, children by the order of their keys."""
    cases = [
        ({"b": {"title": "deep one"}, "title": "own one"}, "own one"), ({"b": {"title": "second"}, "a": {"c": {"title": "first"}}}, "first"), ({"name": "by name", "z": {"title": "by title"}}, "by title"),
        ({"a": {"title": ""}, "b": {"title": {"other": "x"}}, "c": {"title": {"text": "in text"}}}, "in text"), ({"title": [{"title": "nope", "text": "yes yes"}, "more"]}, "yes yes"),
        ({"title": 12345}, "12345"), ({"title": True}, None), ({"title": "abc"}, "abc"),
    ]
    got = states(spark, *[tree(t) for t, _ in cases], tree({"desc": ["one", {"text": "two", "name": "no"}, {"name": ["three", "four"]}, {"other": "no"}]}))
    assert [g and g["title"] for g in got[:-1]] == [w for _, w in cases]
    assert got[-1]["original_text"] == "one\ntwo\nthree\nfour" and got[-1]["description"] == "one"


def test_sources_after_the_complete_one_say_nothing(spark):
    one = {"title": "the title", "description": "words", "thumbnailUrl": "https://i.org/1"}
    html = "".join(f'<script type="application/ld+json">{json.dumps(x)}</script>' for x in ({"headline": "x"}, one, {"author": "late", "title": "no"}))
    got, later = states(spark, ("YouTube", html), ("YouTube", html.replace("https://i.org/1", "no")))
    assert got == {"title": "x", "description": "words", "author": None, "image_url": "https://i.org/1", "original_text": "words"}
    assert later["author"] == "late"


def test_api_payloads(spark):
    pictures = {"b": {"largest": {"url": "https://i.org/2"}}, "a": {"thumbnail": {"url": "https://i.org/t"}, "original": {"url": "https://i.org/o"}}}
    answer, *nothing, one, both = payloads(
        spark, ("知乎", json.dumps({"question": {"title": "Q"}, "content": "<p>a</p><p>b</p>", "author": {"name": "n", "avatar_url": "//i.org/a"}})),
        ("微博", '{"error": null, "text": "x"}'), ("微博", "broken"), ("微博", None),
        ("微博", '{"text": "<b>x</b> y", "pic_infos": {"p": {"large": {"url": "https://i.org/l"}}}}'), ("微博", json.dumps({"text": "x", "text_raw": "raw", "pic_infos": pictures, "user": {"screen_name": "u"}})),
    )
    assert answer == {"title": "Q", "description": "a b", "author": "n", "image_url": "https://i.org/a", "original_text": "a\n\nb"}
    assert nothing == [None] * 3 and one["image_url"] == "https://i.org/l"
    assert (both["image_url"], both["description"], both["title"], both["author"]) == ("https://i.org/o", "raw", "raw", "u")


def test_rendered(spark):
    rows = P.seed_metadata(spark.createDataFrame([("https://www.toutiao.com/a", None), ("https://example.org/a", None)], "source_url string, shared_text string"))
    rendered = spark.createDataFrame([(True, u, u + "#r", "T", None, None, None, LONG, None) for u in ("https://www.toutiao.com/a", "https://example.org/a")], "ok boolean, source_url string, final_url string, title string, description string, author string, image_url string, content_text string, extractor string")
    got = {r["source_url"]: r for r in P.merge_rendered(rows, rendered).collect()}
    assert got["https://www.toutiao.com/a"]["content_text"] == LONG and got["https://www.toutiao.com/a"]["final_url"].endswith("#r")
    assert got["https://example.org/a"]["title"] == "未命名链接"


def test_shares_to_items(spark):
    shares = spark.createDataFrame([(None, "看 https://github.com/a/b 和 b23.tv/x", "app", 1), ("nothing", None, None, 2)], "url string, shared_text string, source_app string, seq long")
    pages = spark.createDataFrame([("https://github.com/a/b", "https://github.com/a/b", 200, "<title>Repo page</title>", None)], PAGE_SCHEMA)
    got = {r["final_url"]: r for r in I.ingest_shares(shares, pages, F.lit(START)).collect()}
    assert got["https://github.com/a/b"]["title"] == "Repo page" and got["https://github.com/a/b"]["category"] == "技术" and len(got) == 2


def test_json_round_trip(spark, tmp_path):
    store = items(spark, [item("a", author=None, keywords=["k", "优惠"])])
    R.write_items_json(store, str(tmp_path / "x"))
    assert R.read_items_json(spark, str(tmp_path / "x"), multi_line=False).collect() == store.collect()
    assert R.unpack_items(R.pack_items(store)).collect() == store.collect()
    assert R.read_items_json(spark, str(tmp_path / "none")).count() == 0


def test_page_states_hold_whole_pages(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(400))
    spark.createDataFrame([(1, "https://example.org/a", f"<p>{words}</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for name in ("state_metadata", "xhs_metadata"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).first()["description"] == words


def test_references(spark):
    texts = ["&amp;", "&amp", "&#39;", "&#x27;", "&copy", "&unknown;", "&#128;", "&#99999999;", "&#xD800;", "&hellip;&mdash", "a & b", "&&amp;&", "&#x1F600;", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r["d"] for r in rows.select("i", decoded(F.col("t")).alias("d")).orderBy("i").collect()] == [html.unescape(t) for t in texts]
