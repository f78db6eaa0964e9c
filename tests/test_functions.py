import pytest
from pyspark.sql import functions as F

from curio.functions import classify as C
from curio.functions import text as T
from curio.functions import urls as U


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (T.clean_text, {"a&nbsp;&amp;  b　\n": "a & b", "&amp;nbsp;x": "&nbsp;x", None: None, "": ""}),
        (T.clean_original_text, {"&amp;lt;b\r\n \n\n c  d\n": "<b\n\nc d", "\n\na　 b\n": "a b", None: None}),
        (lambda c: T.truncate_chars(c, 3), {"abcd": "abc...", "abc": "abc", "链接链接": "链接链...", None: None}),
        (T.plain_text_preview, {"<p>a</p><b>c": "a c"}),
        (T.html_to_formatted_text, {"<P>a</P><br/>b<BR>c<i>d</i>": "a\n\nb c d"}),
        (T.first_meaningful_line, {"ab\nhttp://x.y/z\n  long enough \r\nno": "long enough", "abc": None, None: None}),
        (T.is_url_only_text, {"": True, " https://a.b/c 。": True, "https://a.b/c see": False, "www.a.b。，": True}),
        (T.safe_file_id, {"a-b_c/1": "a-bc1"}),
        (U.clean_shared_url, {" <https://a.b/c>。) ": "https://a.b/c>", "“https://a.b/”": "https://a.b/"}),
        (U.zhihu_answer_id, {"https://www.zhihu.com/question/1/answer/22?x": "22", "https://a.b": None}),
        (U.weibo_status_id, {"https://weibo.com/1234567890/5123456789012": "5123456789012", "https://weibo.com/1": None}),
        (U.xhs_note_id, {"https://www.xiaohongshu.com/explore/abc?x=1": "abc", "https://www.xiaohongshu.com/discovery/item/d": "d", "https://www.xiaohongshu.com/user/d": None}),
    ],
)
def test_text(spark, f, cases):
    assert column(spark, list(cases), f) == list(cases.values())


def test_extract_urls(spark):
    cases = {
        "看看 https://xhslink.com/a/b，复制": ["https://xhslink.com/a/b"],
        "b23.tv/abc 打开": ["https://b23.tv/abc"],
        "example.org/abc": [],
        "http://www.x.com/a": ["http://www.x.com/a", "https://www.x.com/a"],
        "http://github.com/a (http://github.com/a)": ["http://github.com/a", "https://github.com/a"],
        "": [],
        None: [],
    }
    assert column(spark, list(cases), U.extract_urls) == list(cases.values())


def test_platform(spark):
    cases = {
        "https://www.xiaohongshu.com/a": "小红书", "https://m.weibo.cn/1": "微博", "https://mp.weixin.qq.com/s/1": "微信公众号", "https://x.com/a": "X", "https://max.com/a": "max.com",
        "https://y.qq.com/a": "腾讯内容", "https://u@GitHub.com:8/a": "GitHub", "github.com/a": "未知来源", None: "未知来源", "https://www.www.example.org/": "example.org", "https://google.com/maps": "google.com",
    }
    assert column(spark, list(cases), U.platform_for_url) == list(cases.values())


def test_category_and_type(spark):
    rows = spark.createDataFrame(
        [("这是一个 rapid 方案", "X", "技术"), ("今天的咖啡", "X", "美食"), ("价格 股票", "知乎", "知识问答"), ("rust 的价格", "微博", "技术"), ("", "GitHub", "技术"), ("", "else", "待整理")], "t string, p string, want string"
    )
    assert all(r[0] == r[1] for r in rows.select(C.infer_category("t", "p"), "want").collect())
    kinds = spark.createDataFrame([("https://amap.com/a", "", "place"), ("https://v.douyin.com", "", "video"), ("https://a.b", "x" * 601, "article"), ("https://a.b", "x" * 600, "link"), ("https://item.jd.com/1", "", "product")], "u string, t string, want string")
    assert all(r[0] == r[1] for r in kinds.select(C.infer_content_type("u", "t"), "want").collect())


def test_keywords(spark):
    got = column(spark, ["https www 这个 Rust Rust 大模型 ab C++x x.y-z", None], C.extract_keywords)
    assert got[0] == ["Rust", "大模型", "C++x", "x.y-z"]


def test_normalize_analysis(spark):
    good = '{"summary":" ","category":"","keywords":["a"," "],"entities":[],"sentiment":"s","content_type":"c","importance_score":200,"notes":""}'
    got = column(spark, [good, good.replace("200", "300"), good.replace(',"notes":""', ""), "no json", None], C.normalize_analysis)
    assert got[0]["summary"] == "暂无摘要" and got[0]["category"] == "未分类" and got[0]["keywords"] == ["a"] and got[0]["importance_score"] == 100
    assert got[1:] == [None] * 4
