"""Rule lists, words and texts that decide results. In order; the first hit wins."""

UNKNOWN_PLATFORM = "未知来源"
PLACEHOLDER_TITLE = "未命名链接"
STATUSES = ["active", "archived", "favorite"]

# Platform by host: a part of the host, or with "=" the whole host.
PLATFORMS = [
    ("小红书", ["xiaohongshu.com", "xhslink.com"]), ("今日头条", ["toutiao.com", "snssdk.com"]), ("抖音", ["douyin.com", "iesdouyin.com"]),
    ("快手", ["kuaishou.com", "gifshow.com"]), ("哔哩哔哩", ["bilibili.com", "b23.tv"]), ("知乎", ["zhihu.com"]), ("微博", ["weibo.com", "weibo.cn"]),
    ("微信公众号", ["mp.weixin.qq.com"]), ("腾讯内容", ["weixin.qq.com", "qq.com"]), ("百度网盘", ["pan.baidu.com"]), ("百度", ["baidu.com", "baike.baidu.com"]),
    ("YouTube", ["youtube.com", "youtu.be"]), ("X", ["twitter.com", "=x.com"]), ("Instagram", ["instagram.com"]), ("TikTok", ["tiktok.com"]),
    ("Facebook", ["facebook.com", "fb.watch"]), ("Reddit", ["reddit.com"]), ("LinkedIn", ["linkedin.com"]), ("Pinterest", ["pinterest.com"]),
    ("GitHub", ["github.com"]), ("GitLab", ["gitlab.com"]), ("Medium", ["medium.com"]), ("掘金", ["juejin.cn"]), ("CSDN", ["csdn.net"]),
    ("少数派", ["sspai.com"]), ("36氪", ["36kr.com"]), ("IT之家", ["ithome.com"]), ("豆瓣", ["douban.com"]), ("马蜂窝", ["mafengwo.cn"]),
    ("携程", ["trip.com", "ctrip.com"]), ("旅行住宿", ["airbnb.", "booking.com"]), ("高德地图", ["amap.com", "gaode.com"]), ("Apple Maps", ["maps.apple.com"]),
    ("Google Maps", ["google.com/maps", "goo.gl/maps"]), ("大众点评", ["dianping.com"]), ("美团", ["meituan.com"]),
    ("淘宝/天猫", ["taobao.com", "tmall.com", "=m.tb.cn", "=tb.cn"]), ("京东", ["jd.com"]), ("拼多多", ["yangkeduo.com", "pinduoduo.com"]),
    ("什么值得买", ["smzdm.com"]), ("Amazon", ["amazon."]), ("Notion", ["notion.site", "notion.so"]), ("语雀", ["yuque.com"]),
    ("飞书", ["feishu.cn", "larksuite.com"]), ("Google Docs/Drive", ["docs.google.com", "drive.google.com"]), ("Dropbox", ["dropbox.com"]),
    ("iCloud", ["icloud.com"]), ("百度网盘", ["pan.baidu.com"]), ("Spotify", ["spotify.com"]), ("Apple Music", ["music.apple.com"]),
    ("网易云音乐", ["music.163.com"]), ("QQ音乐", ["y.qq.com"]), ("喜马拉雅", ["ximalaya.com"]), ("小宇宙", ["xiaoyuzhoufm.com"]), ("Substack", ["substack.com"]),
]

# Category by words in the lower-cased text.
CATEGORIES = [
    ("技术", "flutter rust api github gitlab openai deepseek 人工智能 大模型 代码 编程 模型 开源 架构".split()),
    ("地点", "地图 地址 导航 大众点评 美团 高德 maps".split()),
    ("美食", "餐厅 咖啡 菜谱 好吃 探店 烘焙".split()),
    ("旅行", "旅行 酒店 攻略 签证 机票 citywalk 景点 路线 民宿".split()),
    ("购物", "价格 优惠 下单 淘宝 京东 拼多多 种草 购物车 值得买".split()),
    ("财经", "股票 基金 投资 财报 美联储 市场".split()),
    ("健康", "健身 睡眠 医疗 营养 跑步 心理".split()),
    ("生活灵感", "装修 穿搭 收纳 灵感 家居 小红书".split()),
    ("影音娱乐", "电影 剧集 音乐 播客 专辑 spotify 网易云 小宇宙 抖音 哔哩哔哩 bilibili youtube 视频".split()),
    ("知识问答", "知乎 回答 问题 观点 专栏 问答".split()),
    ("社交动态", "微博 热搜 博文 转发 评论".split()),
    ("文档资料", "notion 语雀 飞书 文档 网盘 drive dropbox 资料".split()),
    ("新闻", "今日头条 新闻 发布 报道 事件".split()),
]
# On these two platforms only such words make the text technical; without one the platform's category holds.
TECHNICAL = "rust flutter api github openai deepseek 大模型 代码 编程 开源".split()
STRICT_PLATFORMS = {"知乎": "知识问答", "微博": "社交动态"}
PLATFORM_CATEGORIES = [
    ("生活灵感", ["小红书"]), ("新闻", ["今日头条"]), ("影音娱乐", ["抖音", "哔哩哔哩", "YouTube"]), ("知识问答", ["知乎"]), ("社交动态", ["微博"]),
    ("技术", ["GitHub", "GitLab", "掘金", "CSDN", "少数派", "IT之家"]), ("购物", ["淘宝/天猫", "京东", "拼多多", "Amazon", "什么值得买"]),
    ("地点", ["高德地图", "Apple Maps", "Google Maps", "大众点评", "美团"]), ("影音娱乐", ["Spotify", "Apple Music", "网易云音乐", "QQ音乐", "喜马拉雅", "小宇宙"]),
    ("文档资料", ["Notion", "语雀", "飞书", "Google Docs/Drive", "Dropbox", "iCloud", "百度网盘"]),
]
OTHER_CATEGORY = "待整理"

# Content type by parts of the lower-cased URL and text.
CONTENT_TYPES = [
    ("place", "maps amap gaode dianping meituan 地址 导航".split()),
    ("video", "video douyin kuaishou bilibili youtube tiktok 视频".split()),
    ("audio", "spotify music. ximalaya xiaoyuzhou 播客 专辑".split()),
    ("document", "notion docs.google drive.google dropbox yuque feishu pan.baidu 文档 网盘".split()),
    ("article", "zhihu.com zhuanlan question answer 知乎".split()),
    ("post", "weibo.com weibo.cn 微博 status".split()),
    ("product", "product taobao tmall m.tb.cn tb.cn jd.com yangkeduo pinduoduo amazon. 商品".split()),
    ("article", "/article/ zhuanlan mp.weixin.qq.com/s toutiao.com".split()),
]
LONG_ARTICLE = 600

STOP_WORDS = "https http www com cn net org 这个 一个 可以 来自 分享 链接 打开 复制".split()
ENTITIES = "北京 上海 深圳 杭州 广州 成都 苹果 OpenAI DeepSeek".split()

BARE_HOSTS = (
    "xhslink.com xiaohongshu.com v.douyin.com douyin.com iesdouyin.com b23.tv bilibili.com v.kuaishou.com kuaishou.com gifshow.com t.cn weibo.com weibo.cn "
    "mp.weixin.qq.com toutiao.com snssdk.com m.tb.cn tb.cn taobao.com tmall.com u.jd.com jd.com yangkeduo.com pinduoduo.com smzdm.com zhihu.com "
    "zhuanlan.zhihu.com sspai.com juejin.cn csdn.net 36kr.com ithome.com douban.com pan.baidu.com music.163.com y.qq.com ximalaya.com xiaoyuzhoufm.com "
    "notion.so notion.site yuque.com feishu.cn larksuite.com amap.com gaode.com maps.apple.com dianping.com meituan.com ctrip.com trip.com airbnb.com "
    "booking.com youtube.com youtu.be tiktok.com instagram.com facebook.com fb.watch reddit.com linkedin.com pinterest.com github.com gitlab.com substack.com"
).split()

# Page state: (JSON sources in order; keys of title, description, author, image). script: element id; after: markers; ld: JSON-LD.
PAGE_STATES = {
    "抖音": (
        [("script", ["RENDER_DATA"]), ("after", ["window.__INIT_PROPS__=", "window._ROUTER_DATA=", "window.__data="]), ("ld", [])],
        ["title", "desc", "description"], ["desc", "description", "seoDescription"], ["nickname", "authorName", "name"],
        ["cover", "poster", "thumbnailUrl", "urlDefault", "url"],
    ),
    "哔哩哔哩": (
        [("after", ["window.__INITIAL_STATE__=", "window.__playinfo__="]), ("ld", [])],
        ["title", "name"], ["desc", "description"], ["owner", "author", "name"], ["pic", "cover", "thumbnailUrl", "image"],
    ),
    "YouTube": (
        [("ld", []), ("after", ["var ytInitialPlayerResponse =", "ytInitialPlayerResponse ="])],
        ["title", "name", "headline"], ["shortDescription", "description"], ["author", "ownerChannelName", "name"], ["thumbnailUrl", "thumbnail", "image", "url"],
    ),
    "知乎": (
        [("script", ["js-initialData"]), ("ld", [])],
        ["title", "questionTitle", "headline"], ["excerpt", "description", "content", "text"], ["author", "name", "headline"], ["thumbnail", "image", "avatarUrl", "url"],
    ),
    "微博": (
        [("ld", []), ("after", ["window.__INITIAL_STATE__=", "$render_data =", "render_data ="])],
        ["title", "headline", "page_title", "text_raw", "status_title"], ["text_raw", "articleBody", "description", "text", "content"],
        ["screen_name", "author", "name"], ["pic", "pics", "thumbnailUrl", "image", "url"],
    ),
}

# Access walls: parts of the lower-cased body, and the text shown.
WALLS = [
    (["byted_acrawler", "__ac_signature", "__ac_nonce"], "今日头条返回了浏览器验证页面，后端无法从公开网页直接抓取正文。建议从原 App 分享带标题的文本，或手动补充标题/摘要后再整理。"),
    (["sina visitor system", "visitor.passport.weibo"], "微博返回了访客验证页面，后端无法从普通网页直接抓取正文，正在尝试平台接口兜底。"),
    (["zh-zse-ck", "zse-ck"], "知乎返回了访问验证页面，后端无法从普通网页直接抓取正文，正在尝试回答接口兜底。"),
    (["captcha", "访问验证", "安全验证"], "目标网页返回了访问验证页面，后端无法直接抓取正文。建议从原 App 分享带标题的文本，或手动补充标题/摘要后再整理。"),
]
NOTE_GONE_MARKS = ["当前笔记暂时无法浏览", "你访问的页面不见了"]
NOTE_GONE = "小红书返回了笔记不可浏览页面，后端无法抓取该笔记正文。请换一个可公开访问的分享链接，或从原 App 分享带标题/正文的文本。"
BLOCKED_TITLE = "网页验证拦截"
BLOCKED_TEXTS = ["无法从公开网页直接抓取正文", "无法直接抓取正文"]

NO_SUMMARY, NO_CATEGORY = "暂无摘要", "未分类"
BLOCKED_KEYWORDS = ["访问验证", "原链接"]
BLOCKED_SUMMARY = " 页面触发访问验证，暂时未能抓取正文；已保存原链接。"
BLOCKED_NOTES = "源站返回访问验证页面，本次只保存链接和可用分享文本。"
UNREADABLE_REPLY = "DeepSeek 返回内容无法解析，已使用本地启发式分析。"

DIGEST_EMPTY = "还没有可汇总的收藏，先从系统分享面板或手动添加链接开始。"
HINT_FIRST = "添加第一个链接后，系统会自动生成主题和来源汇总。"
HINT_OFFERS = "含优惠/券相关内容，建议在过期前集中检查。"
HINT_BALANCED = "当前收藏分布较均衡，可以继续观察哪些主题反复出现。"

# Parts of sentences around values, in the order in which they are put together.
FOCUS_CATEGORIES, FOCUS_PLATFORMS, FOCUS_KEYWORDS, FOCUS_END = "近期收藏主要集中在 ", "，来源多来自 ", "，高频线索包括 ", "。"
HINT_CATEGORY = ("为「", "」建立一个专题清单，方便后续集中复盘。")
HINT_PLATFORM = ("最近来自「", "」的内容较多，可以定期清理低价值重复收藏。")
FALLBACK_SUMMARY = ("来自 ", " 的链接，已保存原始地址。")
PAGE_STATUS = ("页面返回 HTTP ", "; 已保存可见分享文本。")
PAGE_FAILED = "请求页面失败: "
NOTE_GONE_TEXT = "小红书返回了笔记不可浏览页面"
NOTE_PLATFORM, NOTE_HOST = "小红书", "xiaohongshu.com"
RENDERED_PLATFORMS = ["今日头条", "小红书"]
