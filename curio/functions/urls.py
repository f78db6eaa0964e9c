"""URL columns: extraction from shared text, hosts, platforms and ids in paths."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curio.functions import lists
from curio.functions.text import SPACE, col, once

_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_STOP = f"[^{_SPACES}<>\"'，。；：）】》]+"
_FULL = re.compile(f"https?://{_STOP}")
_WWW = re.compile(rf"\bwww\.{_STOP}")
_HOST = re.compile(rf"\b[a-zA-Z0-9\-\u017f\u212a]+(?:\.[a-zA-Z0-9\-\u017f\u212a]+)+/{_STOP}")
_QUOTES, _TAIL = "<>\"'“”‘’", ",.;:)]}，。；：）】》"


def _clean(url: str) -> str:
    return url.strip(_QUOTES).rstrip(_TAIL)


def supported_host(host: str) -> bool:
    while host.startswith("www."):
        host = host[4:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    return any(host == h or host.endswith("." + h) for h in lists.BARE_HOSTS)


def urls_in(text: str) -> list[str]:
    """Full URLs, www. hosts and paths of supported hosts, by place; each once. The scans overlap: a full URL with
    www. also gives its https form."""
    found = [(m.start(), 0, _clean(m[0])) for m in _FULL.finditer(text)]
    found += [(m.start(), 1, "https://" + _clean(m[0])) for m in _WWW.finditer(text)]
    found += [(m.start(), 2, "https://" + _clean(m[0])) for m in _HOST.finditer(text) if supported_host(_clean(m[0]).split("/")[0])]
    return list(dict.fromkeys(url for _, _, url in sorted(found, key=lambda x: x[:2])))


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_urls(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: urls_in(t) if t else [])


def clean_shared_url(c: Column | str) -> Column:
    out = F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")
    out = F.regexp_replace(out, "^[<>\"'“”‘’]+|[<>\"'“”‘’]+$", "")
    return F.regexp_replace(out, r"[,.;:)\]}，。；：）】》]+$", "")


#: Scheme, perhaps a user, host.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(c: Column | str) -> Column:
    """The host in lower case; '' where the text is no URL with one."""
    return F.lower(F.regexp_extract(F.coalesce(col(c), F.lit("")), HOST, 1))


def is_url(c: Column | str) -> Column:
    return host_of(c) != ""


def is_supported_host(c: Column | str) -> Column:
    host = F.lower(F.regexp_replace(col(c), r"^(www\.)+", ""))
    return F.exists(F.array(*[F.lit(h) for h in lists.BARE_HOSTS]), lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))


@functools.cache
def _platform_of(name: str) -> Column:
    return _platform(F.col(name))


def platform_for_url(c: Column | str) -> Column:
    """The platform's name; the host if no rule hits; UNKNOWN_PLATFORM for what is no URL."""
    return _platform_of(c) if isinstance(c, str) else _platform(c)


def _platform(c: Column) -> Column:

    def rules(host: Column) -> Column:
        out = F.when(host == "", F.lit(lists.UNKNOWN_PLATFORM))
        for name, parts in lists.PLATFORMS:
            hit = F.lit(False)
            for part in parts:
                hit = hit | ((host == part[1:]) if part[0] == "=" else host.contains(part))
            out = out.when(hit, F.lit(name))
        return out.otherwise(host)

    return once(F.regexp_replace(host_of(c), r"^(www\.)+", ""), rules)


def zhihu_answer_id(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"/answer/([0-9]+)", 1), F.lit(""))


def weibo_status_id(c: Column | str) -> Column:
    return F.try_element_at(F.regexp_extract_all(col(c), F.lit(r"/([0-9]{10,})"), F.lit(1)), F.lit(-1))


def xhs_note_id(c: Column | str) -> Column:
    path = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/(?:explore|discovery/item)/([^/?#]+)"
    return F.nullif(F.regexp_extract(col(c), path, 1), F.lit(""))


def resolve_requests(shares, url: str = "url", text: str = "shared_text"):
    """shares with urls (array) and reject: what is wrong with the request, or null."""
    joined = F.concat_ws("\n", url, text)
    found = shares.withColumn("urls", extract_urls(joined))
    bad = F.exists("urls", lambda u: ~is_url(u))
    return found.withColumn("reject", F.when(F.size("urls") == 0, F.lit("no URL")).when(bad, F.lit("invalid URL")))


def cover_referer(c: Column | str) -> Column:
    host = host_of(c)
    return (
        F.when(host.contains("xhscdn.com") | host.contains("xiaohongshu.com"), F.lit("https://www.xiaohongshu.com/"))
        .when(host.contains("toutiao") | host.contains("byteimg"), F.lit("https://www.toutiao.com/"))
        .otherwise(F.lit("https://www.google.com/"))
    )
