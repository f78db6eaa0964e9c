"""Text columns: cleaning, cutting and plain text from markup. Lengths and cuts are in code points; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, without and with the line feed, in a form that Java and RE2 read alike.
_OTHER = r"\t\x{0b}\x{0c}\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE, NOT_SPACE, SPACE_IN_LINE = f"[{_OTHER}\\n]", f"[^{_OTHER}\\n]", f"[{_OTHER}]"
#: ASCII punctuation and some full-width marks.
MARKS = r"[!-/:-@\[-`{-~，。；：、（）【】]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column | str, f) -> Column:
    """f(value), with value worked out once for each row however often f uses it."""
    return F.element_at(F.transform(F.array(col(value)), f), 1)


def trim(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column | str) -> Column:
    """True for null too."""
    return ~F.coalesce(col(c), F.lit("")).rlike(NOT_SPACE)


def one_line(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), f"{SPACE}+", " "), "^ | $", "")


def clean_text(c: Column | str) -> Column:
    """&nbsp; and &amp; decoded, once each in this order, on one line."""
    return one_line(F.replace(F.replace(col(c), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")))


def unix_lines(c: Column | str) -> Column:
    return F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean_original_text(c: Column | str) -> Column:
    """Six entities decoded in turn, lines cleaned, runs of empty lines cut to one, none at the ends."""
    out = col(c)
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    out = F.regexp_replace(unix_lines(out), f"{SPACE_IN_LINE}+", " ")
    out = F.regexp_replace(F.regexp_replace(out, " ?\n ?", "\n"), "\n{2,}", "\n\n")
    return F.regexp_replace(out, "^[ \n]+|[ \n]+$", "")


def truncate_chars(c: Column | str, n: int) -> Column:
    return once(c, lambda x: F.when(F.char_length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x))


def plain_text_preview(c: Column | str) -> Column:
    return clean_text(F.regexp_replace(col(c), "<[^>]+>", " "))


def html_to_formatted_text(c: Column | str) -> Column:
    """Line breaks (lower case only) and block tags become line feeds, other tags spaces; then cleaned."""
    out = F.regexp_replace(unix_lines(c), "<br(/| /)?>", "\n")
    out = F.regexp_replace(out, r"(?i)</?(p|div|section|article|li|h[1-6])\b[^>]*>", "\n")
    return clean_original_text(F.regexp_replace(out, "<[^>]+>", " "))


def first_meaningful_line(c: Column | str) -> Column:
    """The first line, trimmed, of four or more characters that doesn't start with http, cut to 120; else null."""
    lines = F.transform(F.split(col(c), "\n"), trim)
    found = F.filter(lines, lambda x: (F.char_length(x) >= 4) & ~x.startswith("http"))
    return truncate_chars(F.try_element_at(found, F.lit(1)), 120)


def is_url_only_text(c: Column | str) -> Column:
    """Nothing but URLs, white space, and marks at the ends of what remains without them."""
    rest = F.regexp_replace(col(c), f"https?://{NOT_SPACE}+|www\\.{NOT_SPACE}+", " ")
    return rest.rlike(f"^{SPACE}*{MARKS}*{SPACE}*{MARKS}*{SPACE}*$")


def first_non_empty(*columns: Column | str) -> Column:
    """The first that is not empty once cleaned, cleaned; else null."""
    return F.coalesce(*[F.nullif(clean_text(c), F.lit("")) for c in columns])


def append_note(c: Column | str, note: Column) -> Column:
    """note on a line of its own, unless it is there already."""
    c = col(c)
    return F.when(c == "", note).when(c.contains(note), c).otherwise(F.concat(c, F.lit("\n"), note))


def safe_file_id(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^A-Za-z0-9-]", "")


def local_cover_path(item_id: Column | str) -> Column:
    return F.concat(F.lit("/media/cover-"), safe_file_id(item_id), F.lit(".jpg"))
