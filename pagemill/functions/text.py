"""Column functions on text: whitespace, URL removal, content names.

Python treats U+001C..U+001F as whitespace and Java does not, so every
whitespace class below adds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x1c-\x1f]"
NON_WS = r"[^\s\x1c-\x1f]"

# What counts as a URL inside text.
URL_START = r"(?:(?:https?|ftp)://|www\.)"
URL_CHARS = r"[a-zA-Z0-9\-._~:/?#@!$&'()*+,;=%]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def strip(col: Column) -> Column:
    """Cut whitespace of any kind from both ends (`trim` only cuts spaces)."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return ~col.rlike("(?U)" + NON_WS)


def normalize_whitespace(col: Column) -> Column:
    """Collapse blank lines and runs of spaces, then strip."""
    out = F.regexp_replace(col, rf"(?U)\n{WS}*\n+", "\n\n")
    out = F.regexp_replace(out, " {2,}", " ")
    return strip(out)


def remove_urls(col: Column) -> Column:
    """Drop URLs and the brackets and gaps they leave behind.

    Order matters: bracketed URLs go first, because the URL class itself
    holds the closing parenthesis.
    """
    url = URL_START + URL_CHARS
    with_urls = [rf"(?iU)\({WS}*{url}{WS}*\)", rf"(?iU)\[{WS}*{url}{WS}*\]", rf"(?iU){url}"]
    after = [
        (rf"(?U)\({WS}*\)", ""),
        (rf"(?U)\[{WS}*\]", ""),
        (r" {2,}", " "),
        (rf"(?U)\n{WS}*\n", "\n\n"),
    ]

    def without(text: Column) -> Column:
        cut = text
        for pattern in with_urls:
            cut = F.regexp_replace(cut, pattern, "")
        # most texts hold no URL and skip three passes
        some = text.contains("://") | F.lower(text).contains("www.")
        return F.when(some, cut).otherwise(text)

    out = let(col, without)
    for pattern, replacement in after:
        out = F.regexp_replace(out, pattern, replacement)
    return strip(out)


def content_hash(col: Column) -> Column:
    return F.substring(F.sha2(F.encode(col, "UTF-8"), 256), 1, 32)


def content_filename(col: Column) -> Column:
    return F.concat(F.lit("content_"), content_hash(col), F.lit(".txt"))
