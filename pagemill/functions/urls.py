"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# scheme, netloc, path, params of the last segment, query, fragment
_URL = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*?)"
    r"(?:;([^/?#]*))?(?:\?([^#]*))?(?:#(.*))?$"
)
_FIELDS = ("scheme", "netloc", "path", "params", "query", "fragment")

# Short ways for common URLs, with the results of the pattern above. The root, then the host, of a URL whose
# scheme is in lower case; and a URL that is its own canonical form. What the pattern above cuts or passes over
# (tabs, line ends of any kind) is left to it.
_ROOT = r"^([a-z][a-z0-9+.\-]*://([^/?#\t\r\n]*))(?:[/?#]|\z)"
_CANONICAL = r"^[a-z][a-z0-9+.\-]*://[^;?#\t\r\n\x85\u2028\u2029]*(?:\?[^#\t\r\n\x85\u2028\u2029]+)?\z"


def _clean(col: Column) -> Column:
    """Without control characters and blanks in front, and without tabs and line breaks anywhere."""
    return F.regexp_replace(col, r"^[\x00-\x20]+|[\t\r\n]", "")


def _part(col: Column, name: str) -> Column:
    part = F.regexp_extract(_clean(col), _URL, _FIELDS.index(name) + 1)
    return F.lower(part) if name == "scheme" else part


def url_parts(col: Column) -> Column:
    """Struct of the six URL parts and the port: 443 for https, else 80."""
    port = F.when(_part(col, "scheme") == "https", 443).otherwise(80)
    return F.struct(*[_part(col, n).alias(n) for n in _FIELDS], port.alias("port"))


def netloc(col: Column) -> Column:
    return F.when(col.rlike(_ROOT), F.regexp_extract(col, _ROOT, 2)).otherwise(_part(col, "netloc"))


def root_url(col: Column) -> Column:
    whole = F.concat(_part(col, "scheme"), F.lit("://"), _part(col, "netloc"))
    return F.when(col.rlike(_ROOT), F.regexp_extract(col, _ROOT, 1)).otherwise(whole)


def absolute_url(base: Column, href: Column, mode: str = "reference") -> Column:
    """Make `href` absolute against the page URL `base`.

    `reference` is plain concatenation: a relative href is put straight
    behind the whole page path.  `rfc3986` resolves as browsers do.
    """
    if mode == "reference":
        return (
            F.when(href.startswith("/"), F.concat(root_url(base), href))
            .when(href.rlike("^https?://"), href)
            .otherwise(F.concat(root_url(base), _part(base, "path"), href))
        )
    if mode != "rfc3986":
        raise ValueError(f"unknown mode {mode!r}")
    root = root_url(base)
    folder = F.regexp_replace(_part(base, "path"), "[^/]*$", "")
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    bare = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.substr(href, F.length(bare) + 1)
    merged = F.when(bare.startswith("/"), bare).otherwise(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), bare)
    )
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(_part(base, "scheme"), F.lit(":"), href))
        .when(href == "", F.concat(root, _part(base, "path"), query))
        .when(href.startswith("#"), F.concat(root, _part(base, "path"), query, href))
        .when(href.startswith("?"), F.concat(root, _part(base, "path"), href))
        .otherwise(F.concat(root, _without_dot_segments(merged), tail))
    )


def _without_dot_segments(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    segments = F.split(F.substr(path, F.lit(2)), "/", -1)
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    closing = F.when(path.rlike(r"/\.{1,2}$") & (F.size(folded) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(folded, "/"), closing)


def canonical_url(col: Column) -> Column:
    """scheme://netloc/path?query; `;params` and the fragment go."""
    query = _part(col, "query")
    whole = F.concat(
        root_url(col),
        _part(col, "path"),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(col.rlike(_CANONICAL), col).otherwise(whole)


def _quote_plus(col: Column) -> Column:
    """Percent-encode, space as plus; `*` is encoded and `~` is not."""
    return F.replace(F.replace(F.url_encode(col), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def request_path(col: Column, path_only: bool = False) -> Column:
    """Path, `:params`, query with each value encoded, and `#fragment`.

    A key is everything up to `=`, so `a&b=2` is one key.  A key without a
    value stays as it is.
    """
    path = _part(col, "path")
    if path_only:
        return path
    params, query, fragment = _part(col, "params"), _part(col, "query"), _part(col, "fragment")
    pair = r"([^=]+)(=([^&#]*))?"
    # a run of `=` that no key takes is copied through unchanged
    pieces = F.regexp_extract_all(query, F.lit(rf"(=|{pair})"), F.lit(1))
    encoded = F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(
                p.rlike("^[^=]+="),
                F.concat(
                    F.regexp_extract(p, pair, 1),
                    F.lit("="),
                    _quote_plus(F.regexp_extract(p, pair, 3)),
                ),
            ).otherwise(p),
        ),
        "",
    )
    return F.concat(
        path,
        F.when(params != "", F.concat(F.lit(":"), params)).otherwise(""),
        F.when(query != "", F.concat(F.lit("?"), encoded)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def has_valid_host(col: Column) -> Column:
    """False for a host with an unbalanced IPv6 bracket, which does not parse."""
    host = netloc(col)
    plain = ~col.contains("[") & ~col.contains("]")
    return F.when(plain, F.lit(True)).otherwise(host.contains("[") == host.contains("]"))


def skips_href(href: Column) -> Column:
    """Hrefs that are no page links: empty, in-page, script and mail ones."""
    return (
        (href == "")
        | href.startswith("#")
        | href.startswith("javascript:")
        | href.startswith("mailto:")
    )


def clean_href(attrs: Column) -> Column:
    return strip(attrs["href"])
