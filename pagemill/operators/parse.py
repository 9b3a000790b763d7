"""Markup to node rows: the one place where a page is walked in Python.

Each Arrow batch of pages becomes Arrow batches of nodes; everything after
this step is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import NODES, require_columns

# Elements that never have content.
VOID_ELEMENTS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
# Elements whose strings are not page text.
DATA_ELEMENTS = frozenset(["script", "style", "template", "rt", "rp"])
# Elements inside which blank strings keep their exact spaces.
PREFORMATTED = frozenset(["pre", "textarea"])
# Elements that make a page a feed.
FEED_ELEMENTS = frozenset(["rss", "feed", "channel"])

_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S | re.I)
_MAYBE_FEED = re.compile(r"<(?:rss|feed|channel)\b", re.I)
# Character references with more digits than any character needs, zeros in front included.
_LONG_REFERENCE = re.compile(r"&#(?:([0-9]{9,})|[xX]([0-9a-fA-F]{9,}))")
_CDATA_MARK = "pagemill-cdata "
# Text up to a tag of the plainest form, and that tag: no attributes, or some in double quotes after one space each.
_PLAIN = re.compile(r'([^<&]*)<(?:([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z0-9_:.-]*="[^"]*")*)|/([a-zA-Z][a-zA-Z0-9]*))>')
_PLAIN_ATTRIBUTE = re.compile(r' ([a-zA-Z][a-zA-Z0-9_:.-]*)="([^"]*)"')

# Kind of the row that stands for a page that could not be parsed, and how much of the reason it keeps.
ERROR = "error"
REASON_CHARS = 500

# Nodes per Arrow batch sent back to the JVM.
_BATCH_NODES = 50_000


class _Columns:
    """Growing node columns of the current output batch."""

    def __init__(self) -> None:
        self.row: list[int] = []
        self.feed: list[bool] = []
        self.id: list[int] = []
        self.parent: list[int | None] = []
        self.end: list[int] = []
        self.kind: list[str] = []
        self.tag: list[str | None] = []
        self.text: list[str | None] = []
        self.attr_end: list[int] = [0]
        self.attr_key: list[str] = []
        self.attr_value: list[str] = []

    def to_batch(self, page_ids: pa.Array, urls: pa.Array) -> pa.RecordBatch:
        rows = pa.array(self.row, pa.int32())
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_end, pa.int32()),
            pa.array(self.attr_key, pa.string()),
            pa.array(self.attr_value, pa.string()),
        )
        return pa.RecordBatch.from_arrays(
            [
                page_ids.take(rows),
                urls.take(rows),
                pa.array(self.feed, pa.bool_()),
                pa.array(self.id, pa.int32()),
                pa.array(self.parent, pa.int32()),
                pa.array(self.end, pa.int32()),
                pa.array(self.kind, pa.string()),
                pa.array(self.tag, pa.string()),
                attrs,
                pa.array(self.text, pa.string()),
            ],
            names=NODES.names,
        )


class _Nodes(HTMLParser):
    """Turns parser events of one page into node rows.

    Trees follow the standard library parser, not HTML5: nothing closes by
    implication, an end tag closes back to the nearest open element of its
    name, and one without an open partner is ignored.
    """

    # the behaviour of all interpreter patch levels, stated here once
    CDATA_CONTENT_ELEMENTS = ("script", "style")
    RCDATA_CONTENT_ELEMENTS = ()

    def __init__(self, out: _Columns, row: int, sections: list[str], merge: bool) -> None:
        super().__init__(convert_charrefs=False)
        self.out, self.row0, self.sections, self.merge = out, row, sections, merge
        self.base = len(out.id)
        self.stack: list[tuple[str, int]] = []
        self.open_count: dict[str, int] = {}
        self.closed_void: dict[str, int] = {}
        self.muted = self.preformatted = 0
        self.buffer: list[str] = []
        self.pieces: list[str] = []
        self.is_feed = self.split_text = False
        self.searched: str | None = None
        self.last_end: dict[str, int] = {}
        self._add("doc", "[document]", None)

    def _add(self, kind: str, tag: str | None, text: str | None, attrs=()) -> int:
        out = self.out
        node = len(out.kind) - self.base
        out.parent.append(self.stack[-1][1] if self.stack else (0 if node else None))
        out.end.append(node + 1)
        out.kind.append(kind)
        out.tag.append(tag)
        out.text.append(text)
        if attrs:
            unique = {k: "" if v is None else v for k, v in attrs}
            out.attr_key.extend(unique.keys())
            out.attr_value.extend(unique.values())
        out.attr_end.append(len(out.attr_key))
        return node

    # markup that never ends ---------------------------------------------
    # A search for an end that is not there reads the rest of the page. It is
    # made once for each kind of end, not at each place that opens a tag.
    def _lacks(self, end: str, after: int) -> bool:
        """No `end` from `after` on."""
        if self.rawdata is not self.searched:
            self.searched, self.last_end = self.rawdata, {}
        if end not in self.last_end:
            self.last_end[end] = self.rawdata.rfind(end)
        return self.last_end[end] < after

    def check_for_whole_start_tag(self, i: int) -> int:
        return -1 if self._lacks(">", i) else super().check_for_whole_start_tag(i)

    def parse_starttag(self, i: int) -> int:
        return self._plain_run(i) or super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        if self._lacks(">", i):
            return -1
        return self._plain_run(i) or super().parse_endtag(i)

    def parse_pi(self, i: int) -> int:
        return -1 if self._lacks(">", i) else super().parse_pi(i)

    def parse_bogus_comment(self, i: int, report: int = 1) -> int:
        return -1 if self._lacks(">", i) else super().parse_bogus_comment(i, report)

    def parse_html_declaration(self, i: int) -> int:
        unended = self._lacks(">", i) and not self.rawdata.startswith("<![", i)
        return -1 if unended else super().parse_html_declaration(i)

    def parse_comment(self, i: int, report: bool = True) -> int:
        return -1 if self._lacks("--", i + 4) or self._lacks(">", i + 4) else super().parse_comment(i, report)

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def _plain_run(self, i: int) -> int:
        """Take text and tags of the plainest form from `i` on; where they end, 0 if there are none.

        The standard parser gives the same events for them, one at a time and more slowly.
        """
        rawdata, at = self.rawdata, 0
        while self.cdata_elem is None and (m := _PLAIN.match(rawdata, at or i)):
            text, tag, attrs, ended = m.groups()
            at = m.end()
            if text:
                self.buffer.append(text)
            if ended:
                self.handle_endtag(ended.lower())
                continue
            tag = tag.lower()
            found = _PLAIN_ATTRIBUTE.findall(attrs) if attrs else ()
            self._open(tag, [(k.lower(), unescape(v)) for k, v in found])
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
        return at

    # text ---------------------------------------------------------------
    def _end_string(self) -> None:
        """Close the current string; blank ones shrink to one character."""
        if self.buffer:
            s = "".join(self.buffer)
            self.buffer.clear()
            if not self.preformatted and not s.strip(" \n\t\f\r"):
                s = "\n" if "\n" in s else " "
            self.pieces.append(s)

    def _flush(self) -> None:
        self._end_string()
        if self.pieces:
            self._add("data" if self.muted else "text", None, "".join(self.pieces))
            self.pieces.clear()

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)

    def handle_entityref(self, name: str) -> None:
        self.buffer.append(html5.get(name + ";") or "&" + name)

    def handle_charref(self, name: str) -> None:
        digits = name[1:] if name[0] in "xX" else name
        code = int(digits, 16 if digits is not name else 10) if len(digits.lstrip("0")) <= 8 else -1  # beyond any character
        if 0 <= code < 256:
            try:
                self.buffer.append(bytes([code]).decode("windows-1252"))
                return
            except UnicodeDecodeError:
                pass
        try:
            text = chr(code)
            text.encode("utf-8")
        except (ValueError, OverflowError):
            text = "�"
        self.buffer.append(text)

    # elements -----------------------------------------------------------
    def handle_starttag(self, tag: str, attrs) -> None:
        self._open(tag, attrs)

    def handle_startendtag(self, tag: str, attrs) -> None:
        if self._open(tag, attrs):
            self._close_to(tag)

    def _open(self, tag: str, attrs) -> bool:
        """Add an element; true when it stays open."""
        self._flush()
        node = self._add("elem", tag, None, attrs)
        if tag in FEED_ELEMENTS:
            self.is_feed = True
        if tag in VOID_ELEMENTS:
            self.closed_void[tag] = self.closed_void.get(tag, 0) + 1
            return False
        self.stack.append((tag, node))
        self.open_count[tag] = self.open_count.get(tag, 0) + 1
        if tag in DATA_ELEMENTS:
            self.muted += 1
        elif tag in PREFORMATTED:
            self.preformatted += 1
        return True

    def _close_to(self, tag: str) -> None:
        self._flush()
        while self.stack:
            top, node = self.stack.pop()
            self.out.end[self.base + node] = len(self.out.kind) - self.base
            self.open_count[top] -= 1
            if top in DATA_ELEMENTS:
                self.muted -= 1
            elif top in PREFORMATTED:
                self.preformatted -= 1
            if top == tag:
                break

    def handle_endtag(self, tag: str) -> None:
        if self.closed_void.get(tag):
            self.closed_void[tag] -= 1
        elif self.open_count.get(tag):
            self._close_to(tag)
        elif self.merge:
            self._end_string()
        else:
            self.split_text = self.split_text or bool(self.buffer)
            self._flush()

    # everything else ----------------------------------------------------
    def handle_comment(self, data: str) -> None:
        self._flush()
        self._add("comment", None, data)

    def handle_decl(self, decl: str) -> None:
        self._flush()
        self._add("decl", None, f"<!{decl}>")

    def unknown_decl(self, data: str) -> None:
        self._flush()
        self._add("decl", None, f"<![{data}]>")

    def handle_pi(self, data: str) -> None:
        self._flush()
        number = data[len(_CDATA_MARK) :]
        if data.startswith(_CDATA_MARK) and number.isdigit() and int(number) < len(self.sections):
            self.buffer.append(self.sections[int(number)])
            self._flush()
        else:
            self._add("decl", None, f"<?{data}>")

    def finish(self) -> None:
        self._flush()
        size = len(self.out.kind) - self.base
        self.out.row.extend([self.row0] * size)
        self.out.id.extend(range(size))
        for _, node in self.stack:
            self.out.end[self.base + node] = size
        self.out.end[self.base] = size
        self.out.feed.extend([self.is_feed] * size)


def _drop_page(out: _Columns, base: int) -> None:
    keys = out.attr_end[base]
    del out.attr_end[base + 1 :], out.attr_key[keys:], out.attr_value[keys:]
    for column in (out.row, out.feed, out.id, out.parent, out.end, out.kind, out.tag, out.text):
        del column[base:]


def _short_reference(m: re.Match) -> str:
    """The same character with few digits; beyond all characters, one such number."""
    digits = (m[1] or m[2]).lstrip("0") or "0"
    return f"&#{'x' if m[2] else ''}{digits}" if len(digits) <= 8 else "&#x110000"


def _append_page(out: _Columns, row: int, html: str) -> None:
    """Parse one page into `out`.

    Strings that only an ignored end tag separates count as one on an HTML
    page and as two in a feed, and which it is shows only at the end.
    """
    sections: list[str] = []
    if "<![" in html:

        def mark(m: re.Match) -> str:
            sections.append(m.group(1))
            return f"<?{_CDATA_MARK}{len(sections) - 1}>"

        html = _CDATA.sub(mark, html)
    if "&#" in html:  # whole numbers of any length end the standard parser in attributes
        html = _LONG_REFERENCE.sub(_short_reference, html)
    base = len(out.id)
    merge = _MAYBE_FEED.search(html) is None
    while True:
        page = _Nodes(out, row, sections, merge)
        try:
            page.feed(html)
            page.close()
        except AssertionError:  # a marked section the parser does not know
            _drop_page(out, base)
            html = html.replace("<![", "&lt;![")
            continue
        page.finish()
        if page.split_text and not page.is_feed and not merge:
            _drop_page(out, base)
            merge = True
            continue
        return


def _append_or_report(out: _Columns, row: int, html: str) -> None:
    """One page's nodes, or one row with the reason why it has none: no page ends the job."""
    base = len(out.id)
    try:
        _append_page(out, row, html)
    except Exception as e:
        _drop_page(out, base)
        out.feed.append(False)
        out.row.append(row)
        out.id.append(0)
        out.parent.append(None)
        out.end.append(1)
        out.kind.append(ERROR)
        out.tag.append(None)
        out.text.append(f"{type(e).__name__}: {e}"[:REASON_CHARS])
        out.attr_end.append(len(out.attr_key))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page_ids, urls, pages = batch.column(0), batch.column(1), batch.column(2)
        out = _Columns()
        for row, html in enumerate(pages):
            _append_or_report(out, row, html.as_py() or "")
            if len(out.id) >= _BATCH_NODES:
                yield out.to_batch(page_ids, urls)
                out = _Columns()
        if out.id:
            yield out.to_batch(page_ids, urls)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Node rows of every page; a page that cannot be parsed is one row of kind `error`, its reason as text.

    Only the three columns the parser needs cross into Python: no filter or
    projection moves through a Python step by itself.
    """
    require_columns(pages, "page_id", "url", "html")
    narrow = pages.select(F.col("page_id").cast("long"), "url", "html")
    return narrow.mapInArrow(_parse_batches, NODES)


def without_errors(parsed: DataFrame) -> DataFrame:
    """The nodes of the pages that could be parsed."""
    return parsed.filter(F.col("kind") != ERROR)


def parse_errors(parsed: DataFrame) -> DataFrame:
    """(page_id, url, reason) of the pages that could not be parsed."""
    return parsed.filter(F.col("kind") == ERROR).select("page_id", "url", F.col("text").alias("reason"))


def parse_html(pages: DataFrame) -> DataFrame:
    """Lenient HTML to node rows; `parse_pages` and `parse_errors` tell of pages that cannot be parsed."""
    return without_errors(parse_pages(pages))


def parse_feed(pages: DataFrame) -> DataFrame:
    """XML, RSS and Atom to the same node rows, CDATA as text.

    XML takes the lenient parser too: names in lower case, `link` void.
    """
    if "content_kind" in pages.columns:
        pages = pages.filter(F.col("content_kind") == "xml")
    return parse_html(pages)


def _fragment_strings(html: str) -> str:
    out = _Columns()
    _append_page(out, 0, html)
    strings = (t.strip() for k, t in zip(out.kind, out.text) if k == "text")
    return " ".join(s for s in strings if s)


@F.arrow_udf(T.StringType())
def _fragment_text(fragments: pa.Array) -> pa.Array:
    return pa.array(
        [None if f is None else _fragment_strings(f) for f in fragments.to_pylist()], pa.string()
    )


def fragment_text(col: Column) -> Column:
    """Text of a markup fragment, strings joined by one space; null stays null."""
    return _fragment_text(col)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _fragment_texts(pages: pa.Array) -> pa.Array:
    def text(s: str | None) -> str | None:
        return _fragment_strings(s) if s and "<" in s and ">" in s else s

    return pa.array([None if p is None else [text(s) for s in p] for p in pages.to_pylist()], pa.list_(pa.string()))


def fragment_texts(col: Column) -> Column:
    """The same for an array; strings without markup stay as they are."""
    return _fragment_texts(col)
