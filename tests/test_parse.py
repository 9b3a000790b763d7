import random
import time
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from pages import by_page, nodes_of, one_column

from pagemill.operators import nodes as N
from pagemill.operators import parse as P
from pagemill.operators.parse import fragment_text, parse_errors, parse_html, parse_pages


def rows(spark, html):
    return nodes_of(spark, html).orderBy("id").collect()


def shape(spark, html):
    return [(r.kind, r.tag, r.text, r.id, r.parent, r.end) for r in rows(spark, html)]


def test_tree_and_intervals(spark):
    assert shape(spark, "<p>a<b>c</b></p>d") == [
        ("doc", "[document]", None, 0, None, 6),
        ("elem", "p", None, 1, 0, 5),
        ("text", None, "a", 2, 1, 3),
        ("elem", "b", None, 3, 1, 5),
        ("text", None, "c", 4, 3, 5),
        ("text", None, "d", 5, 0, 6),
    ]


def test_unclosed_elements_nest(spark):
    r = {x.id: x for x in rows(spark, "<p>a<p>b</div><br></br><li>c")}
    assert [(x.tag, x.parent) for x in r.values() if x.kind == "elem"] == [("p", 0), ("p", 1), ("br", 3), ("li", 3)]
    assert all(x.end == len(r) for x in r.values() if x.tag in ("p", "li", "[document]"))


def test_intervals_nest_on_real_pages(spark):
    from pagemill.operators.parse import parse_html
    from pagemill.sources.pages import read_pages

    nodes = parse_html(read_pages(spark, "/root/testdata/sf0.001/pages.parquet"))
    parents = nodes.selectExpr("page_id", "id as parent", "id as pid", "end as pend")
    bad = nodes.filter("parent is not null").join(parents, ["page_id", "parent"]).filter("id <= pid or end > pend")
    assert bad.count() == 0


def test_entities_follow_the_lenient_rules(spark):
    texts = [x.text for x in rows(spark, "&amp; &copy &nosuch; &#65;&#x42; &#150; &lt;b&gt; &#xD800;") if x.kind == "text"]
    assert texts == ["& © &nosuch AB – <b> �"]


def test_script_style_template_ruby_are_no_text(spark):
    html = "<script>a<b></script><style>c</style><template><p>d</p></template><ruby>e<rt>f</rt></ruby>"
    assert by_page(N.extract_text(nodes_of(spark, html)), "text") == {0: "e"}


def test_cdata_is_text_of_its_own(spark):
    texts = [x.text for x in rows(spark, "<rss>x<![CDATA[<i>y</i>]]>z</rss>") if x.kind == "text"]
    assert texts == ["x", "<i>y</i>", "z"]


def test_unknown_marked_section_does_not_stop_the_page(spark):
    assert by_page(N.extract_text(nodes_of(spark, "a<![foo[b]]>c<p>d</p>")), "text")[0].endswith("d")


def test_ignored_end_tag_joins_strings_in_html_and_splits_them_in_feeds(spark):
    html = by_page(N.extract_text(nodes_of(spark, "a</x>b", "<rss>a</x>b</rss>")), "text")
    assert html == {0: "ab", 1: "a\nb"}


def test_attributes(spark):
    r = rows(spark, "<a HREF='x&amp;y' href=\"last\" checked class=''>t</a>")[1]
    assert r.attrs == {"href": "last", "checked": "", "class": ""}


def test_null_and_empty_pages(spark):
    assert nodes_of(spark, None, "").count() == 2


def test_fragment_text(spark):
    assert one_column(spark, ["<p> a </p><b>b</b>", None, "x"], fragment_text) == ["a b", None, "x"]


def test_endless_character_reference(spark):
    html = "<p>a&#" + "9" * 5000 + ";b&#x" + "f" * 5000 + ";c&#00065;</p>"
    rows = parse_html(spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")).collect()
    assert any(r.text == "a\ufffdb\ufffdcA" for r in rows)


def test_endless_character_reference_in_an_attribute(spark):
    html = "<a href='&#" + "9" * 5000 + ";x&#x" + "f" * 5000 + ";&#" + "0" * 5000 + "65;'>t</a>"
    found = [r.attrs["href"] for r in rows(spark, html) if r.tag == "a"]
    assert found == ["\ufffdx\ufffdA"]


def test_markup_bytes_are_decoded_by_charset():
    from pagemill.sources.pages import decode_markup

    assert decode_markup("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert decode_markup(b"<meta charset='latin-1'>\xe9") == "<meta charset='latin-1'>é"
    assert decode_markup(b"\xff\xfe" + "é".encode("utf-16-le")) == "é"
    assert decode_markup(b"\xe9", "text/html; charset=unheard-of") == "\ufffd"


class PlainSearch(P._Nodes):
    """The parser with the standard library's own searches for the ends of tags."""

    check_for_whole_start_tag = HTMLParser.check_for_whole_start_tag
    parse_endtag = HTMLParser.parse_endtag
    parse_pi = HTMLParser.parse_pi
    parse_bogus_comment = HTMLParser.parse_bogus_comment
    parse_html_declaration = HTMLParser.parse_html_declaration
    parse_comment = HTMLParser.parse_comment


def columns_of(html):
    out = P._Columns()
    P._append_page(out, 0, html)
    return vars(out)


def test_searches_for_ends_change_no_node(monkeypatch):
    rng = random.Random(4)
    bits = ["<a ", "<a", "</a", "</", "<!--", "-->", "--", ">", "<?", "<!", "<!doctype", "'", '"', "=", "x", " ", "&", "&#", "<b>", "<script>", "</script>", "/", "\n"]
    pages = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(5000)]
    found = [columns_of(p) for p in pages]
    monkeypatch.setattr(P, "_Nodes", PlainSearch)
    assert [columns_of(p) for p in pages] == found


@pytest.mark.parametrize("unit", ["<a ", "</a ", "<!--", "<?", "<!doctype ", "<p>", "<a x='", "<b><i "])
def test_a_hundred_thousand_unclosed_tags(unit):
    start = time.process_time()
    columns_of(unit * 100_000)
    assert time.process_time() - start < 20  # the plain searches take many minutes


def test_a_page_that_cannot_be_parsed_is_one_row(monkeypatch):
    append = P._append_page

    def fails_late(out, row, html):
        append(out, row, html)
        if "poison" in html:
            raise ValueError("a reason " + "x" * 5000)

    pages = ["<p a=1>one</p>", "<p b=2>poison<i>", "<p c=3>three", None]
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2, 3, 4], "url": list("abcd"), "html": pages})
    plain = pa.Table.from_batches(P._parse_batches(iter([batch]))).to_pylist()
    monkeypatch.setattr(P, "_append_page", fails_late)
    found = pa.Table.from_batches(P._parse_batches(iter([batch]))).to_pylist()
    errors = [r for r in found if r["kind"] == P.ERROR]
    assert [(r["page_id"], r["url"], r["text"][:20], len(r["text"])) for r in errors] == [(2, "b", "ValueError: a reason", P.REASON_CHARS)]
    assert [r for r in found if r["kind"] != P.ERROR] == [r for r in plain if r["page_id"] != 2]


def test_errors_are_their_own_table(spark):
    rows = parse_pages(spark.createDataFrame([(1, "u", "<p>a")], "page_id long, url string, html string"))
    assert parse_errors(rows).count() == 0 and rows.count() == 3
    failed = rows.filter("id = 0").selectExpr("page_id + 1 as page_id", "url", "feed", "id", "parent", "end", "'error' as kind", "cast(null as string) as tag", "attrs", "'why' as text")
    both = rows.union(failed)
    assert [tuple(r) for r in parse_errors(both).collect()] == [(2, "u", "why")]
    assert P.without_errors(both).collect() == rows.collect()


def test_plain_tags_equal_the_standard_way(monkeypatch):
    import random
    import re

    from pagemill.operators import parse

    rng = random.Random(5)
    parts = ["<p>", "</p>", "<P>", "<b >", "</b >", '<a href="/x?a=1&amp;b">', "</A>", '<a HREF="y" id="">', "<a href='z'>", '<a href="q"/>', '<i a="1" a="2">', '<i a="<p>">', '<i a="', '"', ">", "<", "&", "&amp;", "&#65;", "text ", "\n", " ", "<br>", "</br>", "<br/>", "<script>", "</script>", "<style>", "</style>", "<pre>", "</pre>", "<!-- c -->", "<!doctype html>", "<rss>", "<![CDATA[x<p>]]>", "</", "<3", "<x:y>", "<h1>"]
    pages = ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(4000)]

    def all_nodes():
        out = parse._Columns()
        for row, html in enumerate(pages):
            parse._append_or_report(out, row, html)
        return [vars(out)[k] for k in sorted(vars(out))]

    quick = all_nodes()
    monkeypatch.setattr(parse, "_PLAIN", re.compile(r"(?!)"))
    assert quick == all_nodes()
