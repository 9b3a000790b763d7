"""Page text on hand-made pages: what must show and what must not."""

import hashlib

import pytest
from pages import by_page, nodes_of, page_frame

from pagemill.operators import nodes as N
from pagemill.operators.page_text import extract_page_text
from pagemill.options import ExtractOptions

CASES = {
    # cut by role: anywhere, in any case, also strictly inside the main content
    "role_list": (
        '<ol role="navigation"><li>Tides<li>Ferries</ol><section><main>High water comes at six.</main></section>',
        ["High water comes at six."], ["Tides", "Ferries"],
    ),
    "role_inside": (
        '<main><p role="ContentInfo">Find a berth</p><dl role="list"><dt>Draught<dd>Two metres</dl></main>',
        ["Draught", "Two metres"], ["Find a berth"],
    ),
    # cut by class and id
    "class_of_many": (
        '<main>Berth nine<span class="x sidebar wide">Pilot rota</span></main>', ["Berth nine"], ["Pilot rota"],
    ),
    "id_part": (
        '<article><table><tr id="quick-menu-2"><td>Charts</tr><tr><td>Depth at the pier</table></article>',
        ["Depth at the pier"], ["Charts"],
    ),
    "furniture_around": (
        "<header>Port of Aln</header><aside>Wind: north</aside><article>Arrivals<i class='breadcrumb'>Aln, 1904</i>"
        "<b id='social-share'>Tell the harbour master</b></article><footer>Lamp lit at dusk</footer>",
        ["Arrivals"], ["Port of Aln", "Wind: north", "Aln, 1904", "Tell the harbour master", "Lamp lit at dusk"],
    ),
    "inputs": (
        "<article>Cargo<form>Tonnage <select><option>Coal</select></form><ul><li>Timber<button>Weigh</button><li>Salt</ul></article>",
        ["Cargo", "Timber", "Salt"], ["Tonnage", "Coal", "Weigh"],
    ),
    # links
    "link_text": (
        '<table><tr><td><a href="//aln.test/log?d=4">log of the fourth</a><td><a href="../crew.txt"><u>crew</u></a></table>',
        ["log of the fourth", "crew"], ["aln.test", "crew.txt"],
    ),
    "link_without_text": ('<p>Anchor<a href="http://aln.test/a"> </a><a href="b"></a>chain</p>', ["Anchor", "chain"], ["aln.test"]),
    # URLs in the text
    "url_parens": ("<li>Almanac (http://aln.test/almanac_(1904)) page nine", ["Almanac", "page nine"], ["http://", "aln.test"]),
    "url_brackets": ("<dd>Note [http://aln.test/n] beside [7]: sounding", ["[7]", "sounding"], ["aln.test"]),
    "url_bare": ("<dd>Signals www.aln.test then ftp://flags.test then https://aln.test:81 noon gun", ["Signals", "noon gun"], ["www.", "ftp://", ":81"]),
    "url_query": ("<h4>Lookout http://aln.test/x?from=n&to=s#top reports</h4>", ["Lookout", "reports"], ["from=", "#top"]),
    "read_more": ('<article>Text<span class="read-more">cut</span><span class="ad">stays</span></article>', ["Text", "stays"], ["cut"]),
    "main_is_widget": ('<main class="widget">Kept<p class="widget">gone</p></main>', ["Kept"], ["gone"]),
    "ancestor_is_widget": ('<div class="widget"><main>Kept</main></div>', ["Kept"], []),
    "excluded_main": ("<body><nav><article>In nav</article></nav><p>Rest</p></body>", ["Rest"], ["In nav"]),
    "priority_beats_order": ('<div class="content">Low</div><div id="content">Mid</div><main>High</main>', ["High"], ["Low", "Mid"]),
    "class_token": ('<body><div class="content-x">A</div><div class="b content c">B</div></body>', ["B"], ["A"]),
    "no_body": ("plain <i>words</i>", ["plain", "words"], []),
    "comment": ("<body>a<!-- hidden -->b</body>", ["a", "b"], ["hidden"]),
}


@pytest.fixture(scope="module")
def texts(spark):
    frame = page_frame(spark, *[c[0] for c in CASES.values()])
    found = by_page(extract_page_text(frame), "text")
    return {name: found.get(i, "") for i, name in enumerate(CASES)}


@pytest.mark.parametrize("name", CASES)
def test_case(texts, name):
    _, wanted, unwanted = CASES[name]
    for part in wanted:
        assert part in texts[name]
    for part in unwanted:
        assert part not in texts[name]


def test_lines_links_and_nested_anchors(spark):
    html = '<p>Row <a href="x"> to <b>the</b> buoy<a href="y">!</a></a> then <pre>a\n \n\n b</pre></p>'
    assert by_page(extract_page_text(page_frame(spark, html)), "text") == {0: "Row\ntothebuoy!\nthen\na\n\n b"}


def test_page_text_is_the_chain_of_its_operators(spark):
    from pagemill.operators.page_text import clean_text
    from pagemill.sources.pages import read_pages
    from pyspark.sql import functions as F

    pages = read_pages(spark, "/root/testdata/sf0.001/pages.parquet")
    from pagemill.operators.parse import parse_html

    nodes = N.drop_excluded_elements(parse_html(pages))
    chain = N.extract_text(N.flatten_links(N.drop_by_class_id(N.drop_by_role(N.select_main_content(nodes)))))
    chained = by_page(chain.withColumn("text", clean_text(F.col("text"))), "text")
    assert by_page(extract_page_text(pages), "text") == {k: v for k, v in chained.items() if v}


def test_empty_page_gives_no_row(spark):
    frame = page_frame(spark, "<script>x</script><style>y</style>", None, "<p>(http://only.url/x)</p>")
    assert extract_page_text(frame).count() == 0


def test_names(spark):
    row = extract_page_text(page_frame(spark, "<p>grüße</p>")).first()
    digest = hashlib.sha256("grüße".encode()).hexdigest()[:32]
    assert (row.content_hash, row.filename, row.url) == (digest, f"content_{digest}.txt", "http://example.com/dir/page.html")


STRUCTURED = [
    ("<main><h2> Two </h2>loose<p>a<b>b</b> c</p><ul><li>x<p>y</p></li></ul></main>", "## Two\n\nabc\n• xy\n\ny"),
    ("<main><p>one<p>two</main>", "onetwo\n\ntwo"),
    ('<main><a href="x"><p>in link</p></a><p>see <a href="y">this</a></p></main>', "seethis"),
    ("<main><p></p>only loose</main>", None),
    ('<main><h3>Head</h3><p class="menu">gone</p></main>', "### Head"),
]


def test_structured_mode(spark):
    frame = page_frame(spark, *[h for h, _ in STRUCTURED])
    texts = by_page(extract_page_text(frame, ExtractOptions(preserve_structure=True)), "text")
    assert texts == {i: t for i, (_, t) in enumerate(STRUCTURED) if t}


RSS = (
    "<?xml version='1.0'?><rss><channel><title>Feed</title>"
    "<item><title>One</title><link>http://x/1</link><description><![CDATA[<p>First</p><p>para</p>]]></description>"
    "<content:encoded>Body one</content:encoded></item>"
    "<item><description>Second</description><title>Two</title></item></channel></rss>"
)
ATOM = "<feed><title>F</title><entry><title>A</title><summary>S</summary><content>C &lt;b&gt;bold&lt;/b&gt;</content></entry></feed>"


def test_feeds(spark):
    frame = page_frame(
        spark, RSS, ATOM, "<rss><channel><title>T</title><description>D</description></channel></rss>",
        "<body><channel>x</channel><nav>y</nav></body>", "<rss><channel><item></item></channel></rss>",
    )
    assert by_page(extract_page_text(frame), "text") == {
        0: "One\n\nFirst para\n\nBody one\n\nTwo\n\nSecond",
        1: "A\n\nS\n\nC bold",
        2: "T\nD",
        3: "x\ny",
    }
    assert {r.url for r in extract_page_text(frame).collect()} == {"http://example.com/dir/page.html"}


def test_feed_text_reads_its_nodes_once(spark):
    from pagemill.operators.feeds import extract_feed_text

    plan = extract_feed_text(nodes_of(spark, RSS, ATOM))._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_unclosed_items_each_take_their_first_fields(spark):
    from pagemill.operators.feeds import feed_items

    items = feed_items(nodes_of(spark, "<rss><item><title>A</title><item><title>B</title><summary>S</summary></rss>"))
    assert [(r.field, r.text) for r in items.orderBy("item_id", "field").collect()] == [
        ("summary", "S"), ("title", "A"), ("summary", "S"), ("title", "B"),
    ]


def test_many_spans_in_one_page(spark):
    """Deeply nested blocks against a direct count over intervals."""
    html = "<main>" + "".join(f"<p>w{i}" for i in range(60)) + "</main>"
    text = extract_page_text(page_frame(spark, html), ExtractOptions(preserve_structure=True)).first().text
    paragraphs = text.split("\n\n")
    assert paragraphs == ["".join(f"w{j}" for j in range(i, 60)) for i in range(60)]


def test_clean_html(spark):
    from pagemill.operators.clean_html import clean_html

    out = by_page(
        clean_html(
            nodes_of(
                spark,
                "<html><head><title>A &amp; B</title><link href=x></head><body><nav>n</nav>"
                "<article class=\"c\" data-x='say \"hi\"'>t &lt; u<br><b>v</b><script>s</script><!--k--></article></body></html>",
                "<p>no main</p><form>f</form>",
                "<main>m</main>",
            )
        ),
        "cleaned_html",
    )
    assert out == {
        0: "<html><head><title>A &amp; B</title></head><body><article class=\"c\" data-x='say \"hi\"'>"
        "t &lt; u<br/><b>v</b><!--k--></article></body></html>",
        1: "<p>no main</p>",
        2: "<html><head><title>Extracted Content</title></head><body><main>m</main></body></html>",
    }
