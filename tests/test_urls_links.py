from urllib.parse import urlparse

import pytest
from pages import nodes_of, one_column, page_frame
from pyspark.sql import functions as F

from pagemill.functions.urls import absolute_url, canonical_url, request_path, root_url, url_parts
from pagemill.operators.crawl import crawl, crawl_limit, crawl_summary, page_edges, ranked, seeds_frame
from pagemill.operators.links import extract_links, link_stats, new_links, same_domain

URLS = [
    "http://h.com/a/b;p?q=1#f", "https://u:p@H:8443/a;x/b?", "HTTP://h", "http://h?x=/y#z?w", "/a/b", "//h/x;y",
    "mailto:a@b", "http://h/a//b/", "http://h/#", "", "tel:1", "http://h/é b?c=d;e", "a.html", "http://h/x;a;b",
]


def test_url_parts_equal_the_standard_library(spark):
    got = one_column(spark, URLS, url_parts)
    for url, parts in zip(URLS, got):
        want = urlparse(url)
        assert tuple(parts)[:6] == tuple(want), url
        assert parts.port == (443 if want.scheme == "https" else 80)


BASE = "http://h.com:80/a/b.html;v?q#f"
HREFS = {
    "/x": "http://h.com:80/x",
    "c.html": "http://h.com:80/a/b.htmlc.html",
    "//o/x": "http://h.com:80//o/x",
    "HTTP://o/x": "http://h.com:80/a/b.htmlHTTP://o/x",
    "https://o/x": "https://o/x",
    "tel:1": "http://h.com:80/a/b.htmltel:1",
}


def test_absolute_url(spark):
    assert one_column(spark, list(HREFS), lambda c: absolute_url(F.lit(BASE), c)) == list(HREFS.values())


def test_absolute_url_rfc3986(spark):
    from urllib.parse import urljoin

    base = "http://h.com/a/b/c.html?q"
    hrefs = ["/x", "d.html", "../e", "./f/", "//o/x", "?z=1", "#t", "", "https://o/y", "../../../g", "..", "h/./i/../j?k=../l"]
    assert one_column(spark, hrefs, lambda c: absolute_url(F.lit(base), c, "rfc3986")) == [urljoin(base, h) for h in hrefs]


def test_canonical_root_and_request_path(spark):
    assert one_column(spark, ["HTTP://H/a;p?q=1#f", "http://h/a?#f"], canonical_url) == ["http://H/a?q=1", "http://h/a"]
    assert one_column(spark, ["https://h:1/a"], root_url) == ["https://h:1"]
    urls = ["http://h/p;v?a=b c&d=*~%20#t", "http://h/p?k", "http://h/p?a=1&b=é+", "http://h/p?=x", "http://h"]
    want = ["/p:v?a=b+c&d=%2A~%2520#t", "/p?k", "/p?a=1&b=%C3%A9%2B", "/p?=x", ""]
    assert one_column(spark, urls, request_path) == want
    assert one_column(spark, urls[:1], lambda c: request_path(c, path_only=True)) == ["/p"]


def test_links_in_order_and_skips(spark):
    html = (
        '<nav><a href=" /1#f ">x</a></nav><a href="#a"></a><a href="javascript:x"></a><a href="mailto:a"></a><a></a>'
        '<a href="JavaScript:y"></a><a href="http://[bad/x"></a><a href="/2;p?q=1"></a><a href="http://other.com/"></a>'
    )
    links = extract_links(nodes_of(spark, html, url="http://h.com/d/p"))
    assert [r.link_url for r in links.orderBy("pos").collect()] == [
        "http://h.com/1", "http://h.com/d/pJavaScript:y", "http://h.com/2?q=1", "http://other.com/",
    ]
    assert same_domain(links).count() == 3


def test_new_links_and_stats(spark):
    links = extract_links(nodes_of(spark, '<a href="/a"></a><a href="/b"></a><a href="/a"></a>', '<a href="/b"></a><a href="/c"></a>', url="http://h/"))
    seen = spark.createDataFrame([("http://h/c",)], "url string")
    assert {(r.link_url, r.page_id) for r in new_links(links, seen).collect()} == {("http://h/a", 0), ("http://h/b", 0)}
    stats = {r.page_id: (r.links_found, r.links_queued) for r in link_stats(links, seen).collect()}
    assert stats == {0: (3, 2), 1: (2, 0)}


def site(spark, graph):
    rows = [
        (i, f"http://s/{u}", "".join(f'<a href="{h}">l</a>' for h in hrefs))
        for i, (u, hrefs) in enumerate(graph.items())
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


GRAPH = {
    "0": ["/1", "/2", "http://away/", "/0"],
    "1": ["/3", "/2", "/missing"],
    "2": ["/4#x", "/1"],
    "3": ["/0"],
    "4": ["/5?q=1"],
    "5?q=1": [],
    "island": ["/0"],
}


def queue_walk(graph, seed, limit):
    """The same walk with a plain queue."""
    visited, queue = [], [seed]
    while queue and not (limit and len(visited) >= limit):
        url = queue.pop(0)
        if url in visited:
            continue
        visited.append(url)
        for href in graph.get(url.removeprefix("http://s/"), []):
            if href.startswith("/"):
                queue.append("http://s" + href.split("#")[0])
    return visited


@pytest.mark.parametrize("limit", [None, 0, 1, 2, 3, 5, 6, 100])
def test_crawl_equals_a_queue(spark, limit):
    visited = crawl(site(spark, GRAPH), ["http://s/0"], limit)
    assert {r.url for r in visited.collect()} == set(queue_walk(GRAPH, "http://s/0", limit))


def test_crawl_of_a_random_graph(spark):
    import random

    rng = random.Random(7)
    graph = {str(i): [f"/{rng.randrange(60)}" for _ in range(rng.randrange(5))] for i in range(50)}
    for limit in (None, 17):
        rows = crawl(site(spark, graph), ["http://s/0"], limit).collect()
        assert len(rows) == len({r.url for r in rows})
        assert {r.url for r in rows} == set(queue_walk(graph, "http://s/0", limit))
        assert all((r.page_id is None) == (r.url.removeprefix("http://s/") not in graph) for r in rows)


def test_crawl_seed_with_fragment_and_copies_of_a_page(spark):
    pages = site(spark, GRAPH).unionByName(site(spark, {"0": ["/copy"]}).withColumn("page_id", F.lit(99).cast("long")))
    rows = {r.url: r for r in crawl(pages, ["http://s/0#top"]).collect()}
    assert rows["http://s/0#top"].depth == 0 and rows["http://s/0"].depth == 1
    assert rows["http://s/0"].page_id == 0 and "http://s/copy" not in rows
    total = {r.depth: r.pages for r in crawl_summary(crawl(pages, ["http://s/0"])).collect()}
    assert total[None] == 7 and total[0] == 1 and total[1] == 2


def test_urls_lose_breaks_and_leading_controls(spark):
    row = spark.createDataFrame([("\x01 http://h/a\n\tb?c\r=1",)], "u string").select(canonical_url(F.col("u")).alias("c")).first()
    assert row.c.startswith("http://h/ab")


def test_limit_is_ranked(spark):
    frontier = spark.range(1000).select((999 - F.col("id")).alias("path"), "id")
    want = set(range(400))
    assert {r.path for r in crawl_limit(frontier, 400, "path").collect()} == want
    assert [r["rank"] for r in ranked(frontier, "path").orderBy("path").collect()] == list(range(1, 1001))


def test_edges_are_joined_without_a_shuffle_of_their_own(spark):
    from pagemill.operators.crawl import _bucketed_edges, _next_level

    edges = page_edges(site(spark, GRAPH), seeds_frame(spark, ["http://s/0"]))
    level = spark.createDataFrame([("http://s/0", 1)], "url string, rank long")
    with _bucketed_edges(edges) as table:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = level.select(F.col("url").alias("src")).join(table, "src")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1
            assert _next_level(level, table, level, 1, True).count() == 2
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_growing_tables_are_not_broadcast(spark):
    from pagemill.operators.crawl import _bucketed_edges, _next_level

    def plan(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]

    edges = page_edges(site(spark, GRAPH), seeds_frame(spark, ["http://s/0"]))
    level = spark.createDataFrame([("http://s/0", 1)], "url string, rank long")
    with _bucketed_edges(edges) as table:
        for ordered in (False, True):
            assert "Broadcast" not in plan(_next_level(level, table, level, 1, ordered))
    assert plan(edges).count("BroadcastHashJoin") == 2  # the seeds' hosts, for markup and for page ids
    assert "Broadcast" not in plan(crawl(site(spark, GRAPH), ["http://s/0"]))


def test_page_frame_url(spark):
    assert page_frame(spark, "x").first().url.startswith("http://example.com/")


def test_short_ways_of_urls_equal_the_full_pattern(spark, monkeypatch):
    import random

    from pagemill.functions import urls

    rng = random.Random(11)
    parts = ["http", "hTTp", "s", ":", "//", "/", "a", "p.q", ";", "?", "#", "=", "[", "]", " ", "\t", "\n", "\r", "\x01", "\x85", "\u2028", "\u2029", "é", "@", "x:1"]
    given = URLS + [None] + [f"http://h{x}" for x in parts] + [f"http://h/a{x}" for x in parts] + [f"http://h/a?b{x}" for x in parts]
    given += ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(600)]
    given += ["http://" + "".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(600)]

    def both(c):
        return F.struct(urls.netloc(c), urls.root_url(c), urls.canonical_url(c), urls.has_valid_host(c))

    short = one_column(spark, given, both)
    for name in ("_ROOT", "_CANONICAL"):
        monkeypatch.setattr(urls, name, r"\z.")  # matches nothing
    assert short == one_column(spark, given, both)
    assert [r[3] for r in short] == [None if u is None else (r[0].count("[") > 0) == (r[0].count("]") > 0) for u, r in zip(given, short)]


def test_a_link_url_is_made_once(spark):
    links = same_domain(extract_links(nodes_of(spark, '<a href="/1">x</a>')))
    plan = links._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Generate") :]  # what reads the parsed rows
    assert "regexp" not in below[below.index("Filter") :]


def test_markup_is_not_shuffled_by_host_and_no_sort_makes_urls(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    given = plan(page_edges(site(spark, GRAPH), seeds_frame(spark, ["http://s/0"])))
    assert given.count("SortMergeJoin") == 1  # of links with their pages' ids
    joins = [x for x in plan(crawl(site(spark, GRAPH), ["http://s/0"])).split("\n") if "SortMergeJoin" in x]
    assert joins and all("regexp" not in x for x in joins)


def test_edges_are_not_sorted_at_a_level_and_levels_leave_nothing(spark):
    import os

    from pagemill.operators.crawl import _bucketed_edges, _next_level
    from pagemill.session import checkpoint_root

    def left():
        found = os.listdir(checkpoint_root(spark).removeprefix("file:"))
        return {x for x in found if x.startswith(("levels", "edges"))}

    edges = page_edges(site(spark, GRAPH), seeds_frame(spark, ["http://s/0"]))
    level = spark.createDataFrame([("http://s/0", 1)], "url string, rank long")
    with _bucketed_edges(edges) as table:
        before = left()  # this one, and those of other operators
        step = _next_level(level, table, level, 1, False)
        assert "Sort" not in step._jdf.queryExecution().executedPlan().toString()
        assert {r.url for r in step.collect()} == {"http://s/1", "http://s/2"}
    crawl(site(spark, GRAPH), ["http://s/0"], 3).count()
    assert left() < before


def test_seeds_may_be_none_or_null(spark):
    assert crawl(site(spark, GRAPH), []).count() == 0
    rows = crawl(site(spark, GRAPH), [None, "http://s/4"]).collect()
    assert {r.url for r in rows} == {None, "http://s/4", "http://s/5?q=1"}
