import os

import pytest
from pages import nodes_of, page_frame
from pyspark.sql import functions as F

from pagemill.operators.page_text import extract_page_text
from pagemill.options import ExtractOptions
from pagemill.plans.extract import run_extract
from pagemill.session import checkpoint_root
from pagemill.sources.pages import admit, classify_content, read_pages
from pagemill.sources.sinks import unique_texts, write_texts
from pagemill.streaming.incremental import process_batch, stream_extract

TYPES = {
    "text/html; charset=utf-8": "html", "application/XHTML+xml": "html", "application/atom+xml; charset=utf-8": "xml",
    "application/rss+xml": "xml", "application/json": "skip", "": "skip", None: "skip",
}


def test_content_kinds(spark):
    df = spark.createDataFrame([(t,) for t in TYPES], "content_type string")
    assert {r.content_type: r.content_kind for r in classify_content(df).collect()} == TYPES
    assert admit(df).count() == 4


def test_read_html_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.html").write_text("<p>ä</p>", encoding="utf-8")
    row = read_pages(spark, str(tmp_path), "html").first()
    assert row.html == "<p>ä</p>" and row.url.endswith("/sub/a.html")
    with pytest.raises(ValueError):
        read_pages(spark, str(tmp_path), "csv")


def test_unique_texts_and_folders(spark, tmp_path):
    html = ["<p>same</p>"] * 50 + ["<p>other</p>", "<p></p>"]
    texts = extract_page_text(page_frame(spark, *html))
    assert {(r.page_id, r.text) for r in unique_texts(texts).collect()} == {(0, "same"), (50, "other")}
    write_texts(texts, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 2 and back.select("content_hash").distinct().count() == 2
    assert all(d.startswith("prefix=") for d in os.listdir(tmp_path / "t") if not d.startswith(("_", ".")))


SITE = [
    (0, "http://s/0", "<main>Zero<a href='/1'>n</a><img src='/i.png'></main>", "text/html"),
    (1, "http://s/1", "<main>One<a href='/2'>n</a></main>", "text/html"),
    (2, "http://s/2", "<rss><item><title>Two</title></item></rss>", "application/rss+xml"),
    (3, "http://s/3", "<main>Three</main>", "text/html"),
    (4, "http://s/4", "{}", "application/json"),
]


def site(spark):
    return spark.createDataFrame(SITE, "page_id long, url string, html string, content_type string")


def test_job(spark, tmp_path):
    out = run_extract(spark, site(spark), str(tmp_path / "all"))
    assert {r.page_id: r.text for r in out["texts"].collect()} == {0: "Zero\nn", 1: "One\nn", 2: "Two", 3: "Three"}
    assert [r.local_path for r in out["manifest"].collect()] == ["images/i.png"]
    assert "links" not in out
    based = run_extract(spark, site(spark), str(tmp_path / "based"), ExtractOptions(media_base="http://seed/d/p"))
    assert [r.url for r in based["media"].collect()] == ["http://seed/i.png"]


def test_job_with_crawl_and_text_only(spark, tmp_path):
    options = ExtractOptions(crawl=True, text_only=True, media_types=("images",))
    out = run_extract(spark, site(spark), str(tmp_path / "c"), options, seeds=["http://s/0"])
    assert {r.page_id for r in out["texts"].collect()} == {0, 1, 2}
    assert set(out) == {"texts", "links"} and out["links"].count() == 2
    limited = ExtractOptions(crawl=True, crawl_limit=2)
    out = run_extract(spark, site(spark), str(tmp_path / "l"), limited, seeds=["http://s/0"])
    assert {r.page_id for r in out["texts"].collect()} == {0, 1}
    out = run_extract(spark, site(spark), str(tmp_path / "s"), seeds=["http://s/3"])
    assert {r.page_id for r in out["texts"].collect()} == {3}


def test_job_writes_the_pages_that_failed(spark, tmp_path):
    run_extract(spark, site(spark), str(tmp_path / "e"))
    errors = spark.read.parquet(str(tmp_path / "e" / "errors"))
    assert errors.columns == ["page_id", "url", "reason"] and errors.count() == 0


def test_job_with_quality_filter(spark, tmp_path):
    good = "Researchers found that 35% of adults in New York City may show it. Evidence suggests, according to the study, more is there."
    pages = page_frame(spark, f"<main>{good}</main>", "<main>Top 10</main>")
    options = ExtractOptions(enable_quality_filter=True, quality_threshold=0.5)
    out = run_extract(spark, pages, str(tmp_path / "q"), options)
    assert [r.text for r in out["texts"].collect()] == [good]


def test_options():
    assert ExtractOptions(text_only=True, media_types=("images",)).effective_media_types() == ()
    assert ExtractOptions(media_types=(" Images ", "AUDIO")).effective_media_types() == ("images", "audio")
    assert ExtractOptions() == ExtractOptions(("images", "videos", "audio"), False, False, False, None, False, 0.6, True, "reference", None)


def test_stream_handles_each_url_and_text_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame(list(rows), "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(source)
        stream_extract(spark, source, out).awaitTermination()
        return {r.text for r in spark.read.parquet(f"{out}/texts").collect()}

    assert arrive((0, "http://a", "<p>one</p>"), (1, "http://b", "<p>one</p>"), (2, "http://a", "<p>late</p>")) == {"one"}
    assert arrive((3, "http://a", "<p>changed</p>"), (4, "http://c", "<p>one</p>"), (5, "http://d", "<p>two</p>")) == {"one", "two"}
    assert spark.read.parquet(f"{out}/texts").count() == 2
    assert spark.read.parquet(f"{out}/urls").count() == 4
    assert arrive((6, "http://d#top", "<p>fragment</p>")) == {"one", "two"}  # the same canonical URL
    assert spark.read.parquet(f"{out}/urls").count() == 4 and not os.path.exists(f"{out}/_staged")
    # a batch that runs again writes the same rows
    again = spark.createDataFrame([(5, "http://d", "<p>two</p>"), (4, "http://c", "<p>one</p>")], "page_id long, url string, html string")
    process_batch(again, 1, out, ExtractOptions(), None)
    assert spark.read.parquet(f"{out}/texts").count() == 2 and spark.read.parquet(f"{out}/urls").count() == 4


def test_job_and_crawl_leave_no_intermediate_tables(spark, tmp_path):
    root = checkpoint_root(spark).removeprefix("file:")
    held = lambda: {d for d in (os.listdir(root) if os.path.isdir(root) else []) if d.startswith(("nodes-", "edges-"))}
    before = held()
    run_extract(spark, site(spark), str(tmp_path / "o"), ExtractOptions(crawl=True, crawl_limit=3), seeds=["http://s/0"])
    assert held() == before


def test_checkpoint_folder_of_the_session_is_used(spark):
    assert checkpoint_root(spark) == checkpoint_root(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def test_plain_text_plan_has_one_node_exchange(spark):
    from pagemill.operators.page_text import _main_rows, _plain_text, _text_rows, clean_text

    plan = _plain_text(_main_rows(_text_rows(nodes_of(spark, "<p>x</p>"), False)), clean_text)
    tree = plan._jdf.queryExecution().executedPlan().toString()
    assert tree.count("Exchange hashpartitioning") == 1 and tree.count("MapInArrow") == 1
    assert "attrs" not in tree.split("Exchange hashpartitioning")[0]


def test_scan_reads_only_the_columns_of_the_parser(spark):
    pages = read_pages(spark, "/root/testdata/sf0.001/pages.parquet").select("page_id", "url", F.lit("").alias("html"))
    assert "html" not in extract_page_text(pages)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1][:80]
