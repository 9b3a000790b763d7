"""Registered queries: one per operator, each over the whole given tables.

The tables hold no navigation roles, media, feeds or crawlable links, so many
queries first rewrite every page with an SQL expression of the page's own
columns; `oracles.py` states what must come out of the same rewrite.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions.text import content_filename, content_hash, normalize_whitespace, remove_urls
from ..functions.urls import absolute_url, canonical_url, request_path, root_url, url_parts
from ..functions.vectors import cosine_similarity, mean_pool
from ..operators import crawl as C
from ..operators import links as L
from ..operators import media as M
from ..operators import nodes as N
from ..operators.clean_html import clean_html
from ..operators.embed import embed_documents, similar_pairs
from ..operators.feeds import extract_feed_text, feed_items
from ..operators.page_text import drop_empty, extract_page_text
from ..operators.parse import parse_feed, parse_html
from ..operators.quality import filter_paragraphs, filter_report, quality_score_enhanced, semantic_quality
from ..options import ExtractOptions
from ..session import cut_lineage, work_folder
from ..sources.pages import admit, read_pages
from ..sources.sinks import write_texts
from ..streaming.incremental import stream_extract
from . import extract, rewrites

Query = Callable[[SparkSession, str], DataFrame]


def pages(spark: SparkSession, sf: str, html: str | None = None, url: str | None = None) -> DataFrame:
    df = read_pages(spark, f"{sf}/pages.parquet")
    if html:
        df = df.withColumn("html", F.expr(html))
    if url:
        df = df.withColumn("url", F.expr(url))
    return df


def documents(spark: SparkSession, sf: str, text: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return df.withColumn("text", F.expr(text)) if text else df


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """One mean vector per label."""
    parts = embeddings(spark, sf).select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(N.in_order("x", "i").alias("embedding"))


def tag_counts(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'elem'").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def rounded(col: Column) -> Column:
    return F.round(col, 6)


# --- sources and sinks --------------------------------------------------
def s1_read_pages(spark, sf):
    return pages(spark, sf).select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


def s2_classify_content(spark, sf):
    df = pages(spark, sf).withColumn("content_type", F.expr(rewrites.CONTENT_TYPE))
    return admit(df).select("page_id", "content_kind")


def s3_write_texts(spark, sf):
    df = pages(spark, sf)
    twice = df.unionByName(df.withColumn("page_id", F.col("page_id") + 1_000_000_000))
    out = work_folder(spark, "texts")
    write_texts(extract_page_text(twice), out)
    return spark.read.parquet(out).select("page_id", "content_hash", "filename", "text")


def s4_media_manifest(spark, sf):
    return M.media_manifest(M.extract_media(parse_html(pages(spark, sf, rewrites.WITH_MEDIA))))


def s5_clean_html(spark, sf):
    df = clean_html(parse_html(pages(spark, sf)))
    return df.select("page_id", F.regexp_replace("cleaned_html", "</[a-z0-9]+>", "").alias("opened"))


def s6_stream_extract(spark, sf):
    out = work_folder(spark, "stream")
    stream_extract(spark, f"{sf}/pages*.parquet", out).awaitTermination()
    return spark.read.parquet(f"{out}/texts").select("page_id", "content_hash", "text")


# --- markup to rows -----------------------------------------------------
def p1_parse_html(spark, sf):
    return tag_counts(parse_html(pages(spark, sf)))


def p2_parse_feed(spark, sf):
    df = pages(spark, sf, rewrites.AS_FEED).withColumn("content_kind", F.lit("xml"))
    return tag_counts(parse_feed(df))


def p3_feed_items(spark, sf):
    items = feed_items(parse_html(pages(spark, sf, rewrites.AS_FEED)))
    place = F.dense_rank().over(N.page_window().orderBy("item_id")).cast("long")
    return items.select("page_id", place.alias("item_no"), "field", "text")


# --- node filters and text ----------------------------------------------
def f1_drop_excluded_elements(spark, sf):
    return tag_counts(N.drop_excluded_elements(parse_html(pages(spark, sf))))


def f2_drop_by_role(spark, sf):
    return tag_counts(N.drop_by_role(parse_html(pages(spark, sf, rewrites.WITH_ROLES))))


def f3_drop_by_class_id(spark, sf):
    return tag_counts(N.drop_by_class_id(parse_html(pages(spark, sf, rewrites.WITH_CLASSES))))


def f4_select_main_content(spark, sf):
    nodes = N.select_main_content(parse_html(pages(spark, sf, rewrites.WITH_MAIN)))
    return N.extract_text(nodes)


def f5_flatten_links(spark, sf):
    return N.extract_text(N.flatten_links(N.select_main_content(parse_html(pages(spark, sf, rewrites.WITH_LINKS)))))


def f6_extract_text(spark, sf):
    return N.extract_text(parse_html(pages(spark, sf)))


def f7_extract_structured_text(spark, sf):
    nodes = parse_html(pages(spark, sf, rewrites.WITH_BLOCKS))
    return N.extract_structured_text(N.select_main_content(nodes))


def f8_is_feed(spark, sf):
    return N.is_feed(parse_html(pages(spark, sf, rewrites.SOME_FEEDS)))


def f9_extract_feed_text(spark, sf):
    return extract_feed_text(parse_html(pages(spark, sf, rewrites.AS_FEED))).select("page_id", "text")


def f10_normalize_whitespace(spark, sf):
    df = documents(spark, sf, rewrites.WITH_GAPS)
    return df.select("doc_id", normalize_whitespace(F.col("text")).alias("text"))


def f11_remove_urls(spark, sf):
    df = documents(spark, sf, rewrites.WITH_URLS)
    return df.select("doc_id", remove_urls(F.col("text")).alias("text"))


def f12_drop_empty(spark, sf):
    given = documents(spark, sf)
    blank = given.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(" \n  ").alias("text"))
    df = given.union(blank)
    return drop_empty(df.withColumn("text", normalize_whitespace(F.col("text")))).select("doc_id")


def f13_content_filename(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        content_hash(F.col("text")).alias("content_hash"),
        content_filename(F.col("text")).alias("filename"),
    )


def f14_extract_page_text(spark, sf):
    return extract_page_text(pages(spark, sf, rewrites.WITH_ALL)).select(
        "page_id", "url", "text", "content_hash", "filename"
    )


# --- URLs ---------------------------------------------------------------
def u1_url_parts(spark, sf):
    df = pages(spark, sf, url=rewrites.URL_VARIANTS)
    parts = df.select("page_id", url_parts(F.col("url")).alias("p")).select("page_id", "p.*")
    return parts.withColumn("port", F.col("port").cast("long"))


def u2_absolute_url(spark, sf):
    df = pages(spark, sf).select("page_id", "url", F.explode(F.expr(rewrites.HREFS)).alias("href"))
    return df.select("page_id", "href", absolute_url(F.col("url"), F.col("href")).alias("absolute"))


def u3_canonical_url(spark, sf):
    df = pages(spark, sf, url=rewrites.URL_VARIANTS)
    return df.select("page_id", canonical_url(F.col("url")).alias("canonical"))


def u4_request_path(spark, sf):
    df = pages(spark, sf, url=rewrites.URL_QUERIES)
    return df.select(
        "page_id",
        request_path(F.col("url")).alias("full_path"),
        request_path(F.col("url"), path_only=True).alias("bare_path"),
    )


def u5_root_url(spark, sf):
    return pages(spark, sf).select("page_id", root_url(F.col("url")).alias("root"))


# --- links and crawl ----------------------------------------------------
def _links(spark, sf):
    return L.extract_links(parse_html(pages(spark, sf, rewrites.MORE_LINKS)))


def _written_links(spark, sf):
    """Links as a written table: queries that read them twice parse once."""
    return cut_lineage(_links(spark, sf))


def l1_extract_links(spark, sf):
    place = F.row_number().over(N.page_window().orderBy("pos")).cast("long")
    return _links(spark, sf).select("page_id", place.alias("n"), "href", "link_url")


def l2_same_domain(spark, sf):
    return L.same_domain(_links(spark, sf)).select("page_id", "href", "link_url")


def _known(links: DataFrame, rest: int) -> DataFrame:
    return links.filter(F.length("link_url") % 3 == rest).select(F.col("link_url").alias("url")).distinct()


def l3_new_links(spark, sf):
    links = L.same_domain(_written_links(spark, sf))
    return L.new_links(links, _known(links, 0), _known(links, 1)).select("page_id", "link_url")


def l4_link_stats(spark, sf):
    links = _written_links(spark, sf)
    return L.link_stats(links, _known(links, 0))


def _crawl(spark, sf, limit=None):
    site = pages(spark, sf, rewrites.SITE_HTML, rewrites.SITE_URL)
    return C.crawl(site, rewrites.SITE_SEEDS, limit)


def l5_crawl(spark, sf):
    return _crawl(spark, sf).select("url", F.col("depth").cast("long").alias("depth"), "page_id")


def l6_crawl_limit(spark, sf):
    limit = pages(spark, sf).count() // 5
    return _crawl(spark, sf, limit).select("url", F.col("depth").cast("long").alias("depth"))


def l7_crawl_summary(spark, sf):
    return C.crawl_summary(_crawl(spark, sf)).select(F.col("depth").cast("long").alias("depth"), "pages")


# --- media --------------------------------------------------------------
def _media(spark, sf, extract_kind):
    media = extract_kind(parse_html(pages(spark, sf, rewrites.WITH_MEDIA)))
    return media.select("page_id", F.col("seq").cast("long").alias("seq"), "media_type", "url")


def m1_extract_images(spark, sf):
    return _media(spark, sf, M.extract_images)


def m2_extract_picture_sources(spark, sf):
    return _media(spark, sf, M.extract_picture_sources)


def m3_extract_videos(spark, sf):
    return _media(spark, sf, M.extract_videos)


def m4_extract_audio(spark, sf):
    return _media(spark, sf, M.extract_audio)


def m5_extract_media(spark, sf):
    return _media(spark, sf, M.extract_media)


def m6_media_counts(spark, sf):
    return M.media_counts(M.extract_media(parse_html(pages(spark, sf, rewrites.WITH_MEDIA))))


# --- quality ------------------------------------------------------------
def _signal(function: Callable[[Column], Column], name: str, text: str | None = None) -> Query:
    def query(spark, sf):
        return documents(spark, sf, text).select("doc_id", rounded(function(F.col("text"))).alias(name))

    return query


q1_sentence_complexity = _signal(Q.sentence_complexity, "sentence_complexity")
q2_vocabulary_richness = _signal(Q.vocabulary_richness, "vocabulary_richness")
q3_information_density = _signal(Q.information_density, "information_density", rewrites.WITH_FACTS)
q4_research_indicators = _signal(Q.research_indicators, "research_indicators", rewrites.WITH_RESEARCH)
q5_noise_penalty = _signal(Q.noise_penalty, "noise_penalty", rewrites.WITH_NOISE)


def q6_quality_score(spark, sf):
    df = documents(spark, sf, rewrites.WITH_RESEARCH)
    scored = df.select("doc_id", Q.quality_score(F.col("text")).alias("q")).select("doc_id", "q.*")
    return scored.select("doc_id", *[rounded(F.col(c)).alias(c) for c in ["score", *Q.WEIGHTS]])


def q7_is_quality(spark, sf):
    df = documents(spark, sf, rewrites.WITH_RESEARCH)
    return df.select("doc_id", Q.is_quality(F.col("text")).alias("is_quality"))


def q8_filter_paragraphs(spark, sf):
    return filter_paragraphs(documents(spark, sf, rewrites.AS_PARAGRAPHS), 0.3)


def q9_filter_report(spark, sf):
    report = filter_report(documents(spark, sf, rewrites.AS_PARAGRAPHS), 0.3)
    return report.select(
        "doc_id",
        F.col("chars_before").cast("long").alias("chars_before"),
        F.col("chars_kept").cast("long").alias("chars_kept"),
        rounded(F.col("share_kept")).alias("share_kept"),
        "emptied",
    )


def q10_semantic_quality(spark, sf):
    scored = semantic_quality(embeddings(spark, sf), centroids(spark, sf))
    return scored.select("vec_id", rounded(F.col("semantic_quality")).alias("semantic_quality"))


def q11_quality_score_enhanced(spark, sf):
    texts = documents(spark, sf, rewrites.WITH_RESEARCH)
    vectors = semantic_quality(embeddings(spark, sf), centroids(spark, sf))
    both = texts.join(vectors.select(F.col("vec_id").alias("doc_id"), "semantic_quality"), "doc_id", "left")
    parts = ["score", "semantic_quality", *Q.WEIGHTS]
    return quality_score_enhanced(both).select("doc_id", *[rounded(F.col(c)).alias(c) for c in parts])


# --- embeddings ---------------------------------------------------------
def e1_mean_pool(spark, sf):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i <= F.col("vec_id") % 8, 1).otherwise(0)
    )
    pooled = embeddings(spark, sf).select("vec_id", mean_pool(tokens, mask).alias("v"))
    return pooled.select("vec_id", F.posexplode("v").alias("i", "x")).select(
        "vec_id", F.col("i").cast("long").alias("i"), rounded(F.col("x")).alias("x")
    )


def e2_cosine_similarity(spark, sf):
    means = centroids(spark, sf).withColumnRenamed("embedding", "mean")
    both = embeddings(spark, sf).join(means, "label")
    return both.select("vec_id", rounded(cosine_similarity(F.col("embedding"), F.col("mean"))).alias("similarity"))


def e3_embed_documents(spark, sf):
    vectors = embed_documents(documents(spark, sf), dimensions=64)
    parts = vectors.select("doc_id", F.posexplode("embedding").alias("i", "x"))
    return parts.select("doc_id", F.col("i").cast("long").alias("i"), rounded(F.col("x")).alias("x"))


def e4_similar_pairs(spark, sf):
    vectors = embeddings(spark, sf)
    partners = F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") * 2, F.col("vec_id")))
    pairs = similar_pairs(vectors.select(F.col("vec_id").alias("left_id"), partners.alias("right_id")), vectors)
    return pairs.select("left_id", "right_id", rounded(F.col("similarity")).alias("similarity"))


# --- job ----------------------------------------------------------------
def j1_run_extract(spark, sf):
    out = work_folder(spark, "job")
    tables = extract.run_extract(spark, pages(spark, sf, rewrites.WITH_ALL), out, ExtractOptions())
    return tables["texts"].select("page_id", "url", "content_hash", "filename", "text")


NAMES = [
    "s1_read_pages", "s2_classify_content", "s3_write_texts", "s4_media_manifest", "s5_clean_html",
    "s6_stream_extract", "p1_parse_html", "p2_parse_feed", "p3_feed_items",
    "f1_drop_excluded_elements", "f2_drop_by_role", "f3_drop_by_class_id", "f4_select_main_content",
    "f5_flatten_links", "f6_extract_text", "f7_extract_structured_text", "f8_is_feed",
    "f9_extract_feed_text", "f10_normalize_whitespace", "f11_remove_urls", "f12_drop_empty",
    "f13_content_filename", "f14_extract_page_text", "u1_url_parts", "u2_absolute_url",
    "u3_canonical_url", "u4_request_path", "u5_root_url", "l1_extract_links", "l2_same_domain",
    "l3_new_links", "l4_link_stats", "l5_crawl", "l6_crawl_limit", "l7_crawl_summary",
    "m1_extract_images", "m2_extract_picture_sources", "m3_extract_videos", "m4_extract_audio",
    "m5_extract_media", "m6_media_counts", "q1_sentence_complexity", "q2_vocabulary_richness",
    "q3_information_density", "q4_research_indicators", "q5_noise_penalty", "q6_quality_score",
    "q7_is_quality", "q8_filter_paragraphs", "q9_filter_report", "q10_semantic_quality",
    "q11_quality_score_enhanced", "e1_mean_pool", "e2_cosine_similarity", "e3_embed_documents",
    "e4_similar_pairs", "j1_run_extract",
]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Text, content name and quality of every page."""
    texts = extract_page_text(pages(spark, sf))
    scored = texts.select(
        "page_id", "url", "filename", F.length("text").alias("n_chars"), Q.quality_score(F.col("text")).alias("q")
    )
    return scored.select("page_id", "url", "filename", "n_chars", "q.*")


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in NAMES}
