"""The full page-text job: pages or nodes in, one named text per page out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_filename, content_hash, normalize_whitespace, remove_urls
from ..options import ExtractOptions
from . import nodes as N
from .feeds import extract_feed_text
from .parse import parse_html

# raw-markup test that no feed page can fail; most pages skip the feed branch by it
_MAYBE_FEED = r"(?i)<(rss|feed|channel)\b"


def _text_rows(nodes: DataFrame, structured: bool) -> DataFrame:
    """Only what text extraction needs, cut down before the exchange.

    Attribute maps become flags, and elements that neither cut, select nor
    format anything never leave the parsing task.
    """
    rank = N.main_priority()
    rows = nodes.filter(~F.col("feed")).select(
        "page_id",
        F.when(F.col("kind") == "doc", F.col("url")).alias("url"),
        "id",
        "end",
        N.is_element(*N.EXCLUDED_ELEMENTS).alias("excluded"),
        rank.alias("rank"),
        ((F.col("kind") == "elem") & (N.has_excluded_role() | N.has_excluded_class_or_id())).alias("furniture"),
        N.is_element("a").alias("anchor"),
        (F.when(N.is_element(*N.BLOCKS), F.col("tag")) if structured else F.lit(None).cast("string")).alias("block"),
        N.page_string().alias("t"),
    )
    return rows.filter(
        F.col("excluded")
        | F.col("furniture")
        | F.col("anchor")
        | F.col("rank").isNotNull()
        | F.col("block").isNotNull()
        | F.col("t").isNotNull()
    )


def _main_rows(rows: DataFrame) -> DataFrame:
    """Cut excluded elements, choose the main content on what is left, then
    cut page furniture strictly inside it.  The document row stays: it
    carries the URL."""
    end, node = F.col("end"), F.col("id")

    def outside(col: str) -> Column:
        return F.col(col).isNull() | (F.col(col) <= node)

    rows = rows.withColumn("x", F.max(F.when(F.col("excluded"), end)).over(N.so_far())).filter(outside("x"))
    rank = F.when(F.col("rank").isNotNull(), F.struct("rank", "id", "end"))
    rows = rows.withColumn("m", F.min(rank).over(N.page_window())).filter(
        (node == 0) | ((node > F.col("m.id")) & (node < F.col("m.end")))
    )
    inside = node > F.col("m.id")
    return (
        rows.withColumn("c", F.max(F.when(F.col("furniture") & inside, end)).over(N.so_far()))
        .withColumn("a", F.max(F.when(F.col("anchor") & inside, end)).over(N.before()))
        .filter(outside("c"))
        .withColumn("a", F.when(F.col("a") > node, F.col("a")))
    )


def _plain_text(rows: DataFrame, finish: Callable[[Column], Column]) -> DataFrame:
    """One line per string; strings of one link share a line."""
    rows = rows.filter("t is not null or id = 0")
    same_link = F.col("a").eqNullSafe(F.lag("a").over(N.by_id())) & F.col("a").isNotNull()
    piece = F.concat(F.when(same_link, "").otherwise("\n"), F.col("t"))
    return (
        rows.withColumn("piece", piece)
        .groupBy("page_id")
        .agg(F.max("url").alias("url"), finish(F.array_join(N.in_order("piece"), "")).alias("text"))
    )


def _structured_text(rows: DataFrame, finish: Callable[[Column], Column]) -> DataFrame:
    """Headings, paragraphs and bullets; blocks inside a link are part of its string."""
    span = F.struct(F.col("id").alias("seq"), "id", "end", F.col("block").alias("tag"))
    url_row = F.col("id") == 0
    document = F.struct(
        F.lit(-1).alias("seq"),
        F.col("id").alias("id"),
        F.col("id").alias("end"),
        F.coalesce("url", F.lit("")).alias("tag"),
    )
    rows = rows.select(
        "page_id",
        "id",
        F.col("t").alias("item"),
        F.when(url_row, F.array(document))
        .when(F.col("block").isNotNull() & F.col("a").isNull(), F.array(span))
        .alias("spans"),
    ).filter("item is not null or spans is not null")

    def page(items: Column, found: Column) -> dict[str, Column]:
        # the document's own span comes first and holds the URL
        blocks = F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))
        return {"url": found[0]["span"]["tag"], "text": finish(N.join_blocks(items, blocks))}

    return N.collect_in_spans(rows, page)


def drop_empty(df: DataFrame) -> DataFrame:
    """Pages without text leave the output."""
    return df.filter(F.col("text").isNotNull() & (F.col("text") != ""))


def clean_text(text: Column) -> Column:
    return remove_urls(normalize_whitespace(text))


def name_texts(df: DataFrame) -> DataFrame:
    return df.select("*", content_hash(F.col("text")).alias("content_hash"), content_filename(F.col("text")).alias("filename"))


def texts_of_nodes(
    html_nodes: DataFrame,
    feed_nodes: DataFrame,
    options: ExtractOptions = ExtractOptions(),
    paragraph_filter: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Clean, filter and name the texts of HTML pages and feeds.

    Cleaning is part of the aggregate that joins a page's strings: the filter
    on empty text then reads its result, where a projection of its own would
    be repeated inside the filter.
    """
    rows = _main_rows(_text_rows(html_nodes, options.preserve_structure))
    join = _structured_text if options.preserve_structure else _plain_text
    texts = join(rows, clean_text).unionByName(extract_feed_text(feed_nodes, clean_text))
    if paragraph_filter is not None:
        texts = texts.withColumn("text", paragraph_filter(F.col("text")))
    return name_texts(drop_empty(texts))


def maybe_feeds(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("html").rlike(_MAYBE_FEED))


def extract_page_text(
    pages: DataFrame,
    options: ExtractOptions = ExtractOptions(),
    paragraph_filter: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """texts(page_id, url, text, content_hash, filename) of a pages table.

    HTML pages are parsed once.  Pages whose markup may be a feed are parsed
    for the feed branch as well, and each branch keeps only its own kind.  The
    second scan for that raw-markup test costs a few percent of parsing; a
    single pass would sort every page's strings backwards for the few feeds.
    Where nodes are stored anyway, as in the job, both branches read them.
    """
    feeds = maybe_feeds(pages)
    return texts_of_nodes(parse_html(pages), parse_html(feeds), options, paragraph_filter)
