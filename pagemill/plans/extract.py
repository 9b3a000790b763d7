"""The batch job: pages in; texts, links and media out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import canonical_url
from ..operators.crawl import crawl, seeds_frame
from ..operators.links import extract_links
from ..operators.media import extract_media, media_manifest
from ..operators.page_text import texts_of_nodes
from ..operators.parse import parse_errors, parse_pages, without_errors
from ..operators.quality import heuristic_filter, semantic_filter
from ..options import ExtractOptions
from ..session import remove_folder, work_folder
from ..sources.pages import admit, read_pages
from ..sources.sinks import write_texts


def paragraph_filter(options: ExtractOptions, model_factory: Callable | None):
    """The quality filter the options ask for; heuristics alone without a model."""
    if not options.enable_quality_filter:
        return None
    if options.use_semantic_quality and model_factory is not None:
        return semantic_filter(options.quality_threshold, model_factory)
    return heuristic_filter(options.quality_threshold)


@contextmanager
def parsed(pages: DataFrame) -> Iterator[DataFrame]:
    """Rows of `parse_pages`, written once to the shared work folder and deleted at the end.

    Text, links and media all read them back; a lost executor costs a
    re-read, not another parse.
    """
    spark = pages.sparkSession
    folder = work_folder(spark, "nodes")
    try:
        parse_pages(pages).write.parquet(folder)
        yield spark.read.parquet(folder)
    finally:
        remove_folder(spark, folder)


def run_extract(
    spark: SparkSession,
    source: str | DataFrame,
    out: str,
    options: ExtractOptions = ExtractOptions(),
    seeds: list[str] | DataFrame | None = None,
    model_factory: Callable | None = None,
    fmt: str = "parquet",
    mode: str = "overwrite",
) -> dict[str, DataFrame]:
    """Run the job and return the written tables: texts, links, media, manifest.

    A page that cannot be parsed gives nothing but a row (page_id, url, reason)
    of the table `out`/errors, which is always written.

    With seeds only the pages they reach count: the closure when `crawl` is
    on, the seed pages themselves otherwise.
    """
    pages = source if isinstance(source, DataFrame) else read_pages(spark, source, fmt)
    if "content_type" in pages.columns:
        pages = admit(pages)
    if seeds is not None:
        if options.crawl:
            reached = crawl(pages, seeds, options.crawl_limit, options.link_mode)
        else:
            stored = pages.select(canonical_url(F.col("url")).alias("key"), "page_id")
            start = seeds_frame(spark, seeds).select(canonical_url(F.col("url")).alias("key"))
            reached = stored.join(start, "key", "left_semi").groupBy("key").agg(F.min("page_id").alias("page_id"))
        ids = reached.select("page_id").filter("page_id is not null").distinct()
        pages = pages.join(ids, "page_id", "left_semi")
    with parsed(pages) as rows:
        nodes = without_errors(rows)
        parse_errors(rows).write.mode(mode).parquet(f"{out}/errors")
        texts = texts_of_nodes(nodes, nodes, options, paragraph_filter(options, model_factory))
        write_texts(texts, f"{out}/texts", mode)
        names = ["texts"]
        if options.crawl:
            extract_links(nodes, options.link_mode).write.mode(mode).parquet(f"{out}/links")
            names.append("links")
        types = options.effective_media_types()
        if types:
            extract_media(nodes, types, options.media_base).write.mode(mode).parquet(f"{out}/media")
            media = spark.read.parquet(f"{out}/media")
            media_manifest(media).write.mode(mode).parquet(f"{out}/manifest")
            names += ["media", "manifest"]
    return {n: spark.read.parquet(f"{out}/{n}") for n in names}
