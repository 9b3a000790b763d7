"""Links of pages: extraction, same-domain filter, and what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import absolute_url, canonical_url, clean_href, has_valid_host, netloc, skips_href
from .nodes import is_element


def extract_links(nodes: DataFrame, mode: str = "reference") -> DataFrame:
    """links(page_id, url, pos, href, link_url), every `a[href]` anywhere on the page.

    `pos` is the anchor's place in document order.  Page URL and anchor share
    a row already, so this is a map: no shuffle.
    """
    anchors = nodes.filter(is_element("a") & F.col("attrs")["href"].isNotNull()).select(
        "page_id", "url", F.col("id").alias("pos"), _once(clean_href(F.col("attrs"))).alias("href")
    )
    return (
        anchors.filter(~skips_href(F.col("href")))
        .select("*", _once(absolute_url(F.col("url"), F.col("href"), mode)).alias("absolute"))
        .filter(has_valid_host(F.col("absolute")))
        .select("page_id", "url", "pos", "href", _once(canonical_url(F.col("absolute"))).alias("link_url"))
    )


def _once(value: Column) -> Column:
    """`value` as the one row of a generator, beneath which no filter on it moves to compute it again."""
    return F.explode(F.array(value))


def same_domain(links: DataFrame) -> DataFrame:
    """Links to exactly the page's own host, port and case included."""
    return links.filter(netloc(F.col("link_url")) == netloc(F.col("url")))


def first_mentions(links: DataFrame, *order: str) -> DataFrame:
    """Each link URL once, at its first place in `order`.

    Partial aggregation runs before the shuffle, so a URL that a third of all
    pages link to still leaves each task as one row.
    """
    order = order or ("page_id", "pos")
    return links.groupBy("link_url").agg(F.min(F.struct(*order)).alias("at")).select("link_url", "at.*")


def new_links(links: DataFrame, visited: DataFrame, queued: DataFrame | None = None, *order: str) -> DataFrame:
    """First mentions of links that are neither visited nor queued (`url` columns)."""
    known = visited.select("url")
    if queued is not None:
        known = known.unionByName(queued.select("url"))
    first = first_mentions(links, *order)
    return first.join(known, first["link_url"] == known["url"], "left_anti")


def link_stats(links: DataFrame, visited: DataFrame, queued: DataFrame | None = None) -> DataFrame:
    """Per page: same-domain links found, and how many of them were newly queued.

    A URL that several pages mention is credited to the first one.  `links`
    is read twice: pass a written table, not a plan that parses pages.
    """
    inside = same_domain(links)
    found = inside.groupBy("page_id").agg(F.count(F.lit(1)).alias("links_found"))
    fresh = new_links(inside, visited, queued).groupBy("page_id").agg(F.count(F.lit(1)).alias("links_queued"))
    return found.join(fresh, "page_id", "left").select(
        "page_id", "links_found", F.coalesce("links_queued", F.lit(0)).cast("long").alias("links_queued")
    )
