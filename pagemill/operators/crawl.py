"""Breadth-first closure over stored pages.

Tables that grow with the crawl are never broadcast: a level or the visited set
may look small enough for it at every level, and each broadcast passes through
the driver. Their joins are merge joins by hint, or hash joins of a level's parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, netloc, request_path, root_url
from ..session import cut_lineage, remove_folder, work_folder
from .links import extract_links, same_domain
from .parse import parse_html

# A level's table, its rank null without a limit; and all levels, whose folders name their depth.
_LEVEL = "url string, rank long"
_VISITED = "url string, depth int"


def seeds_frame(spark: SparkSession, seeds: Iterable[str] | DataFrame) -> DataFrame:
    """seeds(url, seq): URLs as first requested, in queue order."""
    if isinstance(seeds, DataFrame):
        given = seeds
    else:
        # as an Arrow table, whose size the planner knows: few hosts are broadcast at once, and no markup is shuffled by host
        urls = list(seeds)
        given = spark.createDataFrame(
            pa.table({"seq": pa.array(range(len(urls)), pa.int64()), "url": pa.array(urls, pa.string())})
        )
    url = F.concat(root_url(F.col("url")), request_path(F.col("url")))
    return given.select("seq", url.alias("url")).groupBy("url").agg(F.min("seq").alias("seq"))


def crawl_limit(frontier: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first `n` rows of a frontier in queue order, with their `rank`; None and 0 mean all, unranked.

    Whatever `n`, no task sees more than its range: rows are range-partitioned
    by the order, each range is counted, and a row's rank is its range's
    offset plus its place inside the range.
    """
    if not n:
        return frontier
    return ranked(frontier, *order).filter(F.col("rank") <= n)


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """Add `rank`, 1.. in the given order, without a single-task sort."""
    placed = cut_lineage(
        df.repartitionByRange(*order).withColumn("range_id", F.spark_partition_id())
    )
    # one row per range: bounded by the number of shuffle partitions
    sizes = placed.groupBy("range_id").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range_id", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("range_id").orderBy(*order))
    return (
        placed.join(F.broadcast(offsets), "range_id")
        .withColumn("rank", F.col("offset") + place)
        .drop("offset", "range_id")
    )


def page_edges(pages: DataFrame, seeds: DataFrame, mode: str = "reference") -> DataFrame:
    """edges(src, dst, pos) between canonical URLs of the seeds' hosts.

    Same-domain links never leave a host, so only pages of seed hosts are
    parsed.  When several stored pages share a URL the one with the least
    page_id counts; that choice is made on narrow rows, never on markup.
    """
    hosts = seeds.select(netloc(F.col("url")).alias("host")).distinct()
    inside = pages.join(hosts, netloc(pages["url"]) == hosts["host"], "left_semi")
    src = canonical_url(F.col("url")).alias("src")
    chosen = inside.select(src, "page_id").groupBy("src").agg(F.min("page_id").alias("page_id"))
    links = same_domain(extract_links(parse_html(inside), mode))
    edges = (
        links.groupBy("page_id", F.col("link_url").alias("dst")).agg(F.min("pos").alias("pos"))
    )
    return edges.join(chosen.hint("merge"), "page_id").select("src", "dst", "pos")


@contextmanager
def _bucketed_edges(edges: DataFrame) -> Iterator[DataFrame]:
    """The edges as a table (src, links) bucketed by `src` in the shared work folder.

    Every level joins on `src`; buckets spare a shuffle of all edges per level,
    and a level reads one row for each page with links, not one for each link.
    """
    spark = edges.sparkSession
    name = f"pagemill_edges_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = F.collect_list(F.struct("dst", "pos")).alias("links")  # of one page: no longer than its markup
    writer = edges.repartition(buckets, "src").groupBy("src").agg(links).write.bucketBy(buckets, "src").sortBy("src")
    folder = work_folder(spark, "edges")
    writer.option("path", folder).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")  # leaves the files of a table with a path
        remove_folder(spark, folder)


@contextmanager
def _levels(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables of the levels."""
    folder = work_folder(spark, "levels")
    try:
        yield folder
    finally:
        remove_folder(spark, folder)


def crawl(
    pages: DataFrame,
    seeds: Iterable[str] | DataFrame,
    limit: int | None = None,
    mode: str = "reference",
) -> DataFrame:
    """visited(url, depth, page_id): breadth-first closure from the seeds.

    Each URL is visited once; a URL without a stored page counts as visited
    and has a null page_id.  The links of all pages are extracted once, and
    each level joins narrow (src, dst) rows.

    With a limit, a row carries its rank inside its level. The rank of the
    page a link stands on and the link's position give queue order in the next
    level, so the limit is exact and a row has the same width at any depth.
    """
    spark = pages.sparkSession
    start = seeds_frame(spark, seeds)
    ordered = bool(limit)
    level = start.select("url", *(["seq"] if ordered else []))
    level = crawl_limit(level, limit, "seq")
    left = limit if ordered else None
    depth = 0
    with _bucketed_edges(page_edges(pages, start, mode)) as edges, _levels(spark) as folder:
        while True:
            # levels are columns on disk: every later level reads the URLs of all before
            level.select("url", *(["rank"] if ordered else [])).write.parquet(f"{folder}/depth={depth}")
            level = spark.read.schema(_LEVEL).parquet(f"{folder}/depth={depth}")
            visited = spark.read.schema(_VISITED).parquet(folder)
            count = level.count()
            if ordered:
                left -= count
            if not count or left == 0:
                break
            depth += 1
            level = crawl_limit(_next_level(level, edges, visited, depth, ordered), left, "parent", "pos")
        visited = cut_lineage(visited)
    stored = (
        pages.select(canonical_url(F.col("url")).alias("key"), "page_id")
        .groupBy("key")
        .agg(F.min("page_id").alias("page_id"))
    )
    # the key is a column: a join on an expression computes it at every comparison of its sort
    keyed = visited.withColumn("key", canonical_url(F.col("url")))
    return keyed.join(stored.hint("merge"), "key", "left").select("url", "depth", "page_id")


def _next_level(
    level: DataFrame, edges: DataFrame, visited: DataFrame, depth: int, ordered: bool
) -> DataFrame:
    """URLs one step beyond `level` that were not visited yet; ordered ones with the least (parent, pos)."""
    came = level.select(canonical_url(F.col("url")).alias("src"), *(["rank"] if ordered else []))
    # the edges lie in their buckets: no exchange and, as only the level is hashed, no sort of them at any level
    found = came.hint("shuffle_hash").join(edges, "src").withColumn("link", F.explode("links"))
    found = found.withColumns({"url": F.col("link.dst"), "pos": F.col("link.pos")})
    # one row per URL: hot targets shrink inside each task, and URLs that were visited meet theirs in the same exchange
    new, known = F.lit(True).alias("new"), F.lit(False).alias("new")
    if ordered:
        step = F.struct(F.col("rank").alias("parent"), "pos").alias("step")
        found, seen = found.select("url", new, step), visited.select("url", known, F.lit(None).alias("step"))
    else:
        found, seen = found.select("url", new), visited.select("url", known)
    least = [F.min("new").alias("new"), *([F.min("step").alias("place")] if ordered else [])]
    fresh = found.unionByName(seen).groupBy("url").agg(*least).filter("new")
    return fresh.select("url", *(["place.*"] if ordered else []), F.lit(depth).alias("depth"))


def crawl_summary(visited: DataFrame) -> DataFrame:
    """Pages processed by depth, and in total where depth is null."""
    return visited.rollup("depth").agg(F.count(F.lit(1)).alias("pages"))
