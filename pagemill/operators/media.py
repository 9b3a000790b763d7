"""Images, videos and audio in the main content, and where their files go."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.urls import absolute_url, url_parts
from ..options import MEDIA_TYPES
from .nodes import collect_in_spans, is_element, main_priority, main_span

# Media kinds in output order, and the type and option name of each.
_KINDS = {
    "img": ("image", "images"),
    "picture": ("image", "images"),
    "video": ("video", "videos"),
    "audio": ("audio", "audio"),
}
_FOLDERS = {"image": "images", "video": "videos", "audio": "audio"}


def _attr(name: str) -> Column:
    """An attribute, null when missing or empty."""
    return F.nullif(F.col("attrs")[name], F.lit(""))


def _candidate_url(entry: Column) -> Column:
    """The URL of one srcset entry: what stands before its first space."""
    return F.split_part(strip(entry), F.lit(" "), F.lit(1))


def _srcset_urls(srcset: Column) -> Column:
    urls = F.transform(F.split(srcset, ","), _candidate_url)
    return F.coalesce(F.filter(urls, lambda u: u != ""), F.array().cast("array<string>"))


def _own_and_inner(span: Column, inner: Column) -> Column:
    """URLs of one media element: its own first, then those of inner sources."""
    own = F.array_compact(F.array(span["src"]))
    first = F.transform(
        F.filter(inner, lambda s: s["srcset"].isNotNull()),
        lambda s: _candidate_url(F.split_part(s["srcset"], F.lit(","), F.lit(1))),
    )
    sources = F.array_compact(F.transform(inner, lambda s: s["src"]))
    return (
        F.when(span["kind"] == "img", F.concat(own, _srcset_urls(span["srcset"])))
        .when(span["kind"] == "picture", first)
        .otherwise(F.concat(own, sources))
    )


def _media_rows(nodes: DataFrame, kinds: Iterable[str], base: Column | None = None) -> DataFrame:
    """media(page_id, seq, media_type, url) of the given element kinds.

    Main content is chosen on the uncut page.  Elements with inner sources
    are spans over the page's `source` rows, so nested ones need no join.
    """
    kinds = [k for k in _KINDS if k in set(kinds)]
    order = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    is_media = is_element(*kinds)
    rows = (
        nodes.select(
            "page_id",
            F.when(F.col("kind") == "doc", F.col("url")).alias("url"),
            "id",
            "end",
            "kind",
            "tag",
            "attrs",
            is_media.alias("is_media"),
            is_element("source").alias("is_source"),
        )
        .filter(F.col("is_media") | F.col("is_source") | main_priority().isNotNull())
        .withColumn("main", main_span())
        .filter(
            (F.col("id") == 0)
            | (
                (F.col("is_media") | F.col("is_source"))
                & (F.col("id") > F.col("main.id"))
                & (F.col("id") < F.col("main.end"))
            )
        )
    )
    src = F.when(F.col("tag") == "img", F.coalesce(_attr("src"), _attr("data-src"))).otherwise(_attr("src"))

    def span(seq: Column, end: Column, kind: Column, src: Column) -> Column:
        return F.array(
            F.struct(
                seq.cast("long").alias("seq"),
                F.col("id").alias("id"),
                end.alias("end"),
                kind.alias("kind"),
                src.alias("src"),
                _attr("srcset").alias("srcset"),
            )
        )

    # elements of one kind stay in document order
    seq = F.shiftleft(order[F.col("tag")].cast("long"), 40) + F.col("id")
    page_url = span(F.lit(-1), F.col("id"), F.lit("page"), F.col("url"))
    rows = rows.select(
        "page_id",
        "id",
        F.when(F.col("is_source"), F.struct(_attr("src").alias("src"), _attr("srcset").alias("srcset"))).alias("item"),
        F.when(F.col("is_media"), span(seq, F.col("end"), F.col("tag"), src))
        .when(F.col("id") == 0, page_url)
        .alias("spans"),
    ).filter("item is not null or spans is not null")
    types = F.create_map(*[F.lit(x) for k in kinds for x in (k, _KINDS[k][0])])

    def page(items: Column, found: Column) -> dict[str, Column]:
        media = F.transform(
            F.slice(found, 2, F.size(found) - 1),
            lambda f: F.transform(
                _own_and_inner(f["span"], F.slice(items, f["first"], f["size"])),
                lambda u: F.struct(types[f["span"]["kind"]].alias("media_type"), u.alias("src")),
            ),
        )
        # the document's own span comes first and holds the URL
        return {"base": found[0]["span"]["src"], "media": F.flatten(media)}

    media = collect_in_spans(rows, page).select("page_id", "base", F.posexplode("media").alias("seq", "m"))
    against = F.col("base") if base is None else base
    return media.select("page_id", "seq", "m.media_type", absolute_url(against, F.col("m.src")).alias("url"))


def extract_images(nodes: DataFrame) -> DataFrame:
    """`img`: src, or data-src without one, then every srcset entry."""
    return _media_rows(nodes, ["img"])


def extract_picture_sources(nodes: DataFrame) -> DataFrame:
    """`picture`: the first srcset entry of each inner source."""
    return _media_rows(nodes, ["picture"])


def extract_videos(nodes: DataFrame) -> DataFrame:
    return _media_rows(nodes, ["video"])


def extract_audio(nodes: DataFrame) -> DataFrame:
    return _media_rows(nodes, ["audio"])


def extract_media(
    nodes: DataFrame, media_types: Iterable[str] = MEDIA_TYPES, seed_url: str | None = None
) -> DataFrame:
    """All chosen kinds: images, pictures, videos, audio; duplicates stay.

    URLs resolve against the page, or against `seed_url` when one is given.
    """
    wanted = set(media_types)
    kinds = [k for k, (_, option) in _KINDS.items() if option in wanted]
    if not kinds:
        return nodes.sparkSession.createDataFrame([], "page_id long, seq int, media_type string, url string")
    return _media_rows(nodes, kinds, None if seed_url is None else F.lit(seed_url))


def media_counts(media: DataFrame) -> DataFrame:
    """Per page: number of images, videos and audio files."""
    return media.groupBy("page_id").agg(
        *[F.count_if(F.col("media_type") == t).alias(folder) for t, folder in _FOLDERS.items()]
    )


def media_manifest(media: DataFrame) -> DataFrame:
    """manifest(local_path, url): one target file per media name, last one wins.

    A name that fills a third of the table still shrinks to one row per task
    before the shuffle: this is an aggregate, not a window.
    """
    path = url_parts(F.col("url"))["path"]
    # trailing slashes and `.` segments do not count
    name = F.regexp_extract(F.regexp_replace(path, r"(?:/+\.)*/*$", ""), "([^/]*)$", 1)
    folder = F.create_map(*[F.lit(x) for pair in _FOLDERS.items() for x in pair])[F.col("media_type")]
    return (
        media.withColumn("name", name)
        .filter(F.col("name").rlike(r"(?s)^.+\.[^.]+$"))
        .groupBy(F.concat(folder, F.lit("/"), F.col("name")).alias("local_path"))
        .agg(F.max_by("url", F.struct("page_id", "seq")).alias("url"))
    )
