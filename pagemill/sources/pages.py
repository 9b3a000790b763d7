"""Reading pages and telling their kind."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import require_columns


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Fetched pages as rows: page_id, url, html and any further columns.

    `parquet`, `orc` and `json` hold those columns, `html` as text or bytes; `html` is a folder of
    files, one page each, whose path stands for the URL.
    """
    if fmt == "html":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        pages = files.select(
            F.xxhash64("path").alias("page_id"),
            F.col("path").alias("url"),
            F.col("content").alias("html"),
        )
    elif fmt in ("parquet", "orc", "json"):
        pages = spark.read.format(fmt).load(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return as_text(require_columns(pages, "page_id", "url", "html"))


_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def decode_markup(content: bytes, content_type: str | None = None) -> str:
    """Markup bytes as text: byte order mark, stated charset, `meta` charset, else UTF-8; never fails."""
    for mark, name in _MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    for source in ((content_type or "").encode("utf-8", "replace"), content[:1024]):
        found = _CHARSET.search(source)
        if found:
            try:
                return content.decode(found[1].decode("ascii"), "replace")
            except (LookupError, ValueError):
                pass
    return content.decode("utf-8", "replace")


@F.arrow_udf(T.StringType())
def _decoded(content: pa.Array, content_type: pa.Array) -> pa.Array:
    kinds = content_type.to_pylist()
    texts = [None if c is None else decode_markup(c, k) for c, k in zip(content.to_pylist(), kinds)]
    return pa.array([t if t is None else t.encode("utf-8", "replace").decode("utf-8") for t in texts], pa.string())


def as_text(pages: DataFrame) -> DataFrame:
    """`html` as a string; bytes are decoded by their charset."""
    if dict(pages.dtypes)["html"] != "binary":
        return pages
    kind = F.col("content_type") if "content_type" in pages.columns else F.lit(None).cast("string")
    return pages.withColumn("html", _decoded("html", kind))


def classify_content(df: DataFrame) -> DataFrame:
    """Adds `content_kind` from `content_type`: html, xml or skip."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    return df.withColumn(
        "content_kind",
        F.when(kind.contains("text/html") | kind.contains("application/xhtml"), "html")
        .when(kind.contains("xml"), "xml")
        .otherwise("skip"),
    )


def admit(df: DataFrame) -> DataFrame:
    """Drop pages that are neither HTML nor XML, ahead of the parser."""
    return classify_content(df).filter(F.col("content_kind") != "skip")
