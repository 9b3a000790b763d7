"""Content-addressed text output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_texts(texts: DataFrame) -> DataFrame:
    """One row per content hash, the one with the least page_id; empty text goes.

    An aggregate with a map-side part: copies of one text, however many,
    leave each task as a single row.
    """
    rows = texts.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    others = [c for c in texts.columns if c not in ("content_hash", "page_id")]
    return (
        rows.groupBy("content_hash")
        .agg(F.min(F.struct("page_id", *others)).alias("r"))
        .select("r.page_id", "content_hash", *[f"r.{c}" for c in others])
        .select(*texts.columns)
    )


def write_texts(texts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write unique texts, in folders by the first two digits of the hash."""
    out = unique_texts(texts).withColumn("prefix", F.substring("content_hash", 1, 2))
    out.hint("rebalance", "prefix").write.mode(mode).partitionBy("prefix").parquet(path)
