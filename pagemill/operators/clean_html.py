"""Minimal HTML with the title and the main content only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nodes as N
from .parse import VOID_ELEMENTS

DEFAULT_TITLE = "Extracted Content"


def _escape(col: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(char), F.lit(name))
    return col


def _attributes(attrs: Column) -> Column:
    def one(e: Column) -> Column:
        value = _escape(e["value"])
        double = value.contains('"')
        single = value.contains("'")
        quoted = (
            F.when(double & single, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"')))
            .when(double, F.concat(F.lit("'"), value, F.lit("'")))
            .otherwise(F.concat(F.lit('"'), value, F.lit('"')))
        )
        return F.concat(F.lit(" "), e["key"], F.lit("="), quoted)

    return F.array_join(F.transform(F.map_entries(attrs), one), "")


def clean_html(nodes: DataFrame) -> DataFrame:
    """(page_id, cleaned_html): excluded elements and `<link>` cut, main content kept.

    A page without any main element keeps everything that was not cut.  Tags
    come back as text at both ends of their interval.
    """
    kept = N.drop_subtrees(nodes, N.is_element(*N.EXCLUDED_ELEMENTS, "link"))
    title = F.min(F.when(N.is_element("title"), F.struct("id", "end"))).over(N.page_window())
    kept = kept.withColumn("main", N.main_span()).withColumn("title", title)
    whole = F.col("main.p") >= len(N.CONTENT_SELECTORS)
    in_main = whole | ((F.col("id") >= F.col("main.id")) & (F.col("id") < F.col("main.end")))
    in_title = (F.col("id") >= F.col("title.id")) & (F.col("id") < F.col("title.end"))
    void = F.col("tag").isin(sorted(VOID_ELEMENTS)) & (F.col("end") == F.col("id") + 1)
    opening = F.concat(
        F.lit("<"), F.col("tag"), _attributes(F.col("attrs")), F.when(void, "/>").otherwise(">")
    )
    text = _escape(F.col("text"))
    markup = (
        F.when(F.col("kind") == "elem", opening)
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), F.col("text"), F.lit("-->")))
        .when(F.col("kind") == "decl", F.col("text"))
        .when(F.col("kind") != "doc", text)
    )
    # at one position inner elements close first, and closing precedes opening
    start = F.struct(F.col("id").alias("pos"), F.lit(1).alias("late"), F.lit(0).alias("rank"), markup.alias("m"))
    stop = F.struct(
        F.col("end").alias("pos"),
        F.lit(0).alias("late"),
        (-F.col("id")).alias("rank"),
        F.concat(F.lit("</"), F.col("tag"), F.lit(">")).alias("m"),
    )
    closes = (F.col("kind") == "elem") & ~void
    events = F.when(in_main, F.when(closes, F.array(start, stop)).otherwise(F.array(start)))
    parts = kept.select(
        "page_id",
        "id",
        whole.alias("whole"),
        events.alias("events"),
        F.when(in_title & (F.col("kind") == "text"), text).alias("title_text"),
        (in_title & (F.col("kind") == "elem")).alias("titled"),
    )
    body = F.array_join(
        F.transform(F.sort_array(F.flatten(F.collect_list("events"))), lambda e: e["m"]), ""
    )
    head = F.when(F.col("titled"), F.col("title_text")).otherwise(DEFAULT_TITLE)
    return (
        parts.groupBy("page_id")
        .agg(
            F.first("whole").alias("whole"),
            F.bool_or(F.coalesce("titled", F.lit(False))).alias("titled"),
            F.array_join(N.in_order("title_text"), "").alias("title_text"),
            body.alias("body"),
        )
        .select(
            "page_id",
            F.when(F.col("whole"), F.col("body"))
            .otherwise(
                F.concat(
                    F.lit("<html><head><title>"), head, F.lit("</title></head><body>"),
                    F.col("body"), F.lit("</body></html>"),
                )
            )
            .alias("cleaned_html"),
        )
    )
