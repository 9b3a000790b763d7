"""Feeds: items, their fields, and the text of a feed page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nodes import collect_in_spans, is_element, page_string, page_window, span_text
from .parse import fragment_text, fragment_texts

# Fields of a feed item, in output order.
FIELDS = ["title", "description", "summary", "content", "content:encoded"]

#: Item number of a document's span on pages with and without items.
_ITEMS, _NO_ITEMS = -1, -2


def _with_items(nodes: DataFrame) -> DataFrame:
    """Item rows of feed pages get spans, one per field they hold.

    Items are `item`, or `entry` on a page without any `item`.  An item's
    field is the first element of that name after it, provided it still lies
    inside: one backward window instead of a join of items to fields.
    """
    rows = nodes.filter("feed").select(
        "page_id",
        F.when(F.col("kind") == "doc", F.col("url")).alias("url"),
        "id",
        "end",
        F.when(is_element("item", "entry", *FIELDS), F.col("tag")).alias("tag"),
        page_string().alias("item"),
    )
    rows = rows.filter(F.col("tag").isNotNull() | F.col("item").isNotNull() | (F.col("id") == 0))
    after = page_window().orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "item_tag", F.when(F.max(F.col("tag") == "item").over(page_window()), "item").otherwise("entry")
    )
    rows = rows.withColumn("has_items", F.max(F.col("tag").isin("item", "entry")).over(page_window()))
    following = [
        F.min(F.when(F.col("tag") == name, F.struct("id", "end"))).over(after).alias(f"f{i}")
        for i, name in enumerate(FIELDS)
    ]
    rows = rows.select("*", *following)

    def span(i: int) -> Column:
        at = F.col(f"f{i}")
        seq = F.col("id").cast("long") * len(FIELDS) + i
        return F.when(
            at["id"] < F.col("end"),
            F.struct(
                seq.alias("seq"),
                at["id"].alias("id"),
                at["end"].alias("end"),
                F.col("id").alias("item_id"),
                F.lit(FIELDS[i]).alias("field"),
            ),
        )

    spans = F.array_compact(F.array(*[span(i) for i in range(len(FIELDS))]))
    # the document row has one empty span, which carries the URL along and whether there are items
    document = F.struct(
        F.lit(-1).cast("long").alias("seq"),
        F.col("id").alias("id"),
        F.col("id").alias("end"),
        F.when(F.col("has_items"), _ITEMS).otherwise(_NO_ITEMS).alias("item_id"),
        F.col("url").alias("field"),
    )
    return rows.select(
        "page_id",
        "url",
        "id",
        "item",
        F.when(F.col("id") == 0, F.array(document))
        .when(F.col("tag") == F.col("item_tag"), spans)
        .alias("spans"),
    ).filter("item is not null or size(spans) > 0")


def _fields(rows: DataFrame) -> DataFrame:
    """One row per item and field; a field that holds markup is parsed again.

    The document's row has seq -1 and its URL as `field`.
    """

    def page(items: Column, found: Column) -> dict[str, Column]:
        field = lambda f: F.struct(
            f["seq"].alias("seq"),
            f["span"]["item_id"].alias("item_id"),
            f["span"]["field"].alias("field"),
            span_text(items, f).alias("raw"),
        )
        return {"fields": F.transform(found, field)}

    fields = collect_in_spans(rows, page).select("page_id", F.explode("fields").alias("f")).select("page_id", "f.*")
    marked = F.col("raw").contains("<") & F.col("raw").contains(">")
    text = F.when(marked, fragment_text(F.when(marked, F.col("raw")))).otherwise(F.col("raw"))
    return fields.select("page_id", "item_id", "seq", "field", text.alias("text"))


def feed_items(nodes: DataFrame) -> DataFrame:
    """One row per feed item and field that has text."""
    return _fields(_with_items(nodes)).filter("seq >= 0 and text <> ''").drop("seq")


def extract_feed_text(
    nodes: DataFrame, finish: Callable[[Column], Column] = lambda text: text
) -> DataFrame:
    """(page_id, url, text) per feed page: item fields joined by blank lines,
    or all text, one line per string, when there are no items.
    """

    def page(items: Column, found: Column) -> dict[str, Column]:
        document = found[0]["span"]
        fields = F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))
        has_items = document["item_id"] == _ITEMS
        return {
            "url": document["field"],
            "raw": F.when(has_items, F.transform(fields, lambda f: span_text(items, f))),
            "lines": F.when(~has_items, F.array_join(items, "\n")),
        }

    pages = collect_in_spans(_with_items(nodes), page)
    marked = F.exists("raw", lambda r: r.contains("<") & r.contains(">"))
    texts = F.when(marked, fragment_texts(F.when(marked, F.col("raw")))).otherwise(F.col("raw"))
    joined = F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")
    return pages.select("page_id", "url", finish(F.coalesce("lines", joined)).alias("text"))
