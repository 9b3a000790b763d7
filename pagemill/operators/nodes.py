"""Cutting, selecting and joining on node rows.

All subtree logic is interval arithmetic over `[id, end)`.  Every window and
group-by here is keyed by `page_id`, so a chain of these operators needs one
exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import let, strip

# Elements that are not content.
EXCLUDED_ELEMENTS = [
    "script", "style", "nav", "header", "footer", "aside", "noscript", "iframe",
    "form", "button", "dialog",
]

# Roles of page furniture.
EXCLUDED_ROLES = ["navigation", "banner", "complementary", "contentinfo"]

# Class and id patterns of page furniture.
EXCLUDED_CLASS_ID_PATTERNS = [
    "sidebar", "menu", "nav[-_]", "breadcrumb", "pagination",
    "advertisement", "ad[-_]", "banner", "popup", "modal",
    "widget", "comment[-_]?(?:s|section)?", "related", "newsletter",
    "social[-_]", "share[-_]", "sticky", "overlay", "toolbar",
]

# Main content selectors, best first.
CONTENT_SELECTORS = [
    "article", "main", '[role="main"]', ".article-content", ".post-content",
    ".entry-content", "#content", ".content", "#main", ".main",
]

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCKS = HEADINGS + ["p", "li"]


def page_window() -> WindowSpec:
    return Window.partitionBy("page_id")


def by_id() -> WindowSpec:
    return page_window().orderBy("id")


def so_far() -> WindowSpec:
    return by_id().rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    return by_id().rowsBetween(Window.unboundedPreceding, -1)



# --- predicates ---------------------------------------------------------
def is_element(*tags: str) -> Column:
    return (F.col("kind") == "elem") & F.col("tag").isin(*tags)


def has_excluded_role() -> Column:
    return F.coalesce(F.lower(F.col("attrs")["role"]).isin(EXCLUDED_ROLES), F.lit(False))


def has_excluded_class_or_id() -> Column:
    names = F.concat_ws(" ", F.col("attrs")["class"], F.col("attrs")["id"])
    return (names != "") & names.rlike("(?iu)" + "|".join(EXCLUDED_CLASS_ID_PATTERNS))


def _matches(selector: str) -> Column:
    if selector.startswith("."):
        token = selector[1:]
        return F.col("attrs")["class"].rlike(rf"(?U)(?:^|\s){token}(?:\s|$)")
    if selector.startswith("#"):
        return F.col("attrs")["id"] == selector[1:]
    if selector.startswith("["):
        name, value = selector[1:-1].split("=")
        return F.col("attrs")[name] == value.strip('"')
    return F.col("tag") == selector


def main_priority() -> Column:
    """Rank of a node as main content: selectors, then body, then the document."""
    rank = F.when(F.col("kind") == "doc", len(CONTENT_SELECTORS) + 1)
    chain = None
    for i, selector in enumerate(CONTENT_SELECTORS):
        chain = (F if chain is None else chain).when(_matches(selector), i)
    chain = chain.when(F.col("tag") == "body", len(CONTENT_SELECTORS))
    return rank.when(F.col("kind") == "elem", chain)


# --- subtree filters ----------------------------------------------------
def drop_subtrees(nodes: DataFrame, condition: Column) -> DataFrame:
    """Remove every node that matches and everything inside it.

    Intervals nest, so the greatest `end` among matches so far tells whether
    the current row lies inside one.
    """
    cut = F.max(F.when(condition, F.col("end"))).over(so_far())
    return (
        nodes.withColumn("_cut", cut)
        .filter(F.col("_cut").isNull() | (F.col("_cut") <= F.col("id")))
        .drop("_cut")
    )


def drop_excluded_elements(nodes: DataFrame) -> DataFrame:
    return drop_subtrees(nodes, is_element(*EXCLUDED_ELEMENTS))


def drop_by_role(nodes: DataFrame) -> DataFrame:
    return drop_subtrees(nodes, has_excluded_role())


def drop_by_class_id(nodes: DataFrame) -> DataFrame:
    return drop_subtrees(nodes, has_excluded_class_or_id())


def main_span() -> Column:
    """The page's main content as a struct of priority, id and end.

    The document row always ranks, so every page has one.
    """
    rank = main_priority()
    return F.min(F.when(rank.isNotNull(), F.struct(rank.alias("p"), "id", "end"))).over(page_window())


def select_main_content(nodes: DataFrame) -> DataFrame:
    """Keep the subtree of the best main node, the node itself included."""
    return (
        nodes.withColumn("_main", main_span())
        .filter((F.col("id") >= F.col("_main.id")) & (F.col("id") < F.col("_main.end")))
        .drop("_main")
    )


# --- anchors ------------------------------------------------------------
def anchor_end() -> Column:
    """End of the outermost `a` around a row, null outside any.

    Ends of earlier anchors are no greater than the row's id, so the greatest
    end so far, when beyond the row, belongs to the outermost open anchor and
    names it uniquely.
    """
    reach = F.max(F.when(is_element("a"), F.col("end"))).over(before())
    return F.when(reach > F.col("id"), reach)


def flatten_links(nodes: DataFrame) -> DataFrame:
    """Replace each `a` subtree by one text row with its joined strings.

    Nested anchors belong to the outermost one; an anchor without text goes.
    """
    marked = nodes.withColumn("_anchor", anchor_end())
    plain = F.col("_anchor").isNull() & ~is_element("a")
    string = F.when(F.col("_anchor").isNotNull(), page_string())
    # the anchor's own row and the rows inside it share the key `end`
    key = F.when(plain, -F.col("id") - 1).otherwise(F.coalesce(F.col("_anchor"), F.col("end")))
    first = lambda c: F.min_by(c, "id").alias(c)
    rest = [c for c in nodes.columns if c not in ("page_id", "id", "end", "kind", "tag", "attrs", "text")]
    joined = (
        marked.withColumn("_plain", plain)
        .withColumn("_string", string)
        .groupBy("page_id", key.alias("_key"), "_plain")
        .agg(
            F.min("id").alias("id"),
            F.max("end").alias("end"),
            *[first(c) for c in rest + ["kind", "tag", "attrs", "text"]],
            F.array_join(in_order("_string"), "").alias("_joined"),
        )
    )
    replaced = (
        joined.withColumn("kind", F.when(F.col("_plain"), F.col("kind")).otherwise("text"))
        .withColumn("tag", F.when(F.col("_plain"), F.col("tag")))
        .withColumn("text", F.when(F.col("_plain"), F.col("text")).otherwise(F.col("_joined")))
    )
    return replaced.filter(F.col("_plain") | (F.col("_joined") != "")).select(*nodes.columns)


# --- text ---------------------------------------------------------------
def extract_text(nodes: DataFrame) -> DataFrame:
    """Per page: strip each string, drop blank ones, join with newlines."""
    strings = nodes.select("page_id", "id", page_string().alias("t")).filter("t is not null")
    return strings.groupBy("page_id").agg(F.array_join(in_order("t"), "\n").alias("text"))


def in_order(col: str, by: str = "id") -> Column:
    """Aggregate: the values of `col` as an array in the order of `by`."""
    return F.transform(F.sort_array(F.collect_list(F.struct(by, col))), lambda s: s[col])


def collect_in_spans(
    rows: DataFrame, build: Callable[[Column, Column], dict[str, Column]]
) -> DataFrame:
    """For many spans `[id, end)` of a page, the items that lie in each one.

    `rows` holds (page_id, id, item, spans): a row may carry an item, spans
    (structs with at least the fields seq, id and end), or both.  Spans are
    not joined to items.  Both ends of each span become event rows of the
    same pass; a running count of items over the page gives each end its
    place in the page's item array, and a span is a slice of that array.
    Work grows with rows plus output, never with spans x items.

    `build(items, found)` makes the output columns of a page from its items
    in order and from `found`, an array of structs (seq, span, first, size)
    ordered by seq.
    """
    no_span = F.when(F.lit(False), F.get("spans", F.lit(0)))
    no_item = F.when(F.lit(False), F.col("item"))

    def event(pos: Column, what: int, item: Column, span: Column) -> Column:
        return F.struct(
            pos.alias("pos"), F.lit(what).alias("what"), item.alias("item"), span.alias("span")
        )

    own = event(F.col("id"), 2, F.col("item"), no_span)
    ends = F.flatten(
        F.transform(
            "spans",
            lambda s: F.array(event(s["id"], 0, no_item, s), event(s["end"], 1, no_item, s)),
        )
    )
    events = F.when(F.col("spans").isNull(), F.array(own)).otherwise(
        F.when(F.col("item").isNull(), ends).otherwise(F.concat(F.array(own), ends))
    )
    # an end at a position counts the items before that position
    late = F.col("e.what") == 2
    upto = page_window().orderBy("e.pos", late).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.select("page_id", F.explode(events).alias("e")).select(
        "page_id", "e.what", "e.item", "e.span", F.count_if(late).over(upto).cast("int").alias("seen")
    )

    def sorted_list(what: int, *fields) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("what") == what, F.struct(*fields))))

    seq = F.col("span.seq").alias("seq")
    gathered = F.struct(
        sorted_list(2, "seen", "item").alias("i"),
        sorted_list(0, seq, "seen", "span").alias("o"),
        sorted_list(1, seq, "seen").alias("c"),
    )

    def page(g: Column) -> Column:
        found = F.zip_with(
            g["o"],
            g["c"],
            lambda o, c: F.struct(
                o["seq"].alias("seq"),
                o["span"].alias("span"),
                (o["seen"] + 1).alias("first"),
                (c["seen"] - o["seen"]).alias("size"),
            ),
        )
        items = F.transform(g["i"], lambda x: x["item"])
        pair = F.struct(items.alias("items"), found.alias("found"))
        return let(pair, lambda p: F.struct(*[c.alias(n) for n, c in build(p["items"], p["found"]).items()]))

    return counted.groupBy("page_id").agg(let(gathered, page).alias("p")).select("page_id", "p.*")


def span_text(items: Column, found: Column) -> Column:
    """Strings of one found span, joined without a gap."""
    return F.array_join(F.slice(items, found["first"], found["size"]), "")


def format_block(tag: Column, text: Column) -> Column:
    """Headings with `#` per level, paragraphs, bullets."""
    level = F.substring(tag, 2, 1)
    heading = F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), text, F.lit("\n"))
    return (
        F.when(tag == "p", F.concat(F.lit("\n"), text, F.lit("\n")))
        .when(tag == "li", F.concat(F.lit("• "), text, F.lit("\n")))
        .otherwise(heading)
    )


def extract_structured_text(nodes: DataFrame) -> DataFrame:
    """Per page: headings, paragraphs and list items in document order.

    Other text is left out, nested blocks repeat their text, and strings
    inside a block join without a space.
    """
    rows = nodes.select("page_id", "id", page_string().alias("item"), block_span().alias("spans"))
    rows = rows.filter(F.col("item").isNotNull() | F.col("spans").isNotNull())
    return collect_in_spans(rows, lambda items, found: {"text": join_blocks(items, found)}).filter("text <> ''")


def page_string() -> Column:
    """A row's stripped string, null for blank ones and for other kinds of row."""
    return F.when(F.col("kind") == "text", F.nullif(strip("text"), F.lit("")))


def block_span() -> Column:
    span = F.struct(F.col("id").alias("seq"), "id", "end", "tag")
    return F.when(is_element(*BLOCKS), F.array(span))


def join_blocks(items: Column, found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: format_block(f["span"]["tag"], span_text(items, f))), "")


def is_feed(nodes: DataFrame) -> DataFrame:
    """Per page: does it hold an rss, feed or channel element anywhere?"""
    return nodes.groupBy("page_id").agg(
        F.bool_or(is_element("rss", "feed", "channel")).alias("is_feed")
    )
