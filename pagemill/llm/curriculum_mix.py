"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Each source gets a target: its share, by weight, of `share` times all words, at
most `cap` times its own words; what is above goes to the others by weight.
The words of a source's target are a stream: its documents in the order of a
hash, over and over, cut where the target ends. A source's weight changes over
training time; the integral of its schedule is the cumulative demand for its
words, and the inverse of the demand at a word's place in the stream is its
training position. The mix is range-sorted by position.

No window runs over a whole source: documents of a source lie in ranges of
their hash, a range's offset comes from a table of range sums, and only a range
is sorted. Range sums are summed in two steps in the same way.

Defined results: a null text has no words; documents without words are taken 0
times; a null source is a source, last in order; rows that repeat count each;
null doc_ids are allowed; an empty table gives an empty table; clashing column
names do not matter, since the working columns are prefixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, materialise, packed

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
CAP = 2
#: Relative weight at the start and at the end of training, by a source's place among `WEIGHTS`.
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
#: Documents of a hash range, about.
RANGE_ROWS = 4096
_WORD = f"[^{BLANKS}]+"


def words(text: Column) -> Column:
    """Number of words of a text, null counting as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """Per source: (_source, _place, source_size, _rows, target), from one row per source.

    In the order of size over weight, the sources cut at the cap come first: a
    source is cut when its cap is at most its weight's part of what the ones
    before leave. The others share the rest by weight.
    """
    by_name = W.orderBy(F.col("_source").isNull(), F.col("_source"))
    placed = sizes.withColumn("_place", (F.row_number().over(by_name) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") + 1).cast("int")).cast("long")
    order = W.orderBy(F.col("source_size") / F.col("_weight"), F.col("_source").isNull(), F.col("_source"))
    everything = W.partitionBy(F.lit(0))
    most = F.col("source_size") * cap
    ranked = (
        placed.withColumn("_weight", weight)
        .withColumn("_total", F.sum("source_size").over(everything) * (share_percent / 100))
        .withColumn("_before", F.coalesce(F.sum(most).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_left", F.sum("_weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_cut", most * F.col("_left") <= (F.col("_total") - F.col("_before")) * F.col("_weight"))
    )
    used = F.sum(F.when(F.col("_cut"), most).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("_cut"), 0).otherwise(F.col("_weight"))).over(everything)
    target = F.when(F.col("_cut"), most.cast("double")).otherwise((F.col("_total") - used) * F.col("_weight") / open_weight)
    return ranked.withColumn("target", target).select("_source", "_place", "source_size", "_rows", "target")


def demand_position(part: Column, start: Column, end: Column) -> Column:
    """Training time at which a source with a linear schedule has given out `part` of its words.

    The demand by time t is (start t + (end - start) t² / 2) / ((start + end) / 2);
    its inverse, in the form that does not cancel, holds for equal ends too.
    """
    y = part * (start + end)
    return y / (start + F.sqrt(start * start + (end - start) * y))


def taken_words(
    documents: DataFrame, keep: list[str] | None = None, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP
) -> DataFrame:
    """(_row, size, source_size, target, taken) and the working columns of `mix`; `_row` is the document or its columns to `keep`."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")))
    base = packed(documents, keep, _source=F.col("source"), size=words(F.col("text")), _hash=order)
    narrow = materialise(base.select("_source", "size", F.substring("_hash", 1, 8).alias("_hash")), "mix-sizes")
    sums = narrow.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sources = materialise(targets(sums, weights, share_percent, cap), "mix-sources")

    ranges = F.greatest(F.ceil(F.col("_rows") / RANGE_ROWS), F.lit(1)).cast("long")
    where = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")

    def in_range(rows: DataFrame) -> DataFrame:
        joined = rows.join(sources.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
        return joined.drop("_s").withColumn("_range", F.floor(where * ranges / F.lit(1 << 32)).cast("long"))

    parts = in_range(narrow).groupBy("_source", "_range").agg(F.sum("size").alias("_words"))
    parts = parts.withColumn("_block", F.floor(F.col("_range") / RANGE_ROWS))
    blocks = parts.groupBy("_source", "_block").agg(F.sum("_words").alias("_bwords"))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn(
        "_boffset", F.coalesce(F.sum("_bwords").over(earlier(W.partitionBy("_source").orderBy("_block"))), F.lit(0))
    ).select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "_boffset")
    offsets = parts.join(blocks, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))).withColumn(
        "_offset",
        F.col("_boffset") + F.coalesce(F.sum("_words").over(earlier(W.partitionBy("_source", "_block").orderBy("_range"))), F.lit(0)),
    )
    offsets = materialise(offsets.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), "_offset"), "mix-offsets")

    placed = in_range(base).join(offsets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).drop("_s", "_r")
    inside = W.partitionBy("_source", "_range").orderBy("_hash", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.col("_offset") + F.sum("size").over(inside) - F.col("size")
    whole = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    rest = whole - F.col("_passes") * F.col("source_size")
    cut = F.least(F.greatest(rest - F.col("_start"), F.lit(0)), F.col("size"))
    return (
        placed.withColumn("_start", start)
        .withColumn("_passes", passes)
        .withColumn("taken", F.col("_passes") * F.col("size") + cut)
    )


def _position(copy: Column, schedules) -> Column:
    """Training position of the first word of a document's copy in its source's stream."""
    at = lambda i: F.element_at(F.array(*[F.lit(float(s[i])) for s in schedules]), ((F.col("_place") % len(schedules)) + 1).cast("int"))
    part = (copy * F.col("source_size") + F.col("_start")) / F.greatest(F.round("target").cast("long"), F.lit(1))
    return demand_position(F.least(part, F.lit(1.0)), at(0), at(1))


def mix_report(documents: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_position), ordered by position; no text is shuffled."""
    rows = taken_words(documents, ["doc_id"])
    position = F.when(F.col("taken") > 0, _position(F.lit(0), schedules))
    found = rows.select(F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", position.alias("first_position"))
    return found.orderBy("first_position", "doc_id")


def mix(documents: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """The training stream: documents, a row for each copy, in the order of training position.

    The copy at which a source's target ends is cut to the words still due.
    """
    rows = taken_words(documents)
    due = F.least(F.col("taken") - F.col("_copy") * F.col("size"), F.col("size"))
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    spread = (
        rows.where("taken > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        .withColumn("_due", due)
        .withColumn("_at", _position(F.col("_copy"), schedules))
    )
    pieces = F.regexp_extract_all(F.col("_row.text"), F.lit(f"[{BLANKS}]*{_WORD}"), F.lit(0))
    begun = F.array_join(F.slice(pieces, 1, F.col("_due").cast("int")), "")
    part = F.col("_due") < F.col("size")
    stream = spread.withColumn("_text", F.when(part, begun).otherwise(F.col("_row.text")))
    own = {"text": F.col("_text"), "n_chars": F.when(part, F.length("_text").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in documents.columns else None}
    columns = [own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in documents.columns]
    return stream.orderBy("_at", "_hash").select(columns)
