"""What several of the operators share: written intermediates, Arrow maps, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_folder

#: Blanks between words, as a class body for regular expressions: space and tab to carriage return.
BLANKS = r"\x20\x09-\x0D"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared work folder and read back.

    It cuts the lineage, survives lost executors, and gives Spark the true size
    of a small table, so that joins broadcast by size and not by hint.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]
) -> DataFrame:
    """`mapInArrow` with a per-task set-up: `make()` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, schema)


def row_key(*columns: Column | str) -> Column:
    """One non-null string for a row's identity; null columns count as equal."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) if isinstance(c, str) else c for c in columns])


def packed(df: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """`df`'s columns (or those to `keep`) as one struct `_row`, so that working columns cannot clash with them."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("_row")
    return df.select(row, *[c.alias(n) for n, c in columns.items()])


def hashed_sample(df: DataFrame, size: int, seed: str, *columns: str) -> DataFrame:
    """Rows whose hash of `columns` lies in the part of the hash range that holds about `size` rows.

    The same rows each time, chosen in a map; everything when the table is no larger.
    """
    rows = df.count()
    if rows <= size:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) < int((1 << 40) * size / rows))


def least_hashed(rows: DataFrame, of: str, label: Column, most: int) -> DataFrame:
    """The distinct rows of each label with the `most` least hashes of column `of`, and maybe a few more.

    All rows are read, and every task keeps no more than it may give: what is
    exchanged does not grow with the rows, and a rare label is not thinned out.
    """
    names = [of, *(c for c in rows.columns if c != of)]
    keyed = rows.select(*names, label.cast("int").alias("_label"), F.xxhash64(of).alias("_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, set] = {}
        limits: dict[int, tuple] = {}
        schema = None

        def prune(at: int) -> None:
            least = sorted(kept[at])[:most]
            kept[at] = set(least)
            if len(least) == most:
                limits[at] = least[-1]

        for batch in batches:
            schema = batch.schema
            values = zip(*(batch.column(c).to_pylist() for c in ("_hash", *names)))
            for at, row in zip(batch.column("_label").to_pylist(), values):
                if at in limits and row > limits[at]:
                    continue
                kept.setdefault(at, set()).add(row)
                if len(kept[at]) > 2 * most:
                    prune(at)
        for at in kept:
            prune(at)
            columns = zip(*kept[at])
            next(columns)  # the hash
            yield pa.RecordBatch.from_arrays([pa.array(v, schema.field(n).type) for n, v in zip(names, columns)], names)

    return keyed.mapInArrow(run, rows.select(*names).schema).select(*rows.columns).distinct()


def _bounds(edges: DataFrame) -> DataFrame:
    """Both directions of every edge with the least label around the source."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of `edges(a, b)`; the root is the least node reachable.

    Alternating large-star and small-star steps: each is one aggregate with a
    map-side part and one equi-join that may be split on skew. Rounds grow with
    the logarithm of the longest chain. Every round is a written table.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        # large star: larger neighbours of a node move to its least neighbour
        large = _bounds(now).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
