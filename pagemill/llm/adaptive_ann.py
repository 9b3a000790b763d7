"""Approximate nearest neighbours with an adaptive dimension scan inside probed lists.

Largest inner products become nearest points by one more component, what the
square of a vector's norm lacks to the largest (0 for queries). All points are
turned by one random rotation, so that the first columns of a difference tell
of all of it. Lists are the cells of k-means centres, fitted on a bounded
sample; every row is put into its list. A query looks at its nearest lists. In
a list, squared differences are summed in blocks of columns, and after each
block a candidate is given up when a hypothesis test says that its distance,
judged by the columns so far, is over the query's limit. The limit is the
distance of its LIMIT_AT * k-th neighbour in the sample; that is all the sample
gives to an answer. Those that are left get their exact score from the original
vectors. Queries with fewer than k left look at every list, without a limit.

Lists are dealt as cells of at most about `SLICE` rows and `CHUNK` look-ups, so
a list that holds a third of all rows is many groups.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without id, nor vectors of another length
than most have (the shorter one on ties); rows that repeat an id count once,
with their best score; a row is no candidate for its own id; ties go to the
smaller id; with no more than k candidates all are returned; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hashed_sample, map_rows, materialise
from .vectors import matrices

K = 20
QUERY_EVERY = 20
#: Rows on which centres and limits are fitted, at most.
SAMPLE = 8192
#: Part of the lists that a query looks at, and at least so many.
PROBE_SHARE, LEAST_PROBES = 0.65, 16
COLUMNS = 16
#: Width of the hypothesis test: the part by which an estimate from d columns may exceed the limit is this over the root of d.
TEST = 2.1
SLICE, CHUNK = 4096, 1024
#: The limit is the distance of the neighbour so many times k away in the sample.
LIMIT_AT = 2
#: Pairs whose differences are held at a time.
PAIRS = 65_536


class Index:
    """Rotation, centres and sample; what tasks need to place and judge vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, top: float, lists: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        d = rows.shape[1] + 1
        self.length, self.top = rows.shape[1], top
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        self.ids, self.rows = ids, rows
        self.points = self.turn(rows)
        centres = self.points[rng.permutation(len(rows))[:lists]]
        for _ in range(12):
            nearest = self._nearest(self.points, centres, 1)[:, 0]
            sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
            np.add.at(sums, nearest, self.points)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        self.centres = centres

    def turn(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated points, with the component that makes all candidates equally long."""
        lack = np.zeros(len(rows)) if query else np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", rows, rows), 0))
        return np.column_stack([rows, lack]) @ self.rotation

    @staticmethod
    def _nearest(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
        away = np.einsum("ij,ij->i", centres, centres) - 2 * points @ centres.T
        if n == 1:
            return away.argmin(axis=1)[:, None]
        return np.argsort(away, axis=1, kind="stable")[:, :n]

    def lists(self, points: np.ndarray, n: int = 1) -> np.ndarray:
        return np.concatenate([self._nearest(points[i : i + 2048], self.centres, n) for i in range(0, len(points), 2048)])

    def limits(self, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Squared distance of each query's k-th neighbour in the sample, infinite if it has fewer."""
        limits = np.full(len(ids), np.inf)
        for i, (own, row) in enumerate(zip(ids, rows)):
            score = self.rows @ row
            score[self.ids == own] = -np.inf
            if int((self.ids != own).sum()) >= k:
                limits[i] = row @ row + self.top - 2 * np.partition(score, len(score) - k)[len(score) - k]
        return limits


def survivors(points: np.ndarray, queries: np.ndarray, limits: np.ndarray, columns: int = COLUMNS, test: float = TEST) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that the test does not give up."""
    d = points.shape[1]
    q, c, away, done = None, None, None, 0
    while done < d:
        upto = min(d, done + columns)
        a, b = queries[:, done:upto], points[:, done:upto]
        if q is None:
            whole = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * a @ b.T
        else:
            for i in range(0, len(q), PAIRS):
                step = a[q[i : i + PAIRS]] - b[c[i : i + PAIRS]]
                away[i : i + PAIRS] += np.einsum("ij,ij->i", step, step)
        done = upto
        slack = (1 + test / np.sqrt(done)) ** 2 * done / d if done < d else 1 + 1e-9
        if q is None:
            q, c = np.nonzero(whole <= limits[:, None] * slack + 1e-9)
            away = whole[q, c]
        else:
            stays = away <= limits[q] * slack + 1e-9
            q, c, away = q[stays], c[stays], away[stays]
        if not len(q):
            break
    return q, c


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(vectors: DataFrame, is_query: Column, k: int = K, sample: int = SAMPLE, probe_share: float = PROBE_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score) of `vectors(vec_id, embedding)` for the rows where `is_query` holds."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    usable = rows.where("vec_id is not null and size(embedding) > 0").withColumn("_square", square).where("_square > 0 and _square < double('infinity')")
    usual = usable.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows"), F.max("_square").alias("top")).orderBy(F.desc("rows"), "n").first()
    if usual is None:
        return empty
    usable = usable.where(F.size("embedding") == usual.n).drop("_square")
    lists = max(1, min(int(round(usual.rows**0.5)), sample // 16))
    probes = min(lists, max(LEAST_PROBES, int(np.ceil(lists * probe_share))))

    picked = hashed_sample(usable, 2 * sample, "ann", "vec_id").orderBy(F.xxhash64(F.lit("ann"), "vec_id"), "vec_id").limit(sample).select("vec_id", "embedding").toArrow()
    ids, values = matrices(picked["vec_id"].combine_chunks(), picked["embedding"].combine_chunks())[0]
    shared = spark.sparkContext.broadcast(Index(ids, values, float(usual.top), lists))

    def make_place():
        index = shared.value

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for ids, values in matrices(batch.column("vec_id"), batch.column("embedding")):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index.lists(index.turn(values))[:, 0].astype(np.int32)), pa.array(ids), _lists_of(values)],
                    ["list", "vec_id", "embedding"],
                )

        return work

    def make_ask():
        index = shared.value

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for ids, values in matrices(batch.column("vec_id"), batch.column("embedding")):
                limits = index.limits(ids, values, LIMIT_AT * k)
                near = index.lists(index.turn(values, query=True), probes).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids),
                        _lists_of(values),
                        pa.array(limits),
                        pa.array(list(near), pa.list_(pa.int32())),
                    ],
                    ["query_id", "embedding", "max_square", "lists"],
                )

        return work

    placed = materialise(map_rows(usable.select("vec_id", "embedding"), "list int, vec_id long, embedding array<double>", make_place), "ann-lists")
    asked = materialise(
        map_rows(
            usable.where("is_query").select("vec_id", "embedding"),
            "query_id long, embedding array<double>, max_square double, lists array<int>",
            make_ask,
        ),
        "ann-queries",
    )
    looks = asked.select("query_id", F.col("embedding").alias("q"), "max_square", F.explode("lists").alias("list"))

    def scan(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        index = shared.value
        if not len(candidates) or not len(queries):
            return _FOUND.empty_table()
        ids, values = matrices(candidates["vec_id"].combine_chunks(), candidates["embedding"].combine_chunks())[0]
        names, rows = matrices(queries["query_id"].combine_chunks(), queries["q"].combine_chunks())[0]
        limits = queries["max_square"].to_numpy()
        q, c = survivors(index.turn(values), index.turn(rows, query=True), limits)
        other = names[q] != ids[c]
        q, c = q[other], c[other]
        scores = np.concatenate([np.einsum("ij,ij->i", rows[q[i : i + 65536]], values[c[i : i + 65536]]) for i in range(0, len(q), 65536)]) if len(q) else np.empty(0)
        order = np.lexsort((ids[c], -scores, q))
        q, c, scores = q[order], c[order], scores[order]
        first = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) if len(q) else first
        keep = place < k
        return pa.table([pa.array(names[q[keep]]), pa.array(ids[c[keep]]), pa.array(scores[keep])], schema=_FOUND)

    placed_sizes = placed.groupBy("list").agg(F.count("*").alias("rows"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(looks: DataFrame) -> DataFrame:
        """The k best that the scan leaves of the lists to look at; a list of many rows or look-ups is a grid of cells."""
        sizes = placed_sizes.join(looks.groupBy("list").agg(F.count("*").alias("looks")), "list")
        grid = materialise(sizes.select("list", F.ceil(F.col("rows") / SLICE).cast("int").alias("slices"), F.ceil(F.col("looks") / CHUNK).cast("int").alias("chunks")), "ann-grid")

        def dealt(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
            mine = F.pmod(F.xxhash64(name), F.col(own)).cast("int")
            cells = df.join(grid, "list").withColumn("_own", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            return cells.withColumns({own: F.col("_own"), other: F.col("_other")}).drop("_own", "_other")

        left = dealt(placed, "vec_id", "slices", "chunks").groupBy("list", "slices", "chunks")
        right = dealt(looks, "query_id", "chunks", "slices").groupBy("list", "slices", "chunks")
        found = left.cogroup(right).applyInArrow(scan, "query_id long, vec_id long, score double")
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = materialise(best(looks), "ann-found")
    filled = first.where(F.col("rank") == k).select("query_id")
    # queries with fewer than k left look at all lists, without a limit
    short = materialise(asked.join(filled, "query_id", "left_anti"), "ann-short")
    again = short.select("query_id", F.col("embedding").alias("q"), F.lit(float("inf")).alias("max_square"), F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list"))
    return first.join(filled, "query_id", "left_semi").select(*first.columns).union(best(again))


def _lists_of(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)), pa.array(rows.ravel()))
