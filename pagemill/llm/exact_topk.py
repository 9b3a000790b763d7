"""Exact top-k inner products by branch-and-bound over vertical blocks of dimensions.

Candidates lie in columns: a block of dimensions is one slab over all candidates
of a chunk. For a query, partial products are accumulated slab by slab; after
each one, a candidate's score is bounded by the partial product plus the product
of the remaining masses (the norms of what is still to come, by Cauchy and
Schwarz), and the candidates whose bound is under the k-th score so far are
compacted away. The bound never falls short, so the result is exact.

Queries are a stated set; they go out in blocks of bounded size, each to every
task, and every task hands back at most k rows a query.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows without id; only vectors of the query's
own length are compared with it; a row is no candidate for queries of its own
id; rows that repeat an id are each a candidate, and each repeated query is
answered; ties go to the smaller id; scores beyond a long are clamped to its
range; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise
from .vectors import matrices

K = 5
QUERY_EVERY = 50
SCALE = 256
QUERY_BLOCK = 4096
CHUNK = 4096
SLAB = 8
_SAFE = float(1 << 53)


def scaled(rows: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, whole numbers held as doubles."""
    return np.floor(rows * scale)


def suffix_norms(rows: np.ndarray) -> np.ndarray:
    """Norm of the dimensions from each slab on, (slabs + 1, rows)."""
    n, d = rows.shape
    out = np.zeros((-(-d // SLAB) + 1, n))
    for s in range(len(out) - 2, -1, -1):
        part = rows[:, s * SLAB : (s + 1) * SLAB]
        out[s] = out[s + 1] + np.einsum("ij,ij->i", part, part)
    return np.sqrt(out)


class Search:
    """The k best candidates so far of a block of queries."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> None:
        """`queries`: for each length, the queries' numbers, ids and scaled rows."""
        self.k = k
        self.sets = [(number, ids, rows, suffix_norms(rows)) for number, ids, rows in queries]
        self.best: dict[int, list[tuple[int, int]]] = {int(n): [] for number, _, _ in queries for n in number}  # (-score, id)

    def feed(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Candidates of one length."""
        for number, query_ids, queries, masses in self.sets:
            if queries.shape[1] != rows.shape[1]:
                continue
            for at in range(0, len(ids), CHUNK):
                part, names = rows[at : at + CHUNK], ids[at : at + CHUNK]
                high = np.abs(part).max(initial=0.0) * np.abs(queries).max(initial=0.0) * rows.shape[1]
                slabs = np.ascontiguousarray(part.T)
                norms = suffix_norms(part)
                for i, n in enumerate(number.tolist()):
                    found = self._one(queries[i], masses[:, i], query_ids[i], names, slabs, norms, self.best[n]) if high < _SAFE else self._plain(queries[i], query_ids[i], names, part)
                    if found:
                        self.best[n] = sorted(self.best[n] + found)[: self.k]

    def _one(self, query, mass, own, names, slabs, norms, best) -> list[tuple[int, int]]:
        floor = -best[-1][0] if len(best) == self.k else None
        left = np.flatnonzero(names != own)
        partial = np.zeros(len(left))
        for s in range(len(mass) - 1):
            slab = slabs[s * SLAB : (s + 1) * SLAB]
            weights = query[s * SLAB : (s + 1) * SLAB]
            partial = partial + weights @ (slab if len(left) == slab.shape[1] else slab[:, left])
            rest = mass[s + 1] * norms[s + 1][left]
            if floor is None and len(left) >= self.k:
                lower = partial - rest
                limit = np.partition(lower, len(lower) - self.k)[len(lower) - self.k]
            else:
                limit = floor
            if limit is not None:
                stays = partial + rest * (1 + 1e-9) + 1e-6 >= limit
                if not stays.all():
                    left, partial = left[stays], partial[stays]
                    if not len(left):
                        return []
        if len(left) > self.k:
            limit = np.partition(partial, len(partial) - self.k)[len(partial) - self.k]
            stays = partial >= limit
            left, partial = left[stays], partial[stays]
        found = sorted(zip((-partial).astype(np.int64).tolist(), names[left].tolist()))
        return found[: self.k]

    def _plain(self, query, own, names, part) -> list[tuple[int, int]]:
        """Whole numbers of any size, without bounds."""
        whole = [int(x) for x in query]
        low, high = -(1 << 63), (1 << 63) - 1
        scores = ((min(max(sum(a * int(b) for a, b in zip(whole, row)), low), high), int(n)) for n, row in zip(names, part) if n != own)
        return sorted((-s, n) for s, n in scores)[: self.k]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of `vectors(vec_id, embedding)` for the rows where `is_query` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query"))
    asked = materialise(rows.where("is_query").select("vec_id", "embedding", F.rand(0).alias("r")), "topk-queries")
    blocks = max(1, -(-asked.count() // query_block))
    found = None
    for b in range(blocks):
        block = asked.where(F.least(F.floor(F.col("r") * blocks), F.lit(blocks - 1)) == b).select("vec_id", "embedding").toArrow()
        sets, number = [], 0
        if len(block):
            for ids, values in matrices(block["vec_id"].combine_chunks(), block["embedding"].combine_chunks()):
                sets.append((np.arange(number, number + len(ids)), ids, scaled(values, scale)))
                number += len(ids)
        shared = spark.sparkContext.broadcast(sets)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, b=b) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value, k)
            names = {int(n): int(i) for number, ids, _ in shared.value for n, i in zip(number, ids)}
            for batch in batches:
                for ids, values in matrices(batch.column("vec_id"), batch.column("embedding")):
                    search.feed(ids, scaled(values, scale))
            out = [(b, n, names[n], vec_id, -score) for n, best in search.best.items() for score, vec_id in best]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["block", "number", "query_id", "vec_id", "score"])

        part = rows.select("vec_id", "embedding").mapInArrow(run, "block int, number long, query_id long, vec_id long, score long")
        part = part if blocks == 1 else materialise(part, "topk-block")
        found = part if found is None else found.union(part)
    order = W.partitionBy("block", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
