"""Hard-negative mining by slots between the positives' scores.

Every positive of an anchor asks for the best rows of other labels whose score
lies in a window under its own: least_percent * positive <= 100 * score <= 100 *
positive. The windows of one anchor overlap, but their upper limits, the
positives' scores in descending order, cut the scores into disjoint slots: slot
i holds the scores over the next positive's limit and up to the limit of
positive i. A task keeps the best k rows of each slot and anchor, and tasks'
slots are merged by an aggregate. The best k rows under limit i are then the
merge of slot i with the best k of all lower slots: one descending merge over
the slots' suffixes answers every window, and the lower limit only cuts the end
of such a list.

Anchors are a stated set. They go out in blocks of bounded bytes, each block to
every task, in two passes over the table: positives first, then slots.

Defined results: rows without id or label, and vectors that are null, empty or
hold null or non-finite components take no part; only vectors of the anchor's
own length are compared with it; a row is neither positive nor negative for
anchors of its own id; rows that repeat an id are each a candidate, and each
repeated anchor is answered by itself; ties go to the smaller id; an anchor
without positives, or a positive with an empty window (any with a negative
score), has no rows; scores beyond a long are clamped to its range; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import remove_folder, work_folder
from .vectors import matrices

POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80
SCALE = 256
ANCHOR_EVERY = 100
#: Bytes of anchors' components that one pass sends to every task.
BLOCK_BYTES = 16 << 20
#: Scores that are held at once: anchors of a step times candidates of a step.
CELLS = 1 << 20
_EXACT = float(1 << 53)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; clamped to a long."""
    high = np.abs(anchors).max(initial=0.0) * np.abs(rows).max(initial=0.0) * rows.shape[1]
    if high < _EXACT:
        return (anchors @ rows.T).astype(np.int64)
    whole = [[int(x) for x in r] for r in rows]
    return np.array(
        [[min(max(sum(int(x) * y for x, y in zip(a, r)), _LOW), _HIGH) for r in whole] for a in anchors], np.int64
    ).reshape(len(anchors), len(rows))


def least_score(limit: np.ndarray, percent: int) -> np.ndarray:
    """The least whole score with percent * limit <= 100 * score, for limits from 0."""
    return limit // 100 * percent - (-(limit % 100) * percent) // 100


class Best:
    """The k best (score, id) of every cell, a cell being one of `width` places of an anchor."""

    def __init__(self, cells: int, k: int) -> None:
        self.k = k
        self.score = np.full((cells, k), _LOW, np.int64)
        self.id = np.full((cells, k), _HIGH, np.int64)
        self.size = np.zeros(cells, np.int64)

    def may_enter(self, cell: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        last, name = self.score[cell, -1], self.id[cell, -1]
        return (self.size[cell] < self.k) | (score > last) | ((score == last) & (ids < name))

    def add(self, cell: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merges rows into their cells: one sort, then the first k of each cell."""
        if not len(cell):
            return
        touched = np.unique(cell)
        at, place = np.nonzero(np.arange(self.k) < self.size[touched][:, None])
        old = touched[at]
        cell = np.concatenate([cell, old])
        score = np.concatenate([score, self.score[old, place]])
        ids = np.concatenate([ids, self.id[old, place]])
        order = np.lexsort((ids, ~score, cell))  # ~ turns the order around without overflow
        cell, score, ids = cell[order], score[order], ids[order]
        first = np.searchsorted(cell, touched)
        rank = np.arange(len(cell)) - first[np.searchsorted(touched, cell)]
        stays = rank < self.k
        cell, score, ids, rank = cell[stays], score[stays], ids[stays], rank[stays]
        self.score[cell, rank], self.id[cell, rank] = score, ids
        self.size[touched] = np.bincount(np.searchsorted(touched, cell), minlength=len(touched))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, score, id) of what is held."""
        cell, place = np.nonzero(np.arange(self.k) < self.size[:, None])
        return cell, self.score[cell, place], self.id[cell, place]


class Anchors:
    """One block of anchors: ids, labels, scaled rows by length, and the positives' limits once they are known."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.sets = sets  # (ids, labels, rows) of one length each
        self.starts = np.cumsum([0, *(len(s[0]) for s in sets)])
        self.limits: np.ndarray | None = None  # (anchors, positives), descending, filled up with _LOW

    def __len__(self) -> int:
        return int(self.starts[-1])

    def ids(self) -> np.ndarray:
        return np.concatenate([s[0] for s in self.sets]) if self.sets else np.zeros(0, np.int64)

    def feed(self, best: Best, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, least: int) -> None:
        """Candidates of one length: into the anchors' positives, or into their slots once limits are known."""
        for start, (names, kinds, anchors) in zip(self.starts.tolist(), self.sets):
            if anchors.shape[1] != rows.shape[1]:
                continue
            at, step = 0, 64  # small steps first: later candidates meet full cells
            while at < len(ids):
                part = slice(at, at + step)
                wide = max(1, CELLS // step)
                for a in range(0, len(names), wide):
                    self._step(best, start + a, names[a : a + wide], kinds[a : a + wide], anchors[a : a + wide], ids[part], labels[part], rows[part], least)
                at, step = at + step, min(step * 4, 4096)

    def _step(self, best, start, names, kinds, anchors, ids, labels, rows, least) -> None:
        score = scores(anchors, rows)
        other = names[:, None] != ids[None, :]
        same = kinds[:, None] == labels[None, :]
        if self.limits is None:
            a, c = np.nonzero(other & same)
            value, cell = score[a, c], start + a
        else:
            limits = self.limits[start : start + len(names)]
            lowest = np.where(limits >= 0, limits, _HIGH).min(axis=1)  # a limit under 0 has an empty window
            floor = np.where(lowest == _HIGH, _HIGH, least_score(lowest, least))
            a, c = np.nonzero(other & ~same & (score >= floor[:, None]) & (score <= limits[:, :1]))
            value = score[a, c]
            slot = (limits[a] >= value[:, None]).sum(axis=1) - 1
            cell = (start + a) * limits.shape[1] + slot
        stays = best.may_enter(cell, value, ids[c])
        best.add(cell[stays], value[stays], ids[c][stays])


def _blocks(asked: DataFrame, folder: str) -> Iterator[tuple[int, Anchors]]:
    """The anchors, written once in blocks of about BLOCK_BYTES and read back block by block."""
    size = asked.agg(F.sum(F.size("embedding").cast("long") * 8)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    asked.withColumn("block", F.floor(F.rand(0) * blocks).cast("int")).write.partitionBy("block").parquet(folder)
    for b in range(blocks if size else 0):
        rows = asked.sparkSession.read.schema("vec_id long, label long, embedding array<double>, block int").parquet(folder)
        table = rows.where(F.col("block") == b).toArrow().combine_chunks()
        block = Anchors(labelled(table["vec_id"].combine_chunks(), table["label"].combine_chunks(), table["embedding"].combine_chunks()))
        if len(block):
            yield b, block


def labelled(ids: pa.Array, labels: pa.Array, vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, scaled rows) of the usable vectors, by length."""
    known = labels.is_valid()
    ids, labels, vectors = ids.filter(known), labels.filter(known), vectors.filter(known)
    places = pa.array(np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.arange(len(ids)), -1))
    names, kinds = ids.fill_null(0).to_numpy(), labels.to_numpy()
    usable = pc.if_else(pc.greater_equal(places, 0), places, pa.scalar(None, pa.int64()))
    return [(names[at].astype(np.int64), kinds[at].astype(np.int64), np.floor(rows * SCALE)) for at, rows in matrices(usable, vectors)]


def _search(spark: SparkSession, rows: DataFrame, block: Anchors, k: int, width: int, least: int) -> tuple[DataFrame, Broadcast]:
    """(number, place, score, vec_id): each task's best k rows of every cell, then the best k of all tasks."""
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        best = Best(len(anchors) * width, k)
        for batch in batches:
            for ids, labels, values in labelled(batch.column("vec_id"), batch.column("label"), batch.column("embedding")):
                anchors.feed(best, ids, labels, values, least)
        cell, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (cell // width, cell % width, score, ids)], ["number", "place", "score", "vec_id"]
        )

    found = rows.mapInArrow(run, "number long, place long, score long, vec_id long")
    order = W.partitionBy("number", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), shared


def suffix_merges(slots: DataFrame, width: int, k: int) -> DataFrame:
    """(number, place, rank, score, vec_id): the best k rows under each limit, from the slots' lists.

    One row per anchor holds at most width * k entries. From the lowest slot
    up, the list so far is merged with the next slot's.
    """
    entry = F.struct((-F.col("score")).alias("down"), "vec_id", "place")
    lists = slots.groupBy("number").agg(F.collect_list(entry).alias("entries"))
    kind = "array<struct<down:long,vec_id:long,place:long>>"

    def step(state, place):
        own = F.filter("entries", lambda e: e["place"] == place)
        merged = F.slice(F.array_sort(F.concat(state["merged"], own)), 1, k)
        answer = F.transform(merged, lambda e: F.struct(e["down"].alias("down"), e["vec_id"].alias("vec_id"), place.alias("place")))
        return F.struct(merged.alias("merged"), F.concat(state["answers"], answer).alias("answers"))

    start = F.struct(F.array().cast(kind).alias("merged"), F.array().cast(kind).alias("answers"))
    down = F.array(*[F.lit(i).cast("long") for i in range(width - 1, -1, -1)])
    answers = lists.select("number", F.explode(F.aggregate(down, start, step, lambda s: s["answers"])).alias("e"))
    return answers.select("number", F.col("e.place").alias("place"), (-F.col("e.down")).alias("score"), F.col("e.vec_id").alias("vec_id"))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `vectors(vec_id, embedding, label)`."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), is_anchor.alias("is_anchor"))
    asked = rows.where("is_anchor").drop("is_anchor")
    rows = rows.drop("is_anchor")
    folder, results = work_folder(spark, "anchors"), work_folder(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    try:
        spark.createDataFrame([], schema).write.parquet(f"{results}/block=-1")
        for b, block in _blocks(asked, folder):
            best, shared = _search(spark, rows, block, positives, 1, least_percent)
            near = best.toArrow()  # at most `positives` rows for each anchor of the block
            shared.destroy()
            number, rank = near["number"].to_numpy(), near["rank"].to_numpy() - 1
            block.limits = np.full((len(block), positives), _LOW, np.int64)
            block.limits[number, rank] = near["score"].to_numpy()
            names = pa.table({
                "number": near["number"], "place": pa.array(rank, pa.int64()), "anchor_id": pa.array(block.ids()[number], pa.int64()),
                "positive_id": near["vec_id"], "positive_score": near["score"],
            })
            wanted = spark.createDataFrame(names) if len(names) else None
            if wanted is None:
                continue
            best, shared = _search(spark, rows, block, negatives, positives, least_percent)
            answers = suffix_merges(best, positives, negatives).join(wanted, ["number", "place"])
            share = F.lit(100).cast("decimal(3,0)") * F.col("score").cast("decimal(20,0)") >= F.lit(least_percent).cast("decimal(3,0)") * F.col("positive_score").cast("decimal(20,0)")
            order = W.partitionBy("number", "place").orderBy(F.desc("score"), "vec_id")
            answers.where(share).select(
                "anchor_id", "positive_id", F.row_number().over(order).alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
            ).write.parquet(f"{results}/block={b}")
            shared.destroy()
    finally:
        remove_folder(spark, folder)
    return spark.read.schema(schema).parquet(results).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
