"""Phrase collocations by best-first branch-and-bound growth.

Words are counted first. A word below the least count bounds everything it is
part of to nothing, so only pairs of frequent words are counted. A counted pair
is a candidate and also a prefix that may grow. Whatever grows from `x y` occurs
at most f(x y) times and its rest at least as often as itself, so its score at
the cut after x, a * a / (f(x) * f(rest)), is at most f(x y) / f(x): the bound
never lies under a score that it stands for.

The frontier is expanded best-first in rounds. Each language has a level; a
round counts the triples that grow from prefixes whose bound reaches it, and
those that could swallow a pair whose score reaches it. After that every
candidate from the level up, and whether it survives, is known. A language with
enough survivors from its level up is settled, ties included; the others lower
their level, in the end to nothing. Rounds read the corpus, prefixes outside
the frontier are skipped in the task that scans them, by Bloom filters of
bounded size; filters let too much through at worst, exact joins follow.

Defined results: a null text is empty; a null language is `und` and shares its
phrases with that name; words have no bounded length; texts that repeat count
as often as they come; a language without candidates has no rows; ties in score
and count go by the phrase's bytes; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialise

LEAST_COUNT = 10
LIMIT = 2000
SWALLOW_PERCENT = 50
SCORE_SCALE = 1_000_000
#: A task counts after so many words, or so many different ones.
CHUNK_WORDS, CHUNK_VOCABULARY = 1 << 20, 200_000
#: Bytes of a text that are split into words at once.
WINDOW_BYTES = 1 << 20
#: Bloom filters: bits for each entry, and bytes at most.
FILTER_BITS, FILTER_BYTES = 16, 8 << 20
_STOP = b"\n"
_TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_EMPTY, _BORDER = -1, 0


class Filter:
    """A Bloom filter over 64-bit hashes, two places for each."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in (hashes & self.mask, (hashes >> np.uint64(32)) & self.mask):
            out &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out


def _rotated(h: Column) -> Column:
    return F.shiftleft(h, 23).bitwiseOR(F.shiftrightunsigned(h, 41))


def pair_hash(first: Column, second: Column) -> Column:
    return first.bitwiseXOR(_rotated(second))


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first ^ ((second << np.uint64(23)) | (second >> np.uint64(41)))


def build_filter(hashes: DataFrame) -> Filter:
    """The filter of `hashes(h)`, its bits put together by an aggregate."""
    n = hashes.count()
    bits = 1 << 10
    while bits < FILTER_BITS * n and bits < 8 * FILTER_BYTES:
        bits *= 2
    mask = F.lit(bits - 1).cast("long")
    places = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    found = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()  # at most FILTER_BYTES / 8 rows
    words = np.zeros(bits // 64, np.uint64)
    words[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return Filter(words)


class _Run:
    """The words of one language since the last count."""

    def __init__(self, lang: str) -> None:
        self.seed = xxh64_intdigest(lang.encode("utf-8"), 42)
        self.numbers: dict[bytes, int] = {b"": _EMPTY, _STOP: _BORDER}
        self.words: list[bytes] = [_STOP]
        self.parts: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> int:
        numbers = self.numbers
        for w in set(words).difference(numbers):
            numbers[w] = len(self.words)
            self.words.append(w)
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self.parts.append(ids[ids != _EMPTY])
        return len(ids)


def _windows(text: bytes) -> Iterator[list[bytes]]:
    """Words and borders of a text, a bounded number of bytes (or one word) at a time."""
    at = 0
    while at < len(text):
        end = at + WINDOW_BYTES
        while at + WINDOW_BYTES < len(text) and end < len(text) and text[end] not in b" \t\n.,;:!?\x0b\x0c\r":
            end += 1
        yield text[at:end].lower().translate(_TABLE).replace(_STOP, b" \n ").split(b" ")
        at = end


def count_phrases(documents: DataFrame, size: int, wanted: Callable[[list[np.ndarray]], np.ndarray] | None = None) -> DataFrame:
    """(lang, w1.., f) of all phrases of `size` words that may be `wanted`, given the hashes of their words."""
    names = [f"w{i + 1}" for i in range(size)]

    def counted(lang: str, run: _Run) -> pa.RecordBatch:
        ids = np.concatenate(run.parts) if run.parts else np.zeros(0, np.int64)
        columns = [ids[i : len(ids) - size + 1 + i] for i in range(size)]
        stays = np.ones(len(columns[0]), bool)
        for c in columns:
            stays &= c != _BORDER
        columns = [c[stays] for c in columns]
        if wanted is not None and len(columns[0]):
            hashes = np.array([xxh64_intdigest(w, run.seed) for w in run.words], np.uint64)
            stays = wanted([hashes[c] for c in columns])
            columns = [c[stays] for c in columns]
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns:  # numbers are below 2 ** 21
            key = key << 21 | c
        key, f = np.unique(key, return_counts=True)
        words = pa.array(run.words, pa.binary())
        places = [key >> 21 * (size - 1 - i) & (1 << 21) - 1 for i in range(size)]
        phrases = [words.take(pa.array(p)).cast(pa.string()) for p in places]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), *phrases, pa.array(f, pa.int64())], ["lang", *names, "f"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, _Run] = {}
        held = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, value in zip(batch.column("lang").to_pylist(), texts):
                for words in _windows(value.as_py() or b""):
                    run = runs.get(lang) or runs.setdefault(lang, _Run(lang))
                    held += run.add(words)
                    if held >= CHUNK_WORDS or sum(len(r.words) for r in runs.values()) >= CHUNK_VOCABULARY:
                        last = np.concatenate(run.parts[-1:])[-(size - 1) :] if size > 1 else np.zeros(0, np.int64)
                        if size > 1 and len(last) < size - 1:
                            last = np.concatenate(run.parts)[-(size - 1) :]
                        tail = [run.words[i] for i in last]
                        for name, r in runs.items():
                            yield counted(name, r)
                        runs, held = {lang: _Run(lang)}, 0
                        runs[lang].add(tail)  # phrases may go on over the cut
                if lang in runs:
                    runs[lang].add([_STOP])
        for name, r in runs.items():
            yield counted(name, r)

    schema = ", ".join(["lang string", *(f"{n} string" for n in names), "f long"])
    return documents.mapInArrow(work, schema).groupBy("lang", *names).agg(F.sum("f").alias("f"))


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCORE_SCALE * a * a / (left * right)), exact for counts to 10 ** 15."""
    n = "decimal(16,0)"
    return F.expr(
        f"(cast({SCORE_SCALE} as decimal(7,0)) * cast(cast({a} as {n}) * cast({a} as {n}) as decimal(31,0))) div (cast({left} as {n}) * cast({right} as {n}))"
    )


def _pair_candidates(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, w1, w2, a, l, r, score, bound)."""
    first = words.select("lang", F.col("w1"), F.col("f").alias("l"))
    second = words.select("lang", F.col("w1").alias("w2"), F.col("f").alias("r"))
    found = pairs.withColumnRenamed("f", "a").join(first, ["lang", "w1"]).join(second, ["lang", "w2"])
    return found.select("lang", "w1", "w2", "a", "l", "r", _score("a", "l", "r").alias("score"), F.expr(f"({SCORE_SCALE} * cast(a as decimal(20,0))) div l").alias("bound"))


def _triple_candidates(triples: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, w1, w2, w3, a, l, r, score): the lower of the two cuts, the first of equal ones."""
    found = (
        triples.withColumnRenamed("f", "a")
        .join(words.select("lang", "w1", F.col("f").alias("l1")), ["lang", "w1"])
        .join(pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("r1")), ["lang", "w2", "w3"])
        .join(pairs.select("lang", "w1", "w2", F.col("f").alias("l2")), ["lang", "w1", "w2"])
        .join(words.select("lang", F.col("w1").alias("w3"), F.col("f").alias("r2")), ["lang", "w3"])
        .withColumn("s1", _score("a", "l1", "r1"))
        .withColumn("s2", _score("a", "l2", "r2"))
    )
    first = F.col("s1") <= F.col("s2")
    cut = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return found.select("lang", "w1", "w2", "w3", "a", cut("l1", "l2").alias("l"), cut("r1", "r2").alias("r"), F.least("s1", "s2").alias("score"))


def _levels(pairs: DataFrame, most: int) -> DataFrame:
    """(lang, level): the score that about `most` pairs reach, 0 where there are no more than that."""
    steps = pairs.groupBy("lang", "score").agg(F.count("*").alias("n"))
    reached = F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("score")))  # at most SCORE_SCALE steps a language
    filled = steps.withColumn("reached", reached)
    return filled.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("reached") >= most, F.col("score"))), F.lit(0).cast("long")).alias("level"))


def _survivors(pairs: DataFrame, triples: DataFrame, percent: int) -> DataFrame:
    """Candidates (lang, phrase, a, l, r, score) that no longer one swallows; `pairs` reach their language's level."""
    inside = [F.struct(F.col("w1").alias("w1"), F.col("w2").alias("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))]
    longer = triples.select("lang", "a", F.explode(F.array(*inside)).alias("p")).groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    kept = pairs.join(longer, ["lang", "w1", "w2"], "left").where(
        F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("longer") < F.lit(percent).cast("decimal(3,0)") * F.col("a"))
    )
    columns = ["a", "l", "r", "score"]
    return kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), *columns).union(
        triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), *columns)
    )


def collocations(documents: DataFrame, least: int = LEAST_COUNT, limit: int = LIMIT, swallow_percent: int = SWALLOW_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `limit` phrases of 2 to 3 words."""
    spark = documents.sparkSession
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counts = materialise(count_phrases(texts, 1), "words")
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = counts.where(F.col("f") >= least)
    hashed = lambda w: F.xxhash64("lang", w)
    frequent = spark.sparkContext.broadcast(build_filter(words.select(hashed("w1").alias("h"))))
    both = lambda h: frequent.value.holds(h[0]) & frequent.value.holds(h[1])
    pairs = materialise(count_phrases(texts, 2, both).where(F.col("f") >= least), "pairs")
    candidates = materialise(_pair_candidates(pairs, words), "pair-candidates")

    most = 2 * limit
    while True:
        levels = materialise(_levels(candidates, most), "levels")
        known = candidates.join(F.broadcast(levels) if levels.count() < 100_000 else levels, "lang")
        h = pair_hash(hashed("w1"), hashed("w2"))
        asked = known.where(F.col("score") >= F.col("level"))
        growing = build_filter(known.where(F.greatest("bound", "score") >= F.col("level")).select(h.alias("h")))
        swallowed = build_filter(asked.select(h.alias("h")))
        shared = spark.sparkContext.broadcast((growing, swallowed))

        def grown(h, shared=shared):
            before, after = shared.value
            return frequent.value.holds(h[2]) & (before.holds(_pair_hashes(h[0], h[1])) | after.holds(_pair_hashes(h[1], h[2])))

        triples = materialise(count_phrases(texts, 3, grown).where(F.col("f") >= least), "triples")
        shared.destroy()
        scored = _triple_candidates(triples, pairs, words)
        found = materialise(_survivors(asked.drop("bound", "level"), scored, swallow_percent), "survivors")
        reached = found.join(levels, "lang").where(F.col("score") >= F.col("level"))
        per = reached.groupBy("lang").agg(F.count("*").alias("kept"))
        open_ = levels.where(F.col("level") > 0).join(per, "lang", "left").where(F.coalesce("kept", F.lit(0)) < limit)
        if open_.isEmpty():
            break
        most *= 8
    frequent.destroy()
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = reached.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
