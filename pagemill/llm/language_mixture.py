"""Language identification as a mixture of languages, by expectation-maximisation.

Each language is a multinomial over hashed character trigrams, counted over all
training documents. A document's language proportions maximise the likelihood
of its trigrams; the set of languages is that with the best likelihood less a
penalty for each further language. The prediction is the largest proportion.

Defined results: a text that is null or has no letter is `und` with score 0, as
is every text when nothing was learned; equal proportions go to the smaller
name; a document without doc_id is not held out and teaches nothing; repeated
rows teach and are returned as often as they come; an empty table gives an
empty table; columns beyond the named ones are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise

BUCKETS = 1 << 15
HELD_OUT_FOLDS = 5
SMOOTHING = 0.5
#: Log-likelihood that a further language must bring, times the log of the number of trigrams.
PENALTY = 3.0
#: Proportion below which a language is left out of the sets that are tried.
LEAST_SHARE = 0.05
ROUNDS = 40
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Bucket of every trigram of a text's letters, runs of other characters being one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    chars = np.where(letter, points, 32)
    chars = chars[letter | np.r_[True, letter[:-1]]]
    chars = np.concatenate(([32] if chars[0] != 32 else [], chars, [32] if chars[-1] != 32 else [])).astype(np.uint32)
    mixed = (chars[:-2] * np.uint32(0x9E3779B1) + chars[1:-1]) * np.uint32(0x85EBCA6B) + chars[2:]
    mixed *= np.uint32(0xC2B2AE35)
    return (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_FOLDS


def trigram_counts(training: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of `training(lang, text)`, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if text.is_valid and len(found := trigrams(text.as_py())):
                    held = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    held += np.bincount(found, minlength=BUCKETS)
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(held[at])], ["lang", "bucket", "n"])

    found = training.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities, learned outside the held-out fold.

    The model is languages times BUCKETS numbers, whatever the number of documents.
    """
    training = documents.where((_fold() != 0) & F.col("lang").isNotNull())
    rows = materialise(trigram_counts(training), "trigrams").toPandas()
    names = sorted(rows["lang"].unique().tolist())
    counts = np.zeros((len(names), BUCKETS))
    place = {n: i for i, n in enumerate(names)}
    counts[rows["lang"].map(place).to_numpy(np.int64), rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    total = counts.sum(axis=1, keepdims=True)
    return names, (counts + SMOOTHING) / (total + SMOOTHING * BUCKETS)


def _maximise(likely: np.ndarray, weight: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages of `likely` (languages x trigrams) and the log-likelihood."""
    total = weight.sum()
    for _ in range(ROUNDS):
        joint = share @ likely
        new = share * (likely @ (weight / joint)) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(weight @ np.log(share @ likely))


def proportions(found: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """Proportion of each language in a document with trigrams `found`."""
    at, weight = np.unique(found, return_counts=True)
    weight = weight.astype(np.float64)
    here = likely[:, at]
    here = here / here.max(axis=0)
    k = len(likely)
    share, _ = _maximise(here, weight, np.full(k, 1.0 / k))
    order = np.argsort(-share, kind="stable")
    tried = [int(i) for i in order if share[i] >= LEAST_SHARE] or [int(order[0])]
    best, out = -np.inf, None
    penalty = PENALTY * np.log(weight.sum() + 1.0)
    for size in range(1, len(tried) + 1):
        chosen = tried[:size]
        part = share[chosen] / share[chosen].sum()
        if size == 1:
            value = float(weight @ np.log(here[chosen[0]]))
        else:
            part, value = _maximise(here[chosen], weight, part)
        value -= penalty * (size - 1)
        if value > best:
            best, out = value, (chosen, part)
    result = np.zeros(k)
    result[out[0]] = out[1]
    return result


def identify(documents: DataFrame, full: bool = True) -> DataFrame:
    """Adds lang_pred and score to (doc_id, held_out); with `full` also lang_shares, a map."""
    names, likely = fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(likely)
    more = ", lang_shares map<string,double>" if full else ""

    def make():
        model = shared.value

        def row(text: str | None) -> tuple[str, float, list]:
            found = trigrams(text) if text else ()
            if not len(found) or not names:
                return UNKNOWN, 0.0, []
            share = proportions(found, model)
            top = int(np.argmax(share))
            return names[top], float(min(share[top], 1.0)), [(n, float(s)) for n, s in zip(names, share) if s > 0]

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = [row(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
            if full:
                columns.append(pa.array([r[2] for r in rows], pa.map_(pa.string(), pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "lang_shares"][: len(columns)])

        return work

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "text")
    return map_rows(rows, f"doc_id long, held_out boolean, lang_pred string, score double{more}", make)


def keep_identified(documents: DataFrame, least_share: float = 0.5) -> DataFrame:
    """Documents of which one language makes up at least `least_share`.

    Goes: texts without letters and texts in which no language dominates.
    """
    names, likely = fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(likely)

    def keeps(text: str | None) -> bool:
        found = trigrams(text) if text else ()
        return bool(len(found)) and bool(names) and float(proportions(found, shared.value).max()) >= least_share

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield batch.filter(pa.array([keeps(t.as_py()) for t in batch.column("text")], pa.bool_()))

        return work

    return map_rows(documents, documents.schema, make)
