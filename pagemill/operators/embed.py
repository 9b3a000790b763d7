"""Embeddings: documents to vectors, and similarity as table operations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine_similarity

# Bytes of a matrix that may be sent to every task.
TEMPLATE_BYTES = 8 << 20


# --- documents to vectors -----------------------------------------------
def windows(text: str, max_length: int | None) -> list[str]:
    """The whole text in runs of at most `max_length` words; a text that is no longer stays as it is."""
    words = [] if max_length is None else list(re.finditer(r"\S+", text or ""))
    if max_length is None or len(words) <= max_length:
        return [text]
    runs = [words[i : i + max_length] for i in range(0, len(words), max_length)]
    return [text[run[0].start() : run[-1].end()] for run in runs]


def halves(text: str) -> list[str]:
    """A text in two, between words if it has several."""
    text = text.strip()
    words = list(re.finditer(r"\S+", text))
    cut = words[len(words) // 2].start() if len(words) > 1 else len(text) // 2
    return [text[:cut], text[cut:]]


def pooled(
    model: Callable, texts: list[str], max_length: int | None, single_window: bool = False, batch_size: int = 256
) -> np.ndarray:
    """Masked mean over the token vectors a model returns for all windows of each text.

    A window whose mask is full may have been cut by the model, as words can be
    several tokens: it is halved and asked again. With `single_window` each text
    is one window, and the model may cut it.
    """
    asked = [(i, w) for i, t in enumerate(texts) for w in ([t] if single_window else windows(t, max_length))]
    sums: list = [0.0] * len(texts)
    used = np.zeros(len(texts))
    while asked:
        again = []
        for start in range(0, len(asked), batch_size):
            part = asked[start : start + batch_size]
            tokens, mask = model([w for _, w in part], max_length)
            tokens, mask = np.asarray(tokens, dtype=np.float64), np.asarray(mask, dtype=np.float64)
            counts = mask.sum(axis=1)
            vectors = (tokens * mask[:, :, None]).sum(axis=1)
            for (i, window), count, vector in zip(part, counts.tolist(), vectors):
                full = not single_window and max_length is not None and count >= max_length
                if full and len(window.strip()) > 1:
                    again += [(i, half) for half in halves(window)]
                else:
                    sums[i] = sums[i] + vector
                    used[i] += count
        asked = again
    if (used == 0).any():
        raise ValueError("attention mask is all zeros")
    return np.array(sums) / np.clip(used, 1e-9, None)[:, None]


def word_counts(dimensions: int):
    """Arrow function: unit vectors of the counts of lists of words; each distinct word of a batch is hashed once."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def counts(words: pa.Array) -> pa.Array:
        coded = words.flatten().dictionary_encode()
        places = [int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16) % dimensions for w in coded.dictionary.to_pylist()]
        found = np.array(places, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = words.value_lengths().to_numpy(zero_copy_only=False)
        cells = np.repeat(np.arange(len(words)) * dimensions, lengths) + found
        matrix = np.bincount(cells, minlength=len(words) * dimensions).reshape(-1, dimensions).astype(np.float64)
        norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        flat = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dimensions, pa.int32()), pa.array(flat))

    return counts


def hashed_words(text: Column, dimensions: int) -> Column:
    """Unit vector of word counts; a word's place is the first 32 bits of its MD5, modulo the dimensions.

    Work grows with the words and not with words x dimensions.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return word_counts(dimensions)(words)


def embed_documents(
    df: DataFrame,
    model_factory: Callable | None = None,
    max_length: int | None = 128,
    batch_size: int = 256,
    dimensions: int = 256,
    single_window: bool = False,
) -> DataFrame:
    """Adds `embedding` for `text`.

    `model_factory()` runs once per worker and gives a callable
    (texts, max_length) -> (token vectors, mask).  A text is read in as many
    windows of `max_length` as it takes; `single_window` keeps only what the
    model reads of it at once.  Without a model, a hashed bag of words over the
    whole text is used.
    """
    if model_factory is None:
        return df.withColumn("embedding", hashed_words(F.col("text"), dimensions))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()
        for texts in batches:
            vectors: list[np.ndarray] = []
            for start in range(0, len(texts), batch_size):
                part = texts[start : start + batch_size].tolist()
                vectors.extend(pooled(model, part, max_length, single_window, batch_size))
            yield pd.Series(vectors)

    return df.withColumn("embedding", embed("text"))


# --- similarity ---------------------------------------------------------
def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero, so their cosine is 0."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def template_matrix(templates: DataFrame) -> np.ndarray:
    """The templates' `embedding` rows; they go to every task, so they must fit TEMPLATE_BYTES."""
    rows = templates.select("embedding").filter("embedding is not null")
    size = rows.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0] * 8
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates take {size} bytes, more than the {TEMPLATE_BYTES} that every task may get")
    return np.array([np.asarray(r.embedding, dtype=np.float64) for r in rows.collect()])


def best_similarity(vectors: np.ndarray):
    """Arrow function: greatest cosine of each embedding against `vectors`; null stays null."""
    against = unit_rows(vectors)

    @F.arrow_udf(T.DoubleType())
    def best(embeddings: pa.Array) -> pa.Array:
        there = embeddings.drop_null()
        values = np.full(len(embeddings), np.nan)
        if len(there):
            filled = embeddings.is_valid().to_numpy(zero_copy_only=False)
            values[filled] = (unit_rows(_matrix(there)) @ against.T).max(axis=1)
        return pa.array(values, pa.float64(), mask=np.isnan(values))

    return best


def similar_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds `similarity` to given pairs(left_id, right_id) of vectors(vec_id, embedding).

    Two equi-joins and one cosine for each pair; null where a vector is missing.
    """
    of = lambda side: vectors.select(F.col("vec_id").alias(f"{side}_id"), F.col("embedding").alias(f"_{side}"))
    both = pairs.join(of("left"), "left_id", "left").join(of("right"), "right_id", "left")
    return both.withColumn("similarity", cosine_similarity(F.col("_left"), F.col("_right"))).drop("_left", "_right")
