"""Quality filtering of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quality as Q
from ..functions.text import WS, strip
from .embed import best_similarity, pooled, template_matrix, unit_rows

# Sentences that stand for research prose.
QUALITY_TEMPLATES = [
    "Researchers conducted a comprehensive study analyzing the effects and implications.",
    "The scientific evidence demonstrates significant findings about the phenomenon.",
    "According to published research, the data indicates important correlations.",
    "Scientists discovered new insights through systematic investigation and analysis.",
]
NEUTRAL_SIMILARITY = 0.5


def filter_paragraphs(df: DataFrame, threshold: float = Q.DEFAULT_THRESHOLD) -> DataFrame:
    """Keep the quality paragraphs of `text`, in order."""
    return df.withColumn("text", Q.keep_quality_paragraphs(F.col("text"), threshold))


def filter_report(df: DataFrame, threshold: float = Q.DEFAULT_THRESHOLD) -> DataFrame:
    """Adds characters before and after filtering, share kept, and whether nothing stayed."""
    kept = F.length(Q.keep_quality_paragraphs(F.col("text"), threshold))
    out = df.withColumn("chars_before", F.length("text")).withColumn("chars_kept", kept)
    share = F.when(F.col("chars_before") > 0, F.col("chars_kept") / F.col("chars_before")).otherwise(0.0)
    return out.withColumn("share_kept", share).withColumn("emptied", F.col("chars_kept") == 0)


def semantic_quality(df: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Adds `semantic_quality`: greatest cosine of `embedding` against the templates.

    0.5 where there is no embedding, or no templates at all.
    """
    vectors = np.empty((0, 0)) if templates is None else template_matrix(templates)
    if not len(vectors):
        return df.withColumn("semantic_quality", F.lit(NEUTRAL_SIMILARITY))
    best = best_similarity(vectors)(F.col("embedding"))
    return df.withColumn("semantic_quality", F.coalesce(best, F.lit(NEUTRAL_SIMILARITY)))


def enhanced_score(text: Column, semantic: Column) -> Column:
    """Five signals x 0.9 plus 0.1 x semantic; the plain score where semantic is null.

    Short text has no signals, so there only the semantic part counts.
    """
    weights = {n: w * 0.9 for n, w in Q.WEIGHTS.items()}
    five = F.when(Q.long_enough(text), Q.weighted_sum(Q.signals(text), weights)).otherwise(0.0)
    return F.when(semantic.isNull(), Q.plain_score(text)).otherwise(five + semantic * F.lit(0.1))


def quality_score_enhanced(df: DataFrame) -> DataFrame:
    """Adds `score` from `text` and, when the column is there, `semantic_quality`; with the five signals.

    The signals are null for short text, as in `quality_score`.
    """
    plain = df.withColumn("_quality", Q.quality_score(F.col("text")))
    parts = [F.col(f"_quality.{n}").alias(n) for n in Q.WEIGHTS]
    score, semantic = F.col("_quality.score"), F.col("semantic_quality")
    if "semantic_quality" in df.columns:
        score = F.when(semantic.isNull(), score).otherwise(score * F.lit(0.9) + semantic * F.lit(0.1))
    return plain.select(*df.columns, score.alias("score"), *parts)


def heuristic_filter(threshold: float) -> Callable[[Column], Column]:
    return lambda text: Q.keep_quality_paragraphs(text, threshold)


def semantic_filter(
    threshold: float,
    model_factory: Callable,
    templates: Sequence[str] = QUALITY_TEMPLATES,
    max_length: int | None = 128,
    single_window: bool = False,
) -> Callable[[Column], Column]:
    """Paragraph filter by the enhanced score.

    One vectorised step scores all paragraphs of a batch of texts against the
    templates, with the model loaded once per task; the rest is column work
    inside the row. Paragraphs are read in windows of `max_length`, whole unless
    `single_window` is set.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def similarities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_factory()
        against = unit_rows(pooled(model, list(templates), max_length, single_window))
        for paragraphs in batches:
            lists = [p or [] for p in paragraphs.to_pylist()]
            flat = [p for ps in lists for p in ps]
            best = [np.empty(0)]
            for start in range(0, len(flat), 256):
                vectors = unit_rows(pooled(model, flat[start : start + 256], max_length, single_window))
                best.append((vectors @ against.T).max(axis=1))
            ends = np.cumsum([0] + [len(ps) for ps in lists])
            values = pa.array(np.concatenate(best), pa.float64())
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    def apply(text: Column) -> Column:
        split = F.filter(F.transform(F.split(text, rf"(?U)\n{WS}*\n"), strip), lambda p: p != "")
        scored = F.arrays_zip(split.alias("p"), similarities(split).alias("s"))
        good = F.filter(scored, lambda z: enhanced_score(z["p"], z["s"]) >= threshold)
        return F.array_join(F.transform(good, lambda z: z["p"]), "\n\n")

    return apply

