"""Prose quality signals as column expressions, all on the JVM.

Nearly every signal is a count of regular-expression matches over the whole
text, so no arrays of words are built; only the sentence statistics need one
short array per text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NON_WS, WS, let, strip

# Signal weights, in the order in which they are summed.
WEIGHTS = {
    "sentence_complexity": 0.2,
    "vocabulary_richness": 0.15,
    "information_density": 0.25,
    "research_indicators": 0.3,
    "noise_penalty": 0.1,
}

# Phrases of research prose.
RESEARCH_PATTERNS = [
    r"\bresearchers?\s+(?:found|discovered|showed|demonstrated)",
    r"\bstud(?:y|ies)\s+(?:show|showed|suggest|found|indicate)",
    r"\bscientists?\s+(?:found|discovered|believe|think)",
    r"\bevidence\s+suggests?",
    r"\baccording\s+to\s+(?:the\s+)?(?:study|research|scientists?|researchers?)",
    r"\bpublished\s+in\s+(?:the\s+)?",
    r"\bdata\s+(?:shows?|indicates?|suggests?)",
    r"\bfindings?\s+(?:show|showed|suggest|indicate)",
]

# Lines of navigation text (patterns apply to a stripped line).
NOISE_PATTERNS = [
    r"^(?:Top\s+\d+|View\s+All|More|Next|Previous|Read\s+More)\b",
    r"^\d+\s*$",
    r"^(?:\d{1,2}\s+)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}$",
    r"/(?:rss|feed|top|category|tag)/",
    r"\s*\|\s*",
]

# Terms of statistics.
STATISTICS_TERMS = ["million", "billion", "percent", "average", "median", "rate"]

MIN_SCORED_LENGTH = 50
DEFAULT_THRESHOLD = 0.6

# A word character is a letter, a number or the underscore; these stand for
# the two kinds of word boundary.
_WORD = r"[\p{L}\p{N}_]"
_BEGIN = rf"(?<!{_WORD})"
_END = rf"(?!{_WORD})"


def _portable(pattern: str) -> str:
    """Spell out `\\b`, `\\s` and `\\d` with their full Unicode meaning."""
    if pattern.startswith(r"\b"):
        pattern = _BEGIN + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + _END
    return pattern.replace(r"\s", WS).replace(r"\d", r"\p{Nd}")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def sentence_complexity(text: Column) -> Column:
    """Spread of sentence lengths: sample deviation over mean, over 0.7, in 0..1."""
    lengths = F.transform(
        F.split(text, "[.!?]+"), lambda s: _count(s, rf"(?U){NON_WS}+").cast("double")
    )
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def add(acc: Column, words: Column) -> Column:
        used = F.when(words > 0, 1.0).otherwise(0.0)
        return F.struct(
            (acc["n"] + used).alias("n"),
            (acc["s"] + words).alias("s"),
            (acc["q"] + words * words).alias("q"),
        )

    def finish(acc: Column) -> Column:
        n, s, q = acc["n"], acc["s"], acc["q"]
        variance = F.greatest(n * q - s * s, F.lit(0.0)) / (n * F.greatest(n - 1, F.lit(1.0)))
        return F.when(n < 2, 0.3).otherwise(
            F.least(F.lit(1.0), F.sqrt(variance) / (s / n) / 0.7)
        )

    return F.aggregate(lengths, zero, add, finish)


def vocabulary_richness(text: Column) -> Column:
    """Distinct share of words of three or more ASCII letters, piecewise."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"({_BEGIN}[a-z]{{3,}}{_END})"), F.lit(1))

    def score(w: Column) -> Column:
        ratio = F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))
        return (
            F.when(F.size(w) < 10, 0.4)
            .when(ratio < 0.3, 0.2)
            .when(ratio > 0.7, 1.0)
            .otherwise((ratio - 0.3) / 0.4)
        )

    return let(words, score)


def information_density(text: Column) -> Column:
    """Numbers 0.3, over two proper nouns 0.3, over 10% long words 0.2, statistics 0.2."""
    # patterns start with the rarest character they need and look back from there
    number = text.rlike(rf"\p{{Nd}}(?<!{_WORD}\p{{Nd}})\p{{Nd}}*+{_END}")
    # a capitalised word of two or more characters that follows another word
    # of the same sentence; look-around lets neighbours overlap
    inner = r"[^\s\x1c-\x1f.!?]"
    proper = _count(text, rf"(?U){WS}(?<={inner}{WS}){WS}*+(?=\p{{IsUppercase}}{inner})")
    words = F.split(strip(text), rf"(?U){WS}+")
    first = "".join(sorted({t[0] for t in STATISTICS_TERMS}))
    statistics = text.rlike(rf"(?iU)(?=[{first}]){_BEGIN}(?:{'|'.join(STATISTICS_TERMS)}){_END}")

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(0.0)

    def score(words: Column) -> Column:
        long_words = F.size(F.filter(words, lambda w: F.length(w) > 8))
        total = (
            points(number, 0.3)
            + points(proper > 2, 0.3)
            + points(long_words > F.size(words) * F.lit(0.1), 0.2)
            + points(statistics, 0.2)
        )
        return F.when(F.size(words) < 10, 0.3).otherwise(F.least(F.lit(1.0), total))

    return let(words, score)


def research_indicators(text: Column) -> Column:
    """Number of research phrases found, over three, at most one.

    One pass for all phrases: a look-ahead captures each phrase without
    consuming it, so overlapping ones count too.  The phrases differ in their
    first three letters, which therefore tell them apart.
    """
    phrases = "|".join(_portable(p).removeprefix(_BEGIN) for p in RESEARCH_PATTERNS)
    found = F.regexp_extract_all(text, F.lit(rf"(?iU){_BEGIN}(?=({phrases}))"), F.lit(1))
    # upper first: folds the odd letters that match without regard to case
    kinds = F.array_distinct(F.transform(found, lambda p: F.lower(F.upper(F.substring(p, 1, 3)))))
    return F.least(F.lit(1.0), F.size(kinds) / F.lit(3.0))


def noise_penalty(text: Column) -> Column:
    """One minus the share of non-blank lines that look like navigation.

    Lines are matched in place: multiline anchors with `\\n` as the only line
    end, and whitespace classes that cannot leave the line.  The two patterns
    that may match anywhere in a line are found by skipping, without ever
    going back, to its next pipe or slash.
    """
    inline = r"[\s\x1c-\x1f&&[^\n]]"
    anchored = []
    for pattern in NOISE_PATTERNS[:3]:
        p = _portable(pattern).replace(WS, inline).removeprefix("^")
        anchored.append(p[:-1] + rf"{inline}*$" if p.endswith("$") else p)
    path = NOISE_PATTERNS[3]
    anywhere = rf"[^\n|/]*+(?:(?!{path})/[^\n|/]*+)*+[|/]"
    noisy = rf"(?idmU)^(?:{inline}*+(?:{'|'.join(anchored)})|{anywhere})[^\n]*"
    filled = rf"(?U){NON_WS}[^\n]*"
    ratio = _count(text, noisy) / F.greatest(F.lit(1), _count(text, filled))
    return F.lit(1.0) - F.least(F.lit(1.0), ratio)


def signals(text: Column) -> dict[str, Column]:
    return {
        "sentence_complexity": sentence_complexity(text),
        "vocabulary_richness": vocabulary_richness(text),
        "information_density": information_density(text),
        "research_indicators": research_indicators(text),
        "noise_penalty": noise_penalty(text),
    }


def long_enough(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) >= MIN_SCORED_LENGTH, F.lit(False))


def weighted_sum(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, value in parts.items():
        total = total + value * F.lit(weights[name])
    return total


def quality_score(text: Column) -> Column:
    """Struct of the overall score and the five signals; signals are null for short text."""
    parts = F.struct(*[c.alias(n) for n, c in signals(text).items()])

    def combine(p: Column) -> Column:
        fields = {n: p[n] for n in WEIGHTS}
        return F.struct(
            weighted_sum(fields, WEIGHTS).alias("score"), *[c.alias(n) for n, c in fields.items()]
        )

    scored = let(parts, combine)
    empty = F.struct(
        F.lit(0.0).alias("score"), *[F.lit(None).cast("double").alias(n) for n in WEIGHTS]
    )
    return F.when(long_enough(text), scored).otherwise(empty)


def plain_score(text: Column) -> Column:
    """The overall score alone."""
    return F.when(long_enough(text), weighted_sum(signals(text), WEIGHTS)).otherwise(0.0)


def is_quality(text: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return plain_score(text) >= F.lit(threshold)


def keep_quality_paragraphs(text: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Quality paragraphs of a text, in order, joined by blank lines.

    Works inside the row: no paragraph leaves it, so nothing is shuffled.
    """
    paragraphs = F.transform(F.split(text, rf"(?U)\n{WS}*\n"), strip)
    return F.array_join(F.filter(paragraphs, lambda p: is_quality(p, threshold)), "\n\n")
