"""Quality signals against plain Python, on hand-made and random texts."""

import random
import re
import statistics

import pytest
from pages import one_column
from pyspark.sql import functions as F

from pagemill.functions import quality as Q
from pagemill.functions.text import normalize_whitespace, remove_urls, strip
from pagemill.operators.quality import (
    enhanced_score,
    filter_paragraphs,
    filter_report,
    quality_score_enhanced,
    semantic_filter,
    semantic_quality,
)

RESEARCH = (
    "Researchers found that 35% of adults may show early signs. According to the study published in Nature, "
    "data shows significant effects among Older Adults in New York. Evidence suggests substantial differences!"
)
MENU = "Home | News | Sports\nView All\nTop 10\nMore\nNext\n12\nJan 5, 2024\n/rss/feed/"


def random_texts(n=150):
    rng = random.Random(3)
    words = (
        "Alpha beta GAMMA delta's über Élan 12 3.5 45% a1 2b rate Median extraordinary incomprehensible naïve "
        "data shows evidence suggests more Next top 10 View All | /rss/ ¹² x y z w q\x1cr Jan 5, 2024"
    ).split(" ")
    gaps = [" ", " ", " ", "  ", ". ", "! ", "?! ", "\n", "\n\n", " \n \n", ".", "\t"]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


TEXTS = [RESEARCH, MENU, "", " ", "Hi", "One. Two. Three. Four.", "...", "word " * 40, "a" * 80, "日本語 テキスト。 " * 10] + random_texts()


def py_sentences(text):
    counts = [len(piece.split()) for piece in re.split("[.!?]+", text)]
    counts = [c for c in counts if c]
    if len(counts) < 2:
        return 0.3
    return min(1.0, statistics.stdev(counts) / statistics.fmean(counts) / 0.7)


def py_vocabulary(text):
    tokens = [t for t in re.findall(r"\w+", text.lower()) if re.fullmatch("[a-z]{3,}", t)]
    if len(tokens) < 10:
        return 0.4
    share = len(set(tokens)) / len(tokens)
    return 0.2 if share < 0.3 else 1.0 if share > 0.7 else (share - 0.3) / 0.4


def py_density(text):
    words = text.split()
    if len(words) < 10:
        return 0.3
    tokens = re.findall(r"\w+", text)
    names = [w for piece in re.split("[.!?]+", text) for w in piece.split()[1:] if len(w) > 1 and w[:1].isupper()]
    points = 0.3 * any(re.fullmatch(r"\d+", t) for t in tokens) + 0.3 * (len(names) > 2)
    points += 0.2 * (sum(len(w) > 8 for w in words) * 10 > len(words))
    points += 0.2 * any(t.lower() in Q.STATISTICS_TERMS for t in tokens)
    return min(1.0, points)


def py_research(text):
    return min(1.0, sum(bool(re.search(p, text, re.I)) for p in Q.RESEARCH_PATTERNS) / 3)


def py_noise(text):
    filled = [line.strip() for line in text.split("\n") if line.strip()]
    noisy = [line for line in filled if any(re.search(p, line, re.I) for p in Q.NOISE_PATTERNS)]
    return 1.0 - len(noisy) / max(1, len(filled))


PLAIN = {
    "sentence_complexity": py_sentences,
    "vocabulary_richness": py_vocabulary,
    "information_density": py_density,
    "research_indicators": py_research,
    "noise_penalty": py_noise,
}


def py_score(text):
    if len(text.strip()) < 50:
        return 0.0
    return sum(PLAIN[n](text) * w for n, w in Q.WEIGHTS.items())


@pytest.mark.parametrize("name", PLAIN)
def test_signal_equals_plain_python(spark, name):
    got = one_column(spark, TEXTS, lambda c: Q.signals(c)[name])
    for text, value in zip(TEXTS, got):
        assert value == pytest.approx(PLAIN[name](text), abs=1e-9), repr(text)


def test_score_and_breakdown(spark):
    got = one_column(spark, TEXTS, Q.quality_score)
    for text, row in zip(TEXTS, got):
        assert row.score == pytest.approx(py_score(text), abs=1e-9)
        assert (row.noise_penalty is None) == (len(text.strip()) < 50)
    assert one_column(spark, TEXTS, Q.plain_score) == pytest.approx([r.score for r in got], abs=1e-12)


def test_known_texts(spark):
    good, bad = one_column(spark, [RESEARCH, MENU], Q.quality_score)
    assert good.score > 0.6 and good.research_indicators > 0.5 and good.information_density > 0.5
    assert bad.score < 0.5 and bad.noise_penalty < 0.5
    assert one_column(spark, [RESEARCH, MENU, "Hi", "", None], Q.is_quality) == [True, False, False, False, False]


def test_overlapping_research_phrases_both_count(spark):
    text = "according to the study shows. "
    assert one_column(spark, [text], Q.research_indicators) == pytest.approx([py_research(text)])


def test_paragraphs_and_report(spark):
    text = "\n\n".join([RESEARCH, "Top 10", RESEARCH.replace("35", "36"), "View All", ""])
    df = spark.createDataFrame([(0, text), (1, "Top 10"), (2, "")], "i int, text string")
    kept = {r.i: r.text for r in filter_paragraphs(df).collect()}
    assert kept == {0: RESEARCH + "\n\n" + RESEARCH.replace("35", "36"), 1: "", 2: ""}
    report = {r.i: r for r in filter_report(df).collect()}
    assert report[0].chars_kept == len(kept[0]) and report[0].share_kept == pytest.approx(len(kept[0]) / len(text))
    assert [report[i].emptied for i in range(3)] == [False, True, True]
    many = [t for t in TEXTS if "\n" in t]
    want = ["\n\n".join(p.strip() for p in re.split(r"\n\s*\n", t) if py_score(p.strip()) >= 0.3) for t in many]
    assert one_column(spark, many, lambda c: Q.keep_quality_paragraphs(c, 0.3)) == want


def test_whitespace_and_urls_equal_python(spark):
    url = r"(?:(?:https?|ftp)://|www\.)[a-zA-Z0-9\-._~:/?#@!$&'()*+,;=%]+"
    rng = random.Random(5)
    parts = ["(http://a.b/c)", "( www.x.y )", "[ftp://q]", "see", "(x (http://a/b))", "HTTPS://UP.CASE/", "( )", "[]", "  ", "\n \n", "\n\n\n", "\x1c", "end.", "www", "http://"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(200)]

    def clean(t):
        t = re.sub(rf"(?i)\(\s*{url}\s*\)", "", t)
        t = re.sub(rf"(?i)\[\s*{url}\s*\]", "", t)
        t = re.sub(rf"(?i){url}", "", t)
        for pattern, new in ((r"\(\s*\)", ""), (r"\[\s*\]", ""), (" {2,}", " "), (r"\n\s*\n", "\n\n")):
            t = re.sub(pattern, new, t)
        return t.strip()

    assert one_column(spark, texts, remove_urls) == [clean(t) for t in texts]
    want = [re.sub(" +", " ", re.sub(r"\n\s*\n+", "\n\n", t)).strip() for t in texts]
    assert one_column(spark, texts, normalize_whitespace) == want
    assert one_column(spark, ["　 a b \x85"], strip) == ["a b"]


def test_semantic_quality(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [-1.0, -1.0])], "vec_id long, embedding array<float>"
    )
    templates = spark.createDataFrame([([1.0, 1.0],), ([1.0, 0.0],)], "embedding array<float>")
    rows = {r.vec_id: r.semantic_quality for r in semantic_quality(df, templates).collect()}
    assert rows == {0: pytest.approx(1.0), 1: 0.0, 2: 0.5, 3: pytest.approx(-(2**-0.5))}
    assert {r.semantic_quality for r in semantic_quality(df).collect()} == {0.5}


def test_enhanced_score(spark):
    df = spark.createDataFrame([(0, RESEARCH, 0.8), (1, "Hi", 0.8), (2, RESEARCH, None)], "i int, text string, semantic_quality double")
    scores = {r.i: r.score for r in quality_score_enhanced(df).collect()}
    plain = py_score(RESEARCH)
    assert scores == {0: pytest.approx(0.9 * plain + 0.08), 1: pytest.approx(0.08), 2: pytest.approx(plain)}
    assert {r.i: r.score for r in quality_score_enhanced(df.drop("semantic_quality")).collect()}[1] == 0.0
    assert one_column(spark, ["Hi"], lambda c: enhanced_score(c, F.lit(1.0))) == [pytest.approx(0.1)]


def letter_model_factory():
    """A factory that travels by value: test modules are not on the workers' path."""

    def letter_model():
        import numpy as np

        def model(texts, max_length):
            tokens = [[[float(w.count(c)) for c in "abcdefghij"] for w in t.split()[:max_length]] or [[0.0] * 10] for t in texts]
            width = max(map(len, tokens))
            mask = np.array([[1] * len(t) + [0] * (width - len(t)) for t in tokens])
            return np.array([t + [[9.0] * 10] * (width - len(t)) for t in tokens]), mask

        return model

    return letter_model


def test_semantic_filter(spark):
    import numpy as np

    from pagemill.operators.embed import pooled
    from pagemill.operators.quality import QUALITY_TEMPLATES

    texts = [RESEARCH + "\n\nshort\n \n" + MENU, "", "single"]
    letter_model = letter_model_factory()
    keep = semantic_filter(0.5, letter_model)
    model = letter_model()

    def unit(v):
        return v / np.linalg.norm(v)

    against = [unit(v) for v in pooled(model, QUALITY_TEMPLATES, 128)]

    def score(p):
        v = unit(pooled(model, [p], 128)[0])
        return (0.9 * py_score(p)) + 0.1 * max(float(v @ a) for a in against)

    want = ["\n\n".join(p.strip() for p in re.split(r"\n\s*\n", t) if p.strip() and score(p.strip()) >= 0.5) for t in texts]
    assert one_column(spark, texts, keep) == want and want[0] == RESEARCH
