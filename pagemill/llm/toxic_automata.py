"""Toxicity by Levenshtein automata over a lexicon trie, hits weighed by their context.

The lexicon is learned: words that many labelled toxic texts hold and clean ones
do not. It is kept as a trie. For each different word of a text a Levenshtein
automaton walks the trie; a branch ends as soon as no state is alive, so
misspelled terms are found without comparing words in pairs. Around every hit a
window tells quotation from abuse: marks on both sides or a word of reporting
lower a hit's score, address of the reader raises it. The scores of a text's
hits make a few features, and a logistic model gives the probability.

The model is fitted on at most `texts` labelled texts of each class, chosen by a
hash of the text; texts that share their least shingle hash count once, so that
groups of copies do not make lexicon words. Class weights put the sample back
to the labels' proportions. Scoring reads every whole text, and nothing else.

Defined results: a null text is empty; a text without a hit has the probability
of such texts; labels that are null or have no document are ignored; without
labels of both classes the lexicon is empty and every text has the share of
label 1 among the labels (0 without any); of a document labelled both ways the
higher label counts; rows that repeat are returned as often as they come; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import map_rows, materialise

SAMPLE_TEXTS = 10_000
LEXICON_WORDS = 1_000
#: A lexicon word is in this share of the toxic texts at least, and so much likelier there.
LEAST_SHARE, LEAST_TEXTS, LEAST_RATIO = 0.02, 2, 10.0
LEAST_LENGTH, MOST_LENGTH = 3, 40
THRESHOLD = 0.7
#: Characters around a hit that are its context.
CONTEXT = 60
#: A task remembers so many words at most, and splits so many characters at once.
CACHE_WORDS, WINDOW_CHARS = 200_000, 1 << 20
QUOTED, REPORTED, MISSPELLED, ADDRESSED = 0.2, 0.5, 0.7, 1.5

_WORD = re.compile(r"[^\W_]+(?:[@$*][^\W_]+)*")
_OPEN, _CLOSE = re.compile("[\"“„«‘][^\"“”„«»‘’\n]*$"), re.compile("^[^\"“”„«»‘’\n]*[\"”“»’]")
# Words of reporting and of address, in the languages of the texts.
_REPORT = re.compile(r"\b(?:said|says|called|wrote|quoted|word|term|sagte|nannte|wort|dit|appelé|mot|dijo|llamó|palabra)\b")
_ADDRESS = re.compile(r"\b(?:you|your|you're|u|du|dich|dein|ihr|tu|toi|vous|eres|tú|usted)\b")
FEATURES = 4


def allowed(length: int) -> int:
    """Edits that a term of so many letters may have."""
    return 0 if length < 5 else 1 if length < 10 else 2


def pieces(term: str) -> list[str]:
    """One piece more than edits are allowed: a word within these edits holds one of them unchanged."""
    parts = allowed(len(term)) + 1
    cuts = [len(term) * i // parts for i in range(parts + 1)]
    return [term[a:b] for a, b in zip(cuts, cuts[1:])]


class Trie:
    """The lexicon by letters; each node knows the most edits that terms below it allow, and their lengths."""

    def __init__(self, words: list[str]) -> None:
        self.may_match = re.compile("|".join(sorted({re.escape(p) for w in words for p in pieces(w)})) or "(?!)").search
        self.shortest, self.longest = [MOST_LENGTH], [0]
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.edits = [0]
        for word in words:
            at = 0
            self.edits[0] = max(self.edits[0], allowed(len(word)))
            for c in word:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.term)
                    self.children.append({})
                    self.term.append(None)
                    self.edits.append(0)
                    self.shortest.append(MOST_LENGTH)
                    self.longest.append(0)
                at = self.children[at][c]
                self.edits[at] = max(self.edits[at], allowed(len(word)))
                self.shortest[at], self.longest[at] = min(self.shortest[at], len(word)), max(self.longest[at], len(word))
            self.term[at] = word

    def nearest(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest allowed term, the first by spelling of equal ones.

        Bit i of state[e] says that i letters of `word` can be read with e edits.
        """
        if not self.may_match(word):
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        full = 1 << len(word)
        most = self.edits[0]
        state = [1]
        for _ in range(most):
            state.append(state[-1] | state[-1] << 1)
        best: tuple[int, str] | None = None
        todo = [(0, state)]
        while todo:
            node, state = todo.pop()
            term = self.term[node]
            if term is not None:
                for e in range(allowed(len(term)) + 1):
                    if state[e] & full:
                        best = min(best or (e, term), (e, term))
                        break
            for c, child in self.children[node].items():
                if not self.shortest[child] - self.edits[child] <= len(word) <= self.longest[child] + self.edits[child]:
                    continue
                mask = masks.get(c, 0)
                after = [(state[0] & mask) << 1]
                for e in range(1, self.edits[child] + 1):
                    before = state[e - 1]
                    # read the letter, insert it, put another in its place, or leave out a letter of the word
                    after.append((state[e] & mask) << 1 | before | before << 1 | after[e - 1] << 1)
                after = [x & (full << 1) - 1 for x in after]
                if after[-1]:
                    todo.append((child, after))
        return best


class Finder:
    """Lexicon hits of texts; remembers a bounded number of words."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.trie = Trie(sorted(lexicon))
        self.known: dict[str, tuple[int, str] | None] = {}

    def _look_up(self, words: set[str]) -> dict[str, tuple[int, str]]:
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        for w in words.difference(self.known):
            self.known[w] = self.trie.nearest(w) if LEAST_LENGTH <= len(w) <= MOST_LENGTH else None
        return {w: hit for w in words if (hit := self.known[w])}

    def hits(self, text: str) -> tuple[list[tuple[str, int, float]], int]:
        """((term, edits, strength in its context) of each hit, number of words)."""
        low, at, out, count = text.lower(), 0, [], 0
        while at < len(low):
            end = min(at + WINDOW_CHARS, len(low))
            while end < len(low) and not low[end].isspace():
                end += 1
            words = _WORD.findall(low, at, end)
            count += len(words)
            found = self._look_up(set(words))
            if found:
                for m in _WORD.finditer(low, at, end):
                    hit = found.get(m[0])
                    if hit:
                        strength = self.lexicon[hit[1]] * MISSPELLED ** hit[0]
                        out.append((hit[1], hit[0], context_score(low, m.start(), m.end()) * strength))
            at = end
        return out, count

    def features(self, text: str) -> list[float]:
        found, count = self.hits(text)
        if not found:
            return [0.0] * FEATURES
        scores = [s for _, _, s in found]
        exact = [s for _, e, s in found if not e]
        return [
            min(1.0, max(exact, default=0.0)),
            float(np.log1p(sum(exact))),
            min(1.0, max(scores)) - min(1.0, max(exact, default=0.0)),
            float(np.sqrt(sum(scores) / count)),
        ]


def context_score(low: str, start: int, end: int) -> float:
    """1 for a bare term, less in quotation, more in address."""
    before, after = low[max(0, start - CONTEXT) : start], low[end : end + CONTEXT]
    score = 1.0
    if _OPEN.search(before) and _CLOSE.search(after):
        score *= QUOTED
    if _REPORT.search(before):
        score *= REPORTED
    if _ADDRESS.search(before) or _ADDRESS.search(after):
        score *= ADDRESSED
    return score


@dataclass
class Model:
    """Terms and their strengths, weights of the features, and what a text without a hit gets."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -30.0

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias by damped Newton steps; features raise the probability or are left out."""
    used = np.ones(x.shape[1], bool)
    while True:
        columns = np.c_[x[:, used], np.ones(len(x))]
        ridge = np.diag([decay] * int(used.sum()) + [1e-6])
        w = np.zeros(columns.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(columns @ w, -30, 30)))
            slope = columns.T @ (weight * (p - y)) + ridge @ w
            step = np.linalg.solve((columns * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ columns + ridge, slope)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        down = np.flatnonzero(used)[w[:-1] < 0]
        if not len(down):
            out = np.zeros(x.shape[1])
            out[used] = w[:-1]
            return out, float(w[-1])
        used[down] = False


def _texts(labelled: DataFrame) -> DataFrame:
    """(key, toxic, words): the different words of each text, and its least shingle hash."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keys, words = [], []
            for text in batch.column("text").to_pylist():
                found = _WORD.findall((text or "").lower())
                shingles = {" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))}
                keys.append(min(xxh64_intdigest(s) for s in shingles) - (1 << 63))
                words.append(sorted({w for w in found if LEAST_LENGTH <= len(w) <= MOST_LENGTH}))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column("toxic"), pa.array(words, pa.list_(pa.string()))], ["key", "toxic", "words"]
            )

        return work

    return map_rows(labelled, "key long, toxic int, words array<string>", make)


def _lexicon(labelled: DataFrame, size: int) -> dict[str, float]:
    """The words that mark toxic texts, at most `size`, each with its strength from 0 to 1.

    The strength is the squared share of the strongest word's log ratio.
    """
    texts = materialise(_texts(labelled).dropDuplicates(["key", "toxic"]), "toxic-words")
    n = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {}
    counts = texts.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")
    )
    ratio = ((F.col("t") + 0.5) / (n[1] + 1)) / ((F.col("c") + 0.5) / (n[0] + 1))
    found = counts.where((F.col("t") >= max(LEAST_TEXTS, LEAST_SHARE * n[1])) & (ratio >= LEAST_RATIO))
    terms = found.select("word", F.log(ratio).alias("log")).orderBy(F.desc("log"), "word").limit(size).collect()
    return {r.word: (r.log / terms[0].log) ** 2 for r in terms}


def fit(documents: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS, size: int = LEXICON_WORDS) -> Model:
    """The model of `labels(doc_id, toxic)` on the texts of `documents`."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    whole = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    # narrow rows choose the sample; texts are then picked in the scan's tasks
    rows = materialise(whole.select("doc_id", "hash").join(known, "doc_id").groupBy("hash", "toxic").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "toxic-labels")
    classes = {r.toxic: (r.texts, r.n) for r in rows.groupBy("toxic").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).collect()}
    model = Model()
    total = sum(n for _, n in classes.values())
    if len(classes) < 2:
        model.bias = 30.0 if classes.get(1) else -30.0
        return model
    share = {c: int((1 << 40) * min(1.0, texts / found)) for c, (found, _) in classes.items()}
    cut = F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    chosen = materialise(rows.where(F.pmod(F.xxhash64(F.lit("toxic"), "hash"), F.lit(1 << 40)) < cut), "toxic-chosen")
    picked = whole.join(F.broadcast(chosen), ["doc_id", "hash"])  # about 2 * `texts` narrow rows
    sample = materialise(picked.dropDuplicates(["hash", "toxic"]).select("text", "toxic", "n"), "toxic-sample")
    model.lexicon = _lexicon(sample.select("text", "toxic"), size)
    lexicon = model.lexicon

    def make():
        finder = Finder(lexicon)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [finder.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("n"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "n", "x"])

        return work

    # equal feature rows are added up: what comes back is bounded by the sample
    table = map_rows(sample, "toxic int, n long, x array<double>", make).groupBy("toxic", "x").agg(F.sum("n").alias("n")).toPandas()
    x, y, n = np.array(table["x"].tolist(), float).reshape(-1, FEATURES), table["toxic"].to_numpy(float), table["n"].to_numpy(float)
    for c in (0, 1):
        n[y == c] *= classes[c][1] / max(n[y == c].sum(), 1)
    order = np.lexsort((*x.T, y))  # the same sums on every run
    # the weights' decay counts against at most `texts` rows, however many labels there are
    model.weights, model.bias = logistic(x[order], y[order], n[order] * min(1.0, texts / total))
    return model


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most LEXICON_WORDS terms

    def make():
        finder = Finder(shared.value.lexicon)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = np.array([finder.features(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, FEATURES)
            chance = shared.value.probability(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(chance, pa.float64()), pa.array((chance >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

        return work

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, "doc_id long, score double, predicted int", make)
