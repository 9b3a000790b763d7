"""Hard negatives, phrase growth and toxicity against plain versions, and on awkward rows."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.llm import hard_negatives, phrase_growth, toxic_automata
from test_operators import AWKWARD, docs

VECTORS = "vec_id long, embedding array<double>, label int, score string, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], VECTORS)


def plain_negatives(rows, every):
    good = [
        (i, [math.floor(256 * x) for x in v], y)
        for i, v, y in rows
        if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, v, y in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in good if j != i and len(w) == len(v))
        for p, j, z in [s for s in scored if s[2] == y][:5]:
            window = [(s, k) for s, k, l in scored if l != y and -80 * p <= -100 * s <= -100 * p][:5]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(window)]
    return sorted(out)


class TestHardNegatives:
    def test_against_all_scores(self, spark):
        rng = random.Random(5)
        rows = [(i, [rng.random() for _ in range(8)], rng.randrange(3)) for i in range(300)]
        rows += [(300 + i, rows[0][1], i % 3) for i in range(40)]  # ties
        found = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
        assert sorted(map(tuple, found)) == plain_negatives(rows, 20)

    def test_awkward_rows(self, spark):
        rows = [
            (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.9, 0.5], 2), (2, [0.9, 0.5], 2),
            (3, None, 1), (4, [], 1), (5, [1.0, None], 2), (6, [float("nan"), 1.0], 2), (7, [1.0, float("inf")], 2),
            (None, [1.0, 1.0], 2), (8, [1.0, 1.0], None), (20, [-1.0, -1.0], 3), (9, [1.0, 0.5, 0.1], 2),
        ]
        found = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
        assert sorted(map(tuple, found)) == plain_negatives(rows, 20)

    def test_empty_table(self, spark):
        assert hard_negatives.mine(vectors(spark, []), F.col("vec_id") % 20 == 0).collect() == []


def plain_phrases(rows, least=10, limit=2000, percent=50):
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang, _ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= percent * a and (q[:2] == p or q[1:] == p) for q, b in f.items()):
                continue
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(found)[:limit]):
            out.append((lang, r + 1, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def phrase_rows(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["É", "new york city", "a\tb", "Odd!word"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None, "und"]), "s") for i in range(n)]


class TestPhrases:
    @pytest.mark.parametrize("limit", [3, 40, 2000])
    def test_against_all_counts(self, spark, limit):
        rows = [*phrase_rows(limit), *AWKWARD]
        found = phrase_growth.collocations(docs(spark, rows), limit=limit).collect()
        assert sorted(map(tuple, found)) == plain_phrases(rows, limit=limit)

    def test_levels_are_lowered(self, spark):
        """All the best pairs are swallowed by triples, so that the first level settles nothing."""
        rows = [(i, ". ".join(f"a{j} b{j} c{j}" for j in range(40)) + ". x y", "en", "s") for i in range(12)]
        found = phrase_growth.collocations(docs(spark, rows), limit=41).collect()
        assert sorted(map(tuple, found)) == plain_phrases(rows, limit=41)

    def test_cuts_of_tasks_and_windows(self, spark, monkeypatch):
        """Phrases over the borders of chunks and windows are counted once."""
        rows = phrase_rows(9, 60)
        for size in (1, 2, 3):
            whole = phrase_growth.count_phrases(docs(spark, rows).na.fill("und", ["lang"]), size).collect()
            parts = collections.Counter()
            with monkeypatch.context() as m:
                m.setattr(phrase_growth, "CHUNK_WORDS", 5)
                m.setattr(phrase_growth, "WINDOW_BYTES", 7)
                small = phrase_growth.count_phrases
                parts.update({tuple(r[:-1]): r.f for r in small(docs(spark, rows).na.fill("und", ["lang"]), size).collect()})
            assert parts == collections.Counter({tuple(r[:-1]): r.f for r in whole})

    def test_windows(self, monkeypatch):
        monkeypatch.setattr(phrase_growth, "WINDOW_BYTES", 7)
        text = "aa bb. cc\n\ndddddddddddddd é  f".encode()
        found = [w for part in phrase_growth._windows(text) for w in part if w]
        assert found == [b"aa", b"bb", b"\n", b"cc", b"\n", b"\n", b"dddddddddddddd", "é".encode(), b"f"]

    def test_empty_table(self, spark):
        assert phrase_growth.collocations(docs(spark, [])).collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        after = [i + 1]
        for j, y in enumerate(b):
            after.append(min(row[j] + (x != y), row[j + 1] + 1, after[j] + 1))
        row = after
    return row[-1]


ABUSE = ["moron", "pathetic", "worthless"]


def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        words = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(20)]
        if i % 3 == 0:
            words[rng.randrange(20)] = ABUSE[i // 3 % 3]
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, int(i % 3 == 0)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


class TestToxic:
    def test_automaton_equals_edit_distance(self):
        rng = random.Random(1)
        hits = 0
        for _ in range(3000):
            terms = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(3, 12))) for _ in range(4)})
            word = "".join(rng.choice("ab" if rng.random() < 0.95 else "c") for _ in range(rng.randint(3, 13)))
            near = [(edits(word, t), t) for t in terms if edits(word, t) <= toxic_automata.allowed(len(t))]
            hits += bool(near)
            assert toxic_automata.Trie(terms).nearest(word) == min(near, default=None)
        assert hits > 100

    def test_context(self):
        def of(text):
            at = text.index("moron")
            return toxic_automata.context_score(text, at, at + 5)

        bare = of("a moron here")
        assert of('the text had "moron" in it') < bare < of("you moron")
        assert of("they said moron once") < bare

    def test_held_out(self, spark):
        rows, labels = labelled(spark)
        model = toxic_automata.fit(docs(spark, rows), labels.where("doc_id < 200"))
        assert set(ABUSE) <= set(model.lexicon)
        found = {r.doc_id: r for r in toxic_automata.score(docs(spark, rows), model).collect()}
        assert all(found[i].predicted == int(i % 3 == 0) for i in range(200, 300))
        assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in found.values())

    def test_awkward_rows(self, spark):
        rows, labels = labelled(spark)
        table = docs(spark, [*((r[0] + 1000, *r[1:]) for r in rows), *AWKWARD, (50, "x " * 90_000 + " moron", "en", "a")])
        odd = spark.createDataFrame([(None, 1), (1, None), (99_999, 1), (1, 2), (1000, 1), (1000, 0)], "doc_id long, toxic int")
        model = toxic_automata.fit(table, labels.select((F.col("doc_id") + 1000).alias("doc_id"), "toxic").union(odd))
        found = toxic_automata.score(table, model).collect()
        assert len(found) == table.count()
        assert {r.predicted for r in found if r.doc_id == 50} == {1}
        assert len({r.score for r in found if r.doc_id in (1, 2, 3)}) == 1

    def test_without_labels(self, spark):
        table = docs(spark, AWKWARD)
        none = spark.createDataFrame([], "doc_id long, toxic int")
        for labels, predicted in ((none, 0), (spark.createDataFrame([(4, 1)], none.schema), 1)):
            found = toxic_automata.score(table, toxic_automata.fit(table, labels)).collect()
            assert len(found) == len(AWKWARD) and {r.predicted for r in found} == {predicted}
        assert toxic_automata.score(docs(spark, []), toxic_automata.fit(docs(spark, []), none)).collect() == []
