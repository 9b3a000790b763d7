"""Personal data by rules and by a semi-Markov conditional random field.

Rules give the base spans. Around every cluster of characters that personal
data are made of, a text is cut into tokens, and the field chooses segments of
at most `MAX_TOKENS` tokens and their types together: each segment is scored
from features of the whole span (its shape, length, number of digits and
groups, the words before and after it), the neighbouring types add a
transition, and bounded-entity dynamic programming finds the best segmentation.
It is trained by maximum likelihood, with the forward-backward sums over
segmentations, on a bounded sample of the regions of all documents labelled by the
rules. What it finds apart from the base spans is added if a type's minimum of
digits or marks is there and the span's posterior is high.

Defined results: a null text is empty; a text without such characters has no
spans; without labelled regions in the whole table nothing is added; repeated rows
are returned as often as they come; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, map_rows
from .spans import Span, add_apart, digest, joined

KINDS = ("email", "ip", "card", "phone")
TYPES = ("other", *KINDS)
#: Longest segment of personal data, in tokens.
MAX_TOKENS = 24
#: Regions that training reads at most.
SAMPLE_REGIONS = 300
POSTERIOR = 0.9
HASHED = 1 << 12
#: Tokens in one region; a longer cluster is cut into regions that overlap by the longest segment.
REGION_TOKENS = 160

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CUE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def rule_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that hold its test."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, start = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                    out.append(("ip", start, end))
                start = end + 1
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Tokens of each cluster of digits and at-signs with some words around it."""
    spots = [m.start() for m in _CUE.finditer(text)]
    if not spots:
        return
    clusters = [[spots[0], spots[0]]]
    for s in spots[1:]:
        if s - clusters[-1][1] <= 24:
            clusters[-1][1] = s
        else:
            clusters.append([s, s])
    for first, last in clusters:
        left, right = max(0, first - 40), min(len(text), last + 41)
        tokens = [m.span() for m in _TOKEN.finditer(text, left, right)]
        for i in range(0, max(1, len(tokens) - MAX_TOKENS), REGION_TOKENS - MAX_TOKENS):
            yield tokens[i : i + REGION_TOKENS]


def _hash(*parts) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) % HASHED


def _shape(span: str) -> str:
    kinds = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "0", span))
    return kinds if len(kinds) <= 24 else kinds[:24]


def span_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Hashed features of the whole span of tokens i to j - 1 and of its neighbours."""
    span = text[tokens[i][0] : tokens[j - 1][1]]
    digits = sum(c.isdigit() for c in span)
    before = text[tokens[i - 1][0] : tokens[i - 1][1]] if i else "^"
    after = text[tokens[j][0] : tokens[j][1]] if j < len(tokens) else "$"
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    return [
        _hash("bias"),
        _hash("shape", _shape(span)),
        _hash("digits", min(digits, 20), "@" in span),
        _hash("ends", span[0].isdigit(), span[0].isalpha(), span[-1].isdigit(), span[-1].isalpha(), span[0] == "+"),
        _hash("groups", len(groups), max(groups, default=0), span.count("."), span.count("@")),
        _hash("before", before if not before.isalnum() else "a" if before.isalpha() else "0"),
        _hash("after", after if not after.isalnum() else "a" if after.isalpha() else "0"),
        _hash("small", bool(groups) and max(map(int, (g[:6] for g in re.findall(r"[0-9]+", span)))) <= 255, len(groups)),
        _hash("luhn", 13 <= digits <= 19 and luhn("".join(c for c in span if c.isascii() and c.isdigit()) or "1")),
    ]


def may_be_entity(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> bool:
    """Whether a segment can be personal data: no break at an end, and an at-sign or enough digits."""
    start, end = tokens[i][0], tokens[j - 1][1]
    if text[start].isspace() or text[end - 1].isspace() or not (text[start].isalnum() or text[start] in "+("):
        return False
    if not text[end - 1].isalnum():
        return False
    span = text[start:end]
    if "\n" in span:
        return False
    return span.count("@") == 1 or sum(c.isdigit() for c in span) >= 6


class SemiMarkov:
    """Weights of span features by type and of neighbouring types; type 0 has segments of one token."""

    def __init__(self) -> None:
        self.weights = np.zeros((len(TYPES), HASHED))
        self.moves = np.zeros((len(TYPES), len(TYPES)))

    def lattice(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, list[int]]]:
        """(start, end, type class, features) of all segments: 0 for one other token, 1 for any entity."""
        out = []
        for i in range(len(tokens)):
            out.append((i, i + 1, 0, span_features(text, tokens, i, i + 1)))
            for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
                if may_be_entity(text, tokens, i, j):
                    out.append((i, j, 1, span_features(text, tokens, i, j)))
        return out

    def _scores(self, lattice) -> list[np.ndarray]:
        return [self.weights[0:1, f].sum(axis=1) if kind == 0 else self.weights[1:, f].sum(axis=1) for _, _, kind, f in lattice]

    def sums(self, lattice, n: int):
        """Log forward and backward sums by position and type, and the scores."""
        scores = self._scores(lattice)
        t = len(TYPES)
        forward, backward = np.full((n + 1, t), -np.inf), np.full((n + 1, t), -np.inf)
        forward[0, 0] = 0.0
        backward[n, :] = 0.0
        for (i, j, kind, _), s in sorted(zip(lattice, scores), key=lambda x: x[0][0]):
            inward = np.logaddexp.reduce(forward[i][:, None] + self.moves, axis=0)
            types = slice(0, 1) if kind == 0 else slice(1, t)
            forward[j, types] = np.logaddexp(forward[j, types], inward[types] + s)
        for (i, j, kind, _), s in sorted(zip(lattice, scores), key=lambda x: -x[0][1]):
            types = slice(0, 1) if kind == 0 else slice(1, t)
            out = np.logaddexp.reduce(self.moves[:, types] + (s + backward[j, types]), axis=1)
            backward[i] = np.logaddexp(backward[i], out)
        return forward, backward, scores

    def marginals(self, lattice, n: int):
        """Posterior of every segment by type, expected moves, and the log of the normaliser."""
        forward, backward, scores = self.sums(lattice, n)
        whole = np.logaddexp.reduce(forward[n])
        out, moved = [], np.zeros_like(self.moves)
        for (i, j, kind, _), s in zip(lattice, scores):
            types = slice(0, 1) if kind == 0 else slice(1, len(TYPES))
            joint = np.exp(forward[i][:, None] + self.moves[:, types] + s + backward[j, types] - whole)
            moved[:, types] += joint
            out.append(joint.sum(axis=0))
        return out, moved, whole

    def fit(self, data: list[tuple[str, list[tuple[int, int]], list[Span]]], rounds: int = 5, rate: float = 0.15, decay: float = 1e-4) -> None:
        """Stochastic gradient steps (per-weight rates) on the log-likelihood of labelled regions."""
        squares, move_squares = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        prepared = []
        for text, tokens, gold in data:
            lattice = self.lattice(text, tokens)
            place = {a: i for i, (a, _) in enumerate(tokens)} | {b: i + 1 for i, (_, b) in enumerate(tokens)}
            wanted = {(place[a], place[b]): TYPES.index(k) for k, a, b in gold if a in place and b in place}
            known = {(i, j): f for i, j, kind, f in lattice if kind == 1}
            if not wanted.keys() <= known.keys():
                continue
            path, at = [], 0
            starts = {i: (j, k) for (i, j), k in wanted.items()}
            while at < len(tokens):
                j, k = starts.get(at, (at + 1, 0))
                path.append((at, j, k))
                at = j
            prepared.append((lattice, len(tokens), path))
        for _ in range(rounds):
            for lattice, n, path in prepared:
                posterior, moved, _ = self.marginals(lattice, n)
                grad_moves, held = -moved, 0
                grads: dict[tuple[int, int], float] = {}
                gold = set(path)
                for _, _, k in path:
                    grad_moves[held, k] += 1
                    held = k
                for (i, j, kind, features), p in zip(lattice, posterior):
                    for at, value in enumerate(p.tolist()):
                        k = at if kind == 0 else at + 1
                        g = ((i, j, k) in gold) - value
                        if abs(g) > 1e-4:
                            for f in features:
                                grads[k, f] = grads.get((k, f), 0.0) + g
                if grads:
                    rows, columns = (np.array(x) for x in zip(*grads))
                    g = np.array(list(grads.values())) - decay * self.weights[rows, columns]
                    squares[rows, columns] += g * g
                    self.weights[rows, columns] += rate * g / np.sqrt(squares[rows, columns])
                move_squares += grad_moves**2
                self.moves += rate * grad_moves / np.sqrt(move_squares)

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[Span, float]]:
        """The best segmentation's entities with their posteriors."""
        n, t = len(tokens), len(TYPES)
        lattice = self.lattice(text, tokens)
        if not any(kind for _, _, kind, _ in lattice):
            return []
        scores = self._scores(lattice)
        value, back = np.full((n + 1, t), -np.inf), {}
        value[0, 0] = 0.0
        for at in sorted(range(len(lattice)), key=lambda x: lattice[x][0]):
            i, j, kind, _ = lattice[at]
            inward = value[i][:, None] + self.moves
            came, best = inward.argmax(axis=0), inward.max(axis=0)
            for k in (0,) if kind == 0 else range(1, t):
                v = best[k] + scores[at][k if kind == 0 else k - 1]
                if v > value[j, k]:
                    value[j, k], back[j, k] = v, (i, int(came[k]), at)
        found, j, k = [], n, int(value[n].argmax())
        while j > 0:
            i, before, at = back[j, k]
            if k:
                found.append((at, (TYPES[k], tokens[i][0], tokens[j - 1][1])))
            j, k = i, before
        if not found:
            return []
        posterior, _, _ = self.marginals(lattice, n)
        return [(span, float(posterior[at][KINDS.index(span[0])])) for at, span in reversed(found)]


def labelled_regions(documents: DataFrame) -> DataFrame:
    """(text, found, hash): each region with its rule spans as kind:start:end."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, found = [], []
            for text in batch.column("text").to_pylist():
                spans = rule_spans(text) if text and _CUE.search(text) else []
                for tokens in regions(text or ""):
                    if not tokens:
                        continue
                    left, right = tokens[0][0], tokens[-1][1]
                    inside = [(k, a - left, b - left) for k, a, b in spans if a >= left and b <= right]
                    texts.append(text[left:right])
                    found.append(joined(inside, KINDS))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(found, pa.string())], ["text", "found"])

        return work

    return map_rows(documents.select("text"), "text string, found string", make)


def fit(documents: DataFrame, most: int = SAMPLE_REGIONS) -> SemiMarkov | None:
    """The field, trained on at most `most` labelled regions; None if there is none with personal data."""
    rows = least_hashed(labelled_regions(documents), "text", F.col("found") == "", most)
    data = []
    for row in rows.orderBy(F.col("found") == "", F.xxhash64("text"), "text").limit(most).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in row.found.split(",") if x)]
        kept, end = [], 0
        for span in sorted(spans, key=lambda s: (s[1], -s[2])):
            if span[1] >= end:
                kept.append(span)
                end = span[2]
        data.append((row.text, [m.span() for m in _TOKEN.finditer(row.text)][:REGION_TOKENS], kept))
    if not any(found for _, _, found in data):
        return None
    field = SemiMarkov()
    field.fit(data)
    return field


def find_spans(text: str, field: SemiMarkov | None, posterior: float = POSTERIOR) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text."""
    if not _CUE.search(text):
        return [], []
    base = rule_spans(text)
    more: list[Span] = []
    if field is not None:
        for tokens in regions(text):
            inside = [(a, b) for _, a, b in base if a < tokens[-1][1] and b > tokens[0][0]]
            rest = "".join(text[a:b] for a, b in tokens if not any(x <= a and b <= y for x, y in inside))
            if sum(c.isdigit() for c in rest) < 6 and "@" not in rest:
                continue  # nothing is left that a segment could be made of
            more += [s for s, p in field.best(text, tokens) if p >= posterior]
    return base, add_apart(base, sorted(set(more), key=lambda s: s[1]))


def find_pii(documents: DataFrame, field: SemiMarkov | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text."""
    field = field or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [find_spans(t or "", shared.value) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([digest(b, KINDS) for b, _ in found], pa.string()), pa.array([joined(s, KINDS) for _, s in found], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

        return work

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)
