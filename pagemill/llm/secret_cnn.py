"""Secret scans: a character convolutional network over every candidate and its context.

Rules give the base findings. Candidates for more are all runs of 16 or more
characters that a key can be made of. A small network in NumPy reads a window
over the candidate and what stands around it, marks which characters are the
candidate's, and gives a probability. It is trained on all distinct windows of all
documents: rule findings against the other candidates, both classes weighing the
same, with the words around half of the findings replaced, so that a key counts as one
without its label beside it. The windows are dealt to shards by their hash; in each
round every shard trains from the same weights, and the mean of what they reach
starts the next round. Scores are calibrated on all windows of held-out keys (Platt
scaling), and the threshold is one that keeps the wanted recall there.

Long candidates are read in overlapping windows, and the best one counts.

Defined results: a null text is empty; a text without candidates has no spans;
with fewer than LEAST_WINDOWS windows of either class in the whole table nothing
is added to the rules, and a warning says so;
repeated rows are returned as often as they come; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialise
from .spans import Span, add_apart, blanked, digest, joined

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key")
#: Windows of each class that training needs.
LEAST_WINDOWS = 10
#: Windows, about, that one task trains on between two means, rounds, and shards whose mean one task takes.
SHARD_WINDOWS, ROUNDS, MEAN_OF = 4_096, 8, 64
RECALL = 0.99
#: Characters of context before and after, and of a candidate, in one window.
CONTEXT, INSIDE = 24, 48
WIDTH = 2 * CONTEXT + INSIDE
SYMBOLS, FILTERS, KERNEL = 42, 24, 5
#: One-hot symbols of the candidate, those of its context, case, and which characters are the candidate's.
FEATURES = 2 * SYMBOLS + 2
_LEAST = 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_WORDS = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")


def rule_findings(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind of rule."""
    out: list[Span] = []
    if _WORDS.search(text):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters, without the sentence end that may hang on."""
    out = []
    for m in _CANDIDATE.finditer(text):
        end = m.start() + len(m[0].rstrip("."))
        if end - m.start() >= _LEAST:
            out.append((m.start(), end))
    return out


def _symbol_table() -> np.ndarray:
    """Class of each code point: letters by themselves with case apart as a flag, digits, marks, others."""
    table = np.full(0x110000, 41, np.uint8)
    for c in range(26):
        table[97 + c] = table[65 + c] = c
    for c in range(10):
        table[48 + c] = 26 + c
    table[[32, 9, 10, 13]] = 36
    for c in "\"'":
        table[ord(c)] = 37
    for c in ":=":
        table[ord(c)] = 38
    for c in "+/_-":
        table[ord(c)] = 39
    for c in ".,;!?()":
        table[ord(c)] = 40
    return table


_TABLE = _symbol_table()


def window_codes(text: str, start: int, end: int) -> list[bytes]:
    """The windows over one candidate: three rows of bytes each, symbol, case and whether it is the candidate."""
    out = []
    step = INSIDE // 2
    for at in range(start, max(start + 1, end - step), step):
        stop = min(at + INSIDE, end)
        left, right = max(0, at - CONTEXT), min(len(text), stop + CONTEXT)
        points = np.frombuffer(text[left:right].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.full((3, WIDTH), 0, np.uint8)
        codes[0] = SYMBOLS  # nothing
        shift = CONTEXT - (at - left)
        codes[0, shift : shift + len(points)] = _TABLE[points]
        codes[1, shift : shift + len(points)] = (points >= 65) & (points <= 90)
        codes[2, max(0, start - at + CONTEXT) : CONTEXT + (end - at)] = 1
        out.append(codes.tobytes())
    return out


def decode_windows(windows: list[bytes]) -> np.ndarray:
    """(n, WIDTH): a state of each place, of symbol (candidate and context apart, or nothing), case and candidate or not."""
    codes = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, 3, WIDTH).astype(np.int16)
    symbol = np.where(codes[:, 0] < SYMBOLS, codes[:, 0] + SYMBOLS * (1 - codes[:, 2]), 2 * SYMBOLS)
    return symbol * 4 + codes[:, 1] * 2 + codes[:, 2]


def _state_features() -> np.ndarray:
    """The FEATURES of each state."""
    state = np.arange(4 * (2 * SYMBOLS + 1))
    hot = np.zeros((len(state), FEATURES), np.float32)
    symbol = state // 4
    hot[symbol < 2 * SYMBOLS, symbol[symbol < 2 * SYMBOLS]] = 1
    hot[:, -2], hot[:, -1] = state // 2 % 2, state % 2
    return hot


_STATES = _state_features()


class CharacterNetwork:
    """One convolution, mean and maximum over the window, one dense unit."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.kernel = rng.normal(0, 0.15, (KERNEL * FEATURES, FILTERS)).astype(np.float32)
        self.kernel_bias = np.zeros(FILTERS, np.float32)
        self.dense = rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.dense_bias = np.zeros(1, np.float32)
        self.scale, self.offset, self.threshold = 1.0, 0.0, 2.0  # a threshold over 1 adds nothing

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        """The convolution of (n, WIDTH) states: kernel rows are looked up by state and added, no patches are built."""
        places = WIDTH - KERNEL + 1
        hidden = np.broadcast_to(self.kernel_bias, (len(x), places, FILTERS)).copy()
        for k, kernel in enumerate(self.kernel.reshape(KERNEL, FEATURES, FILTERS)):
            hidden += (_STATES @ kernel)[x[:, k : k + places]]
        return np.maximum(hidden, 0, out=hidden)

    def _pooled(self, hidden: np.ndarray) -> np.ndarray:
        return np.concatenate([hidden.max(axis=1), hidden.mean(axis=1) * 4], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._pooled(self._hidden(x[i : i + 256])) @ self.dense + self.dense_bias[0] for i in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _values(self) -> list[np.ndarray]:
        return [self.kernel, self.kernel_bias, self.dense, self.dense_bias]

    def first_state(self) -> np.ndarray:
        """What training goes on from: weights, their first and second moments, and the steps taken, as one vector."""
        weights = np.concatenate([v.ravel() for v in self._values()])
        return np.r_[weights, np.zeros(2 * len(weights) + 1)].astype(np.float32)

    def _at(self, state: np.ndarray) -> list[list[np.ndarray]]:
        """Weights, first and second moments of a state in the form of the weights, as views."""
        ends = np.cumsum([v.size for v in self._values()])
        return [[p.reshape(v.shape) for p, v in zip(np.split(part, ends[:-1]), self._values())] for part in np.split(state[:-1], 3)]

    def load(self, state: np.ndarray) -> None:
        self.kernel, self.kernel_bias, self.dense, self.dense_bias = self._at(state)[0]

    def trained(
        self, state: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int, batch: int = 64, rate: float = 3e-3
    ) -> np.ndarray:
        """The state after one pass of Adam over (n, WIDTH) states and their labels, begun at `state`."""
        state = state.copy()
        values, first, second = self._at(state)
        self.load(state)
        rng, t = np.random.default_rng(seed), float(state[-1])
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            hidden = self._hidden(x[part])
            top, pooled = hidden.argmax(axis=1), self._pooled(hidden)
            out = pooled @ self.dense + self.dense_bias[0]
            miss = (weight[part] * (1 / (1 + np.exp(-out)) - y[part]) / len(part)).astype(np.float32)
            back = miss[:, None] * self.dense
            grad = np.repeat(back[:, None, FILTERS:] * (4 / hidden.shape[1]), hidden.shape[1], axis=1)
            rows = np.arange(len(part))[:, None]
            grad[rows, top, np.arange(FILTERS)[None]] += back[:, :FILTERS]
            grad *= hidden > 0
            steps = [self._kernel_gradient(x[part], grad), grad.sum(axis=(0, 1)), pooled.T @ miss, miss.sum(keepdims=True)]
            t += 1
            for v, g, m, s in zip(values, steps, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        state[-1] = t
        return state

    def _kernel_gradient(self, x: np.ndarray, grad: np.ndarray) -> np.ndarray:
        """Sums of `grad` by state for each row of the kernel, then by feature: no patches are built."""
        places = grad.shape[1]
        cell = x.astype(np.int64)[:, :, None] * FILTERS + np.arange(FILTERS)
        sums = [np.bincount(cell[:, k : k + places].ravel(), grad.ravel(), len(_STATES) * FILTERS) for k in range(KERNEL)]
        return np.concatenate([_STATES.T @ s.reshape(-1, FILTERS).astype(np.float32) for s in sums])

    def calibrate(self, scores: DataFrame, recall: float) -> None:
        """Platt scaling by Newton steps, then a threshold with the wanted recall on `scores(label, z, n)`.

        It is the largest such threshold, or halfway to the other candidates if those all lie under it.
        Each step is one aggregate over all scores.
        """
        sizes = {r.label: r.n for r in scores.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        goal = F.when(F.col("label") > 0, (sizes[1] + 1) / (sizes[1] + 2)).otherwise(1 / (sizes[0] + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + F.exp(-(F.lit(a) * F.col("z") + b)))
            at = scores.select("z", "n", (p - goal).alias("miss"), (p * (1 - p) + 1e-9).alias("w"))
            sums = at.agg(*[F.sum(F.col("n") * c) for c in (
                F.col("miss") * F.col("z"), F.col("miss"), F.col("w") * F.col("z") * F.col("z"), F.col("w") * F.col("z"), F.col("w")
            )]).first()
            g = np.array([sums[0] + 1e-3 * (a - 1), sums[1]])
            h = np.array([[sums[2] + 1e-3, sums[3]], [sums[3], sums[4] + 1e-9]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.scale, self.offset = float(a), float(b)
        upwards = F.col("z") if a >= 0 else -F.col("z")  # in the order of the probability
        found = scores.where("label = 1").select(upwards.alias("value"), "n")
        others = scores.where("label = 0").agg(F.max(upwards)).first()[0]
        limits = np.array([value_at(found, int((1 - recall) * sizes[1])), others])
        highest, others = self._scaled(limits if a >= 0 else -limits)  # any threshold up to `highest` has the recall
        self.threshold = float((highest + others) / 2 if others < highest else highest)

    def _scaled(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * z + self.offset)))

    def clipped(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.logits(x).astype(np.float64), -30, 30)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(self.clipped(x))


def value_at(values: DataFrame, at: int) -> float:
    """The `at`-th least (from 0) of `values(value, n)`, each standing n times, without a sort in one task."""
    ranges = materialise(values.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "secret-ranges")
    for part, size in sorted(ranges.groupBy("part").agg(F.sum("n")).collect()):
        if at < size:
            break
        at -= size
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    inside = ranges.where(F.col("part") == part).withColumn("upto", upto)
    return inside.where(F.col("upto") > at).agg(F.min("value")).first()[0]


def labelled_windows(documents: DataFrame) -> DataFrame:
    """(label, window, key): rule findings are 1, other candidates 0; `key` is the candidate itself, hashed.

    Findings also come among other words, and all candidates also alone.
    """

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            labels, windows, keys = [], [], []
            for text in batch.column("text").to_pylist():
                rules = rule_findings(text or "")
                for start, end in candidates(text or ""):
                    hit = any(a < end and start < b for _, a, b in rules)
                    forms = window_codes(text, start, end)
                    if hit:  # the same key among other words
                        plain = re.sub(r"[\"'=:]", " ", text[max(0, start - CONTEXT) : start])
                        plain = re.sub(_WORDS, "value", plain)
                        key = text[start:end].rsplit("=", 1)[-1]
                        moved = f"{plain} {key} {text[end : end + CONTEXT].lstrip(chr(34))}"
                        at = len(plain) + 1
                        forms = forms + (window_codes(moved, at, at + len(key)) if len(key) >= _LEAST else [])
                    alone = text[start:end].rsplit("=", 1)[-1] if hit else text[start:end]
                    if len(alone) >= _LEAST:  # and by itself, whatever it is
                        forms = forms + window_codes(alone, 0, len(alone))
                    labels += [int(hit)] * len(forms)
                    windows += forms
                    keys += [hashlib.md5(alone.encode("utf-8", "surrogatepass")).digest()] * len(forms)
            columns = [pa.array(labels, pa.int32()), pa.array(windows, pa.binary()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "window", "key"])

        return work

    return map_rows(documents.select("text"), "label int, window binary, key binary", make)


def _held_out(least: dict[int, bytes]) -> Column:
    """Whether a window's key is in the first quarter of all digests, or the least of its label: one is held out at least."""
    first = F.lit(False)
    for label, key in least.items():
        first = first | ((F.col("label") == label) & (F.col("key") == F.lit(bytearray(key))))
    return (F.hex("key") < "40") | first  # digests: their order is one by chance


def fit(documents: DataFrame, recall: float = RECALL) -> CharacterNetwork:
    """The network, trained on all distinct windows.

    It is calibrated on windows of keys that it never saw in training; a single key of a label is on both sides.
    """
    network = CharacterNetwork()
    rows = materialise(labelled_windows(documents).distinct(), "secret-windows")
    ends = {r.label: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()}
    sizes = [ends[label].n if label in ends else 0 for label in (0, 1)]
    if min(sizes) < LEAST_WINDOWS:
        warnings.warn(f"secrets: {sizes[1]} windows of findings and {sizes[0]} of others are too few to train on")
        return network
    held = _held_out({label: bytes(r.a) for label, r in ends.items()})
    single = F.col("label").isin([label for label, r in ends.items() if r.a == r.b])
    _train(network, rows.where(~held | single))
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in (batch.slice(i, 2048) for i in range(0, len(batch), 2048)):
                z = shared.value.clipped(decode_windows(part.column("window").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(z, pa.float64())], ["label", "z"])

        return work

    scores = map_rows(rows.where(held).select("label", "window"), "label int, z double", make)
    network.calibrate(materialise(scores.groupBy("label", "z").agg(F.count("*").alias("n")), "secret-scores"), recall)
    return network


def _train(network: CharacterNetwork, rows: DataFrame) -> None:
    """ROUNDS passes over `rows(label, window)`, the state being the mean over all shards after each."""
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    weights = np.array([total / (len(sizes) * sizes.get(label, total)) for label in (0, 1)], np.float32)
    shards = -(-total // SHARD_WINDOWS)
    dealt = rows.select(F.pmod(F.xxhash64("window"), F.lit(shards)).alias("shard"), "label", "window")
    schema = "shard long, n long, state array<float>"

    def row(shard: int, n: int, state: np.ndarray) -> pa.Table:
        columns = {"shard": [shard], "n": [n], "state": [state.astype(np.float32)]}
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), (pa.int64(), pa.int64(), pa.list_(pa.float32())))})

    def mean(table: pa.Table) -> np.ndarray:
        table = table.sort_by("shard")
        states = table.column("state").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        return np.average(states.astype(np.float64), axis=0, weights=table.column("n").to_numpy())

    def mean_of_some(table: pa.Table) -> pa.Table:
        return row(table.column("shard")[0].as_py() // MEAN_OF, sum(table.column("n").to_pylist()), mean(table))

    def passed(round_: int, shared):
        def work(table: pa.Table) -> pa.Table:
            table, shard = table.sort_by([("window", "ascending"), ("label", "ascending")]), table.column("shard")[0].as_py()
            y = table.column("label").to_numpy()
            x = decode_windows(table.column("window").to_pylist())
            seed = rounds * shard + round_
            state = CharacterNetwork().trained(shared.value, x, y.astype(np.float32), weights[y], seed)
            return row(shard, len(y), state)

        return work

    state, rounds = network.first_state(), ROUNDS
    for round_ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(state)
        states = dealt.groupBy("shard").applyInArrow(passed(round_, shared), schema)
        means = states.groupBy(F.floor(F.col("shard") / MEAN_OF)).applyInArrow(mean_of_some, schema).toArrow()
        state = mean(means).astype(np.float32)
    network.load(state)


def findings(texts: list[str], network: CharacterNetwork) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [rule_findings(t) for t in texts]
    asked, windows = [], []
    for i, text in enumerate(texts):
        for start, end in candidates(text) if network.threshold <= 1 else ():
            forms = window_codes(text, start, end)
            asked += [(i, start, end)] * len(forms)
            windows += forms
    more: list[dict[tuple[int, int], float]] = [{} for _ in texts]
    for at in range(0, len(windows), 2048):
        chances = network.probability(decode_windows(windows[at : at + 2048]))
        for (i, start, end), p in zip(asked[at : at + 2048], chances.tolist()):
            more[i][start, end] = max(p, more[i].get((start, end), 0.0))
    return [
        (found, add_apart(found, [("key", a, b) for (a, b), p in extra.items() if p >= network.threshold]))
        for found, extra in zip(base, more)
    ]


def scan_secrets(documents: DataFrame, network: CharacterNetwork | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text."""
    network = network or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = findings([t or "" for t in batch.column("text").to_pylist()], shared.value)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([digest(b, KINDS) for b, _ in found], pa.string()), pa.array([joined(s, KINDS) for _, s in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

        return work

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)


def blank_secrets(documents: DataFrame, network: CharacterNetwork | None = None) -> DataFrame:
    """The documents with every secret of the text replaced by its kind; n_chars follows."""
    network = network or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = batch.column("text").to_pylist()
            found = findings([t or "" for t in texts], shared.value)
            clean = [t if t is None or not s else blanked(t, s) for t, (_, s) in zip(texts, found)]
            columns = []
            for name, column in zip(batch.schema.names, batch.columns):
                if name == "text":
                    column = pa.array(clean, pa.string())
                elif name == "n_chars":
                    values = [n if t is c else len(c) for n, t, c in zip(column.to_pylist(), texts, clean)]
                    column = pa.array(values, column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return work

    return map_rows(documents, documents.schema, make)
