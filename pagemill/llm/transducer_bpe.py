"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Words are counted over all documents; the most frequent `lexicon_words` are
merged once and compiled into a minimal acyclic automaton over their bytes.
Equal suffixes share states; a transition carries the number of words that sort
before it, so the sum along a path is the word's number, and the number gives
the word's ids. The automaton is one flat array that tasks memory-map. Words
that it does not hold are merged exactly, by rank and then from the left.

The lexicon changes only the speed: its size is a bound on memory, and every
word outside it takes the exact way.

Defined results: a null or empty text has no ids; strings of added tokens in a
text become those tokens; words of any length are merged whole; rows that
repeat are returned as often as they come; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import io
import json
import os
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import work_folder
from .common import map_rows, materialise

LEXICON_WORDS = 200_000
#: Longer words are not put into the lexicon.
LEXICON_WORD_BYTES = 48
#: Bytes of words, ids and tokens that a task remembers at most, and what one word costs besides its characters.
CACHE_BYTES, WORD_BYTES = 16 << 20, 420
#: Characters that are scanned at a time: short texts together, a long one in parts that end before a blank.
PART_CHARS = 1 << 18
#: Below this code point the scan's character classes equal the tokenizer library's; others go through its own normalizer.
_PLAIN_BELOW = 0x530
#: Words up to so many bytes are merged with plain lists, longer ones with a heap.
SHORT_BYTES = 64
_NONE = 1 << 40
#: The word pattern that this scan states in other words, letters first.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _class_body(pattern: str) -> str:
    """Characters below _PLAIN_BELOW that match, as ranges for a character class."""
    import regex

    out: list[list[int]] = []
    for c in range(_PLAIN_BELOW):
        if regex.match(pattern, chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(re.escape(chr(a)) + "-" + re.escape(chr(b)) for a, b in out)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {b: chr(b) for b in kept}
    for b in range(256):
        symbols.setdefault(b, chr(256 + len(symbols) - len(kept)))
    return [symbols[b] for b in range(256)]


class Vocabulary:
    """Merges, ids and the word scan of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        suffix: str = spec["model"]["end_of_word_suffix"] or ""
        self.path = path
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in ids.items()} | {i: t for t, i in self.added.items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != _SPLIT:
            raise ValueError(f"{path} splits words by another pattern")
        letters, numbers, blanks = _class_body(r"\p{L}"), _class_body(r"\p{N}"), _class_body(r"\s")
        endings = "'(?:s|t|re|ve|m|ll|d)"
        self._scan = re.compile(f"[{letters}]+|[{numbers}]|{endings}|[^{blanks}{letters}{numbers}]+").findall
        self._scan_ascii = re.compile(f"[a-z]+|[0-9]|{endings}|[^{blanks}a-z0-9]+").findall
        self._rare = re.compile(f"[{chr(_PLAIN_BELOW)}-\U0010ffff]").search
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        symbols = _byte_symbols()
        self._bytes = {c: b for b, c in enumerate(symbols)}
        self._first = [ids[c] for c in symbols]
        self._last = [ids[c + suffix] for c in symbols]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self._pairs = {ids[a] << 20 | ids[b]: r for r, (a, b) in enumerate(pairs)}
        self._made = np.array([ids[a + b] for a, b in pairs], np.int32)
        # normaliser and word split of the library; what its model holds is of no use here
        spec["model"] |= {"vocab": {}, "merges": []}
        self._spec = json.dumps(spec | {"added_tokens": [], "post_processor": None})

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self._spec)

    def parts(self, text: str) -> Iterator[str]:
        """Parts of about PART_CHARS characters that hold the same words; each but the first begins with a blank."""
        start = 0
        while len(text) - start > PART_CHARS:
            stop = text.find(" ", start + PART_CHARS)
            if stop < 0:
                break
            yield text[start:stop]
            start = stop
        yield text[start:] if start else text

    def words(self, text: str) -> list[str]:
        """Normalised words of a text, added tokens among them as they stand."""
        if "<|" in text:
            parts = self._cut(text)
            return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._words(p))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self._scan_ascii(text.lower())
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # one case of sigma
        if not self._rare(low):
            return self._scan(low)
        plain = self._library.normalizer.normalize_str(text)
        back = self._bytes
        pieces = [p for p, _ in self._library.pre_tokenizer.pre_tokenize_str(plain)]
        return [bytes(back[c] for c in p).decode("utf-8") for p in pieces]

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the lowest-ranked pair first, the leftmost of equal ones."""
        if word in self.added:
            return [self.added[word]]
        raw = word.encode("utf-8")
        if not raw:
            return []
        if len(raw) <= SHORT_BYTES:
            return self._merge_short(raw)
        ids, pairs, made = [self._first[b] for b in raw], self._pairs, self._made
        ids[-1] = self._last[raw[-1]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j] = int(made[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (r := pairs.get(ids[a] << 20 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [i for i in ids if i >= 0]

    def _merge_short(self, raw: bytes) -> list[int]:
        """The same with a plain list of the ranks of neighbours."""
        ids, pairs = [self._first[b] for b in raw], self._pairs
        ids[-1] = self._last[raw[-1]]
        ranks = [pairs.get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            ids[i : i + 2] = [int(self._made[least])]
            del ranks[i]
            if i:
                ranks[i - 1] = pairs.get(ids[i - 1] << 20 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = pairs.get(ids[i] << 20 | ids[i + 1], _NONE)
        return ids

    def decode(self, ids) -> str:
        """Tokens of the ids, joined as the tokenizer's decoder joins them."""
        return " ".join(self.tokens[i] for i in ids)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(words: dict[str, list[int]]) -> np.ndarray:
    """The transducer of `words` as one flat array.

    States are built from sorted words and joined with an equal state as soon
    as they cannot change any more.
    """
    order = sorted((w.encode("utf-8"), w) for w in words)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # (final, ((label, target), ...))
    path: list[list] = [[False, []]]  # open states: [final, [(label, target)]]
    held = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in known:
                known[key] = len(states)
                states.append(key)
            path[-1][1].append((held[len(path) - 1], known[key]))

    for word, _ in order:
        common = 0
        while common < min(len(word), len(held)) and word[common] == held[common]:
            common += 1
        close(common)
        held = word
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
    close(0)
    states.append((path[0][0], tuple(path[0][1])))

    below = [0] * len(states)
    keys, targets, outputs = [], [], []
    for s, (final, edges) in enumerate(states):  # targets come before their sources
        passed = int(final)
        for label, target in edges:
            keys.append(s << 8 | label)
            targets.append(target)
            outputs.append(passed)
            passed += below[target]
        below[s] = passed
    ids = [words[w] for _, w in order]
    offsets = np.cumsum([0, *map(len, ids)])
    flat = [i for x in ids for i in x]
    head = [len(keys), len(states), len(order), len(flat)]
    finals = [int(f) for f, _ in states]
    return np.concatenate([np.asarray(x, np.int64) for x in (head, keys, targets, outputs, finals, offsets, flat)])


class Lexicon:
    """Look-ups of many words at a time in a compiled, memory-mapped transducer."""

    def __init__(self, flat: np.ndarray) -> None:
        edges, states, words, ids = (int(x) for x in flat[:4])
        cuts = np.cumsum([4, edges, edges, edges, states, words + 1, ids])
        self.keys, self.targets, self.outputs, self.finals, self.offsets, self.ids = (flat[a:b] for a, b in zip(cuts, cuts[1:]))
        self.start = states - 1

    def find(self, words: list[str]) -> list[list[int] | None]:
        """Ids of each word, None for words that the transducer does not hold."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        state = np.where((lengths > 0) & (lengths <= LEXICON_WORD_BYTES), self.start, -1)
        number = np.zeros(len(raw), np.int64)
        width = int(min(lengths.max(initial=0), LEXICON_WORD_BYTES))
        chars = np.array([r[:width] for r in raw], f"S{max(width, 1)}").view(np.uint8).reshape(len(raw), -1) if raw else None
        for i in range(width if len(self.keys) else 0):
            live = np.flatnonzero((state >= 0) & (lengths > i))
            if not len(live):
                break
            key = state[live] << 8 | chars[live, i]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[live] = np.where(hit, self.targets[at], -1)
            number[live] += np.where(hit, self.outputs[at], 0)
        good = (state >= 0) & (self.finals[np.maximum(state, 0)] == 1) & (lengths > 0) if len(self.keys) else np.zeros(len(raw), bool)
        return [self.ids[self.offsets[n] : self.offsets[n + 1]].tolist() if g else None for g, n in zip(good.tolist(), number.tolist())]


@functools.lru_cache(maxsize=2)
def _mapped(path: str) -> Lexicon:
    return Lexicon(np.load(path, mmap_mode="r").view(np.ndarray))


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all documents: lower-cased runs of letters, added up in each task before the shuffle."""
    words = documents.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    short = F.octet_length("word").between(1, LEXICON_WORD_BYTES)
    return words.where(short).groupBy("word").agg(F.count("*").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """Words of `counts(word, n)` with the largest counts, at most `size`; equal counts go in together or not at all."""
    steps = counts.groupBy("n").agg(F.count("*").alias("words"))
    filled = F.sum("words").over(W.orderBy(F.desc("n")))
    least = steps.withColumn("filled", filled).where(F.col("filled") <= size).agg(F.min("n")).first()[0]
    return counts.where(F.col("n") >= least).select("word") if least is not None else counts.limit(0).select("word")


def _publish(spark: SparkSession, flat: np.ndarray) -> str:
    """Writes the array to the shared work folder and hands it to every executor; returns its file name."""
    out = io.BytesIO()
    np.save(out, flat)
    folder = work_folder(spark, "lexicon")
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(out.getvalue()))
    stream.close()
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def fit_lexicon(documents: DataFrame, tokenizer: str | None = None, lexicon_words: int = LEXICON_WORDS) -> tuple[str, str]:
    """File names, on every executor, of the tokenizer and of the lexicon of the most frequent words."""
    spark = documents.sparkSession
    path = tokenizer or default_tokenizer()
    spark.sparkContext.addFile(path)
    file = os.path.basename(path)
    top = most_frequent(materialise(word_counts(documents), "word-counts"), lexicon_words).collect()
    words = vocabulary(path)
    return file, _publish(spark, compile_lexicon({r.word: words.merge(r.word) for r in top}))


class Encoder:
    """Encodes texts; what it remembers is bounded in bytes, whatever the texts."""

    def __init__(self, words: Vocabulary, lexicon: Lexicon, full: bool = True) -> None:
        self.words, self.lexicon, self.full = words, lexicon, full
        self.known: dict[str, tuple[str, str, bytes]] = {}  # ids and tokens of a word, each joined by blanks; ids as int32
        self.held = 0

    def learn(self, found: list[str]) -> None:
        """Makes every word of `found` known; forgets all others when there is no room."""
        distinct = set(found)
        missing = [w for w in distinct if w not in self.known]
        if missing and self.held > CACHE_BYTES:
            self.known.clear()
            self.held, missing = 0, list(distinct)
        tokens, known, merge = self.words.tokens, self.known, self.words.merge
        for word, ids in zip(missing, self.lexicon.find(missing)):
            ids = merge(word) if ids is None else ids
            number, token = " ".join(map(str, ids)), " ".join([tokens[i] for i in ids])
            known[word] = (number, token, np.array(ids, "<i4").tobytes() if self.full else b"")
            self.held += WORD_BYTES + len(word) + len(number) + len(token) + 4 * len(ids)

    def rows(self, texts: list[str]) -> list[tuple]:
        """(n_tokens, ids_sha256, decoded_sha256[, ids as int32 bytes, decoded]) of each text."""
        out: list[tuple] = []
        batch: list[list[str]] = []
        chars = 0

        def close() -> None:
            nonlocal chars
            self.learn([w for found in batch for w in found])
            out.extend(self._row([found]) for found in batch)
            batch.clear()
            chars = 0

        for text in texts:
            if len(text) > PART_CHARS:
                close()
                out.append(self._row(self._learnt(text)))
                continue
            batch.append(self.words.words(text))
            chars += len(text)
            if chars > PART_CHARS:
                close()
        close()
        return out

    def _learnt(self, text: str) -> Iterator[list[str]]:
        for part in self.words.parts(text):
            found = self.words.words(part)
            self.learn(found)
            yield found

    def _row(self, parts: Iterable[list[str]]) -> tuple:
        """One text's row from the known words of its parts."""
        count, id_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()
        raw, decoded = [], []
        for found in parts:
            if not found:
                continue
            known = list(map(self.known.__getitem__, found))
            ids, text = " ".join([k[0] for k in known]), " ".join([k[1] for k in known])
            if count:
                id_digest.update(b" ")
                text_digest.update(b" ")
            id_digest.update(ids.encode())
            text_digest.update(text.encode("utf-8"))
            count += ids.count(" ") + 1
            if self.full:
                raw += [k[2] for k in known]
                decoded.append(text)
        head = (count, id_digest.hexdigest(), text_digest.hexdigest())
        return (*head, b"".join(raw), " ".join(decoded)) if self.full else head


def _id_lists(raw: list[bytes]) -> pa.Array:
    """Lists of the int32 values in each item."""
    ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encode(documents: DataFrame, tokenizer: str | None = None, lexicon_words: int = LEXICON_WORDS, full: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with `full` also (ids, decoded)."""
    file, lexicon = fit_lexicon(documents, tokenizer, lexicon_words)
    more = ", ids array<int>, decoded string" if full else ""

    def make():
        rows_of = Encoder(vocabulary(SparkFiles.get(file)), _mapped(SparkFiles.get(lexicon)), full).rows

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = batch.column("text")
            for start in range(0, len(texts), 256):
                part = texts.slice(start, 256)
                rows = rows_of([t or "" for t in part.to_pylist()])
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))]
                if full:
                    columns += [_id_lists([r[3] for r in rows]), pa.array([r[4] for r in rows], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns) + 1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, 256), *columns], names)

        return work

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}", make)
