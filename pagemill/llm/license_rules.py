"""License scans by ordered signature rules.

A rule is a regular expression over a text's words (lower case, one blank
between), gated by keywords that must be among the words, with a priority and a
confidence. Rules are written for families of licenses: each family has names,
versions and, where there is one, a sentence of its text, and every name and
version is looked for in the forms in which licenses are stated. Detections
that lie inside another one of at least their priority are dropped, and of
those that overlap the one with the higher priority, then the longer, then the
earlier stays.

Three phrases are the base; their places are all counted and their labels stay,
whatever the rules say.

Defined results: a null text has no words, no labels and score 0; repeated rows
are returned as often as they come; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# The base phrases and their labels.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

#: label, names, versions, a sentence of the license's own text
FAMILIES: tuple[tuple[str, tuple[str, ...], tuple[str, ...], str], ...] = (
    ("apache", ("apache license", "apache software license"), ("1.0", "1.1", "2.0"), "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("gpl", ("gnu general public license", "gnu gpl", "gpl"), ("1", "2", "3"), "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2", "2.1", "3"), "this library is free software you can redistribute it and or modify it"),
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1", "3"), "interacting with it remotely through a computer network"),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1.1", "1.2", "1.3"), "permission is granted to copy distribute and or modify this document"),
    ("mit", ("mit license", "expat license", "x11 license"), (), "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-0", ("mit no attribution license", "mit no attribution"), (), ""),
    ("bsd-2-clause", ("bsd 2 clause license", "simplified bsd license", "freebsd license", "2 clause bsd license"), (), ""),
    ("bsd-3-clause", ("bsd 3 clause license", "new bsd license", "modified bsd license", "3 clause bsd license"), (), "neither the name of"),
    ("bsd-4-clause", ("bsd 4 clause license", "original bsd license"), (), "all advertising materials mentioning features or use of this software"),
    ("bsd", ("bsd license", "bsd style license"), (), "redistribution and use in source and binary forms with or without modification are permitted"),
    ("0bsd", ("zero clause bsd license", "bsd zero clause license", "0bsd"), (), ""),
    ("isc", ("isc license", "internet systems consortium license"), (), "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("mpl", ("mozilla public license", "mpl"), ("1.0", "1.1", "2.0"), "this source code form is subject to the terms of the mozilla public license"),
    ("epl", ("eclipse public license", "epl"), ("1.0", "2.0"), "this program and the accompanying materials are made available under the terms of the eclipse"),
    ("cddl", ("common development and distribution license", "cddl"), ("1.0", "1.1"), ""),
    ("cpl", ("common public license",), ("1.0",), ""),
    ("cpal", ("common public attribution license",), ("1.0",), ""),
    ("ipl", ("ibm public license",), ("1.0",), ""),
    ("eupl", ("european union public licence", "european union public license", "eupl"), ("1.0", "1.1", "1.2"), ""),
    ("osl", ("open software license",), ("1.0", "2.0", "2.1", "3.0"), ""),
    ("afl", ("academic free license",), ("1.1", "1.2", "2.0", "2.1", "3.0"), ""),
    ("ofl", ("sil open font license", "open font license"), ("1.0", "1.1"), ""),
    ("artistic", ("artistic license",), ("1.0", "2.0"), ""),
    ("bsl", ("boost software license",), ("1.0",), "boost software license version 1 0 august 17th 2003"),
    ("busl", ("business source license",), ("1.0", "1.1"), ""),
    ("sspl", ("server side public license", "sspl"), ("1",), ""),
    ("elastic", ("elastic license",), ("1.0", "2.0"), ""),
    ("zlib", ("zlib license", "zlib libpng license"), (), "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", ("libpng license",), ("1.6", "2"), ""),
    ("unlicense", ("unlicense",), (), "this is free and unencumbered software released into the public domain"),
    ("wtfpl", ("do what the fuck you want to public license", "wtfpl"), ("1", "2"), ""),
    ("ms-pl", ("microsoft public license", "ms pl"), (), ""),
    ("ms-rl", ("microsoft reciprocal license", "ms rl"), (), ""),
    ("ncsa", ("university of illinois ncsa open source license", "ncsa open source license"), (), ""),
    ("upl", ("universal permissive license",), ("1.0",), ""),
    ("postgresql", ("postgresql license", "postgresql licence"), (), ""),
    ("openssl", ("openssl license", "ssleay license"), (), ""),
    ("python", ("python software foundation license", "psf license", "python license"), ("2", "2.0"), ""),
    ("php", ("php license",), ("3.0", "3.01"), ""),
    ("ruby", ("ruby license",), (), ""),
    ("perl", ("same terms as perl itself",), (), ""),
    ("zpl", ("zope public license",), ("1.1", "2.0", "2.1"), ""),
    ("lppl", ("latex project public license", "lppl"), ("1.0", "1.1", "1.2", "1.3c"), ""),
    ("qpl", ("q public license",), ("1.0",), ""),
    ("apsl", ("apple public source license",), ("1.0", "1.1", "1.2", "2.0"), ""),
    ("cecill", ("cecill license", "cecill"), ("1.0", "2.0", "2.1"), ""),
    ("mulan", ("mulan permissive software license", "mulan psl"), ("1", "2"), ""),
    ("odbl", ("open database license", "odbl"), ("1.0",), ""),
    ("odc-by", ("open data commons attribution license", "odc by"), ("1.0",), ""),
    ("pddl", ("public domain dedication and license", "pddl"), ("1.0",), ""),
    ("cc0", ("cc0", "creative commons zero"), ("1.0",), "to the extent possible under law"),
    ("w3c", ("w3c software notice and license", "w3c license"), (), ""),
    ("unicode", ("unicode license agreement",), (), ""),
    ("vim", ("vim license",), (), ""),
    ("beerware", ("beer ware license", "beerware license"), (), ""),
    ("json", ("json license",), (), "the software shall be used for good not evil"),
    ("openrail", ("openrail license", "open rail license", "responsible ai license"), (), ""),
    ("polyform", ("polyform noncommercial license", "polyform small business license"), ("1.0.0",), ""),
    ("proprietary", ("all rights reserved", "proprietary and confidential"), (), ""),
    ("public-domain", ("public domain",), (), ""),
)
#: Creative Commons conditions and versions; every combination is a label of its own.
COMMONS = (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nd", "attribution noderivatives"), ("by-nc", "attribution noncommercial"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives"))
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


class Rule(NamedTuple):
    label: str
    keywords: frozenset[bytes]
    pattern: re.Pattern
    priority: int
    confidence: float


def _words(text: str) -> str:
    return " ".join(re.findall(r"[0-9a-z]+", text.lower()))


def _rule(label: str, phrase: str, priority: int, confidence: float, before: str = "", after: str = "") -> Rule:
    keys = frozenset(w.encode() for w in phrase.split())
    return Rule(label, keys, re.compile(f"(?<![^ ]){before}{re.escape(phrase)}{after}(?![^ ])".encode()), priority, confidence)


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules, by falling priority."""
    out: list[Rule] = []
    grant = "(?:licen[sc]ed|released|distributed|available|provided) (?:under|by) (?:the )?(?:terms of )?(?:the )?"
    edition = "(?: license| licence)?(?: as published by the free software foundation)?(?: either)? (?:v|ver|version|release)? ?"

    def stated(label: str, names: tuple[str, ...], versions: tuple[str, ...]) -> None:
        for name in names:
            wide = " " in name or len(name) > 3
            for version in versions:
                number = _words(version)
                number = f"(?:{number}|{number.removesuffix(' 0')})" if number.endswith(" 0") else number
                out.append(_rule(f"{label}-{version}", name, 4, 1.0, grant, edition + number))
                out.append(_rule(f"{label}-{version}", name, 3, 0.95, "", edition + number))
                out.append(_rule(f"{label}-{version}", f"spdx license identifier {_words(label)}", 5, 1.0, "", f" {number}(?: only| or later)?"))
            out.append(_rule(label, name, 2, 0.9, grant))
            if wide:
                out.append(_rule(label, name, 1, 0.7))
        out.append(_rule(label, f"spdx license identifier {_words(label)}", 4, 0.95))

    for label, names, versions, sentence in FAMILIES:
        stated(label, names, versions)
        if sentence:
            out.append(_rule(label, sentence, 3, 0.9))
    for short, long in COMMONS:
        names = (f"cc {short.replace('-', ' ')}", f"creative commons {long}", f"creativecommons org licenses {short.replace('-', ' ')}")
        stated(f"cc-{short}", names, COMMONS_VERSIONS)
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.pattern.pattern)))


@functools.cache
def _gate() -> tuple[frozenset[bytes], tuple[tuple[frozenset[bytes], tuple[Rule, ...]], ...]]:
    """Every keyword, and the rules by their keywords."""
    by_keys: dict[frozenset[bytes], list[Rule]] = {}
    for rule in rules():
        by_keys.setdefault(rule.keywords, []).append(rule)
    # the rarest word of a phrase is taken to be its longest
    entry = frozenset(max(k, key=lambda w: (len(w), w)) for k in by_keys)
    return entry, tuple((k, tuple(r)) for k, r in by_keys.items())


_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def text_words(text: str) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased: runs of digits, letters a-z and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Detection(NamedTuple):
    label: str
    start: int  # words
    end: int
    priority: int
    confidence: float


def detect(words: list[bytes]) -> list[Detection]:
    """Detections that are left after suppression, by place."""
    entry, by_keys = _gate()
    here = set(words)
    if entry.isdisjoint(here):
        return []
    line = b" ".join(words)
    raw = []
    for keys, found in by_keys:
        if keys <= here:
            for rule in found:
                for m in rule.pattern.finditer(line):
                    raw.append((rule.label, *m.span(), rule.priority, rule.confidence))
    if not raw:
        return []
    raw.sort(key=lambda d: (-d[3], d[1] - d[2], d[1], d[0]))
    kept: list[tuple] = []
    for d in raw:
        if not any(d[1] < k[2] and k[1] < d[2] for k in kept):
            kept.append(d)
    kept.sort(key=lambda d: d[1])
    out, at, passed = [], 0, 0
    for label, a, b, priority, confidence in kept:
        passed += line.count(b" ", at, a)
        at = a
        out.append(Detection(label, passed, passed + line.count(b" ", a, b) + 1, priority, confidence))
    return out


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Start, in words, and label of every place of a base phrase."""
    out = []
    for phrase, label in BASE:
        parts = phrase.split()
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                out.append((at, label))
    return sorted(out)


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, detections)."""
    words = text_words(text or "")
    base = base_places(words)
    found = detect(words)
    base_labels = sorted({label for _, label in base})
    labels = sorted({*base_labels, *(d.label for d in found)})
    score = max([0.7 * bool(base), *(d.confidence for d in found)])
    first, last = (base[0][0], base[-1][0]) if base else (None, None)
    return len(words), len(base), first, last, ",".join(base_labels), ",".join(labels), float(score), found


def scan_licenses(documents: DataFrame, full: bool = True) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), with `full` also detections."""
    more = ", detections array<struct<label:string,start:int,end:int>>" if full else ""
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = [scan(t.as_py()) for t in batch.column("text")]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))]
            if full:
                columns.append(pa.array([[{"label": d.label, "start": d.start, "end": d.end} for d in r[7]] for r in rows], kind))
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

        return work

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double{more}", make)
