"""Spans in texts: digests of them and the joining of found and added ones."""

from __future__ import annotations

import hashlib

#: kind, start, end; code points, end exclusive
Span = tuple[str, int, int]


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    place = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], place[s[0]], s[2]))


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans, kinds))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def add_apart(base: list[Span], more: list[Span]) -> list[Span]:
    """`base` and those of `more` that touch none of it."""
    taken = sorted((a, b) for _, a, b in base)
    out, at = list(base), 0
    for span in sorted(more, key=lambda s: s[1]):
        while at < len(taken) and taken[at][1] <= span[1]:
            at += 1
        if at == len(taken) or taken[at][0] >= span[2]:
            out.append(span)
    return out


def blanked(text: str, spans: list[Span], mark: str = "[{kind}]") -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mark.format(kind=kind.upper())]
        at = max(at, b)
    return "".join([*out, text[at:]])
