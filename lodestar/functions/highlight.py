"""Highlights: where the terms of a query stand in a text, and marked fragments of it."""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MAX_GRAM, MIN_GRAM, WORD_REGEX, col

OPEN, CLOSE = "\ue000", "\ue001"
FRAGMENT = 160
_WORD = regex.compile(WORD_REGEX, regex.V1)

RANGES = "array<struct<start:int,end:int>>"
FIELD_FRAGMENTS = f"array<struct<field:string,fragment:string,ranges:{RANGES}>>"
_ARROW_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def ranges_of(text: str, tokens: list[str]) -> list[tuple[int, int]]:
    """Words of ``text`` that begin with a token, as [start, end) in code points."""
    usable = tuple(t for t in tokens if MIN_GRAM <= len(t) <= MAX_GRAM)
    return [m.span() for m in _WORD.finditer(text) if usable and m.group().lower().startswith(usable)]


def marked_ranges(marked: str | None, opening: str = OPEN, closing: str = CLOSE) -> tuple[str, list[tuple[int, int]]] | None:
    """Text without its markers and the ranges they stood around, adjacent ones merged; None for blank, unmarked or unbalanced text."""
    if not marked or not marked.strip():
        return None
    plain, found, start, at = [], [], None, 0
    for piece in re.split(f"({re.escape(opening)}|{re.escape(closing)})", marked):
        if piece == opening:
            if start is not None:
                return None
            start = at
        elif piece == closing:
            if start is None:
                return None
            if found and found[-1][1] == start:
                found[-1] = (found[-1][0], at)
            elif at > start:
                found.append((start, at))
            start = None
        else:
            plain.append(piece)
            at += len(piece)
    return ("".join(plain), found) if found and start is None else None


def fragment(text: str, tokens: list[str], size: int = FRAGMENT) -> tuple[str, list[tuple[int, int]]] | None:
    """A piece of at most ``size`` code points around the first hit, cut at spaces where possible, with its ranges."""
    hits = ranges_of(text, tokens)
    if not hits:
        return None
    start = max(0, min(hits[0][0] - size // 4, len(text) - size))
    if start and (space := text.find(" ", start, hits[0][0])) >= 0:
        start = space + 1
    end = min(len(text), start + size)
    inside = [(a - start, b - start) for a, b in hits if a >= start and b <= end]
    return (text[start:end], inside) if inside else None


def highlight_ranges(text: Column | str, tokens: list[str]) -> Column:
    """Ranges of the words that the query's tokens begin; empty where none do."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b} for a, b in ranges_of(t or "", tokens)] for t in column.to_pylist()], _ARROW_RANGES)

    return F.arrow_udf(run, RANGES)(col(text))


def token_offsets(text: Column | str, cut: int = 10_000) -> Column:
    """Words of the first ``cut`` code points with their position and offsets, as array<struct<position, token, start, end>>."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for t in column.to_pylist():
            found = [(m.group().lower(), *m.span()) for m in _WORD.finditer((t or "")[:cut])]
            out.append([{"position": i, "token": w, "start": a, "end": b} for i, (w, a, b) in enumerate(found)])
        return pa.array(out, pa.list_(pa.struct([("position", pa.int32()), ("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return F.arrow_udf(run, "array<struct<position:int,token:string,start:int,end:int>>")(col(text))


def highlight_snippet(text: Column | str, tokens: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """A fragment with its hits marked; null where none is."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for t in column.to_pylist():
            found = fragment(t or "", tokens)
            if found is None:
                out.append(None)
                continue
            piece, ranges = found
            for a, b in reversed(ranges):
                piece = f"{piece[:a]}{before}{piece[a:b]}{after}{piece[b:]}"
            out.append(piece)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(col(text))


def highlight_fields(values: Column, tokens: list[str], size: int = FRAGMENT) -> Column:
    """Of each value of a map in which a token begins a word one fragment and the ranges in it, as FIELD_FRAGMENTS by field name; none for a null map."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for entries in column.to_pylist():
            found = [(name, fragment(value or "", tokens, size)) for name, value in sorted(entries or ())]
            out.append([{"field": name, "fragment": f[0], "ranges": [{"start": a, "end": b} for a, b in f[1]]} for name, f in found if f])
        return pa.array(out, pa.list_(pa.struct([("field", pa.string()), ("fragment", pa.string()), ("ranges", _ARROW_RANGES)])))

    return F.arrow_udf(run, FIELD_FRAGMENTS)(values)
