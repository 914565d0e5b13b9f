"""Cutting one text into chunks; runs inside tasks, on one text at a time."""

from __future__ import annotations

import re
from collections import deque

from cairn.functions.text import WHITE_SPACE

SENTENCE_END = re.compile(r"[。！？\n]+|\.[ \t\n\r\f\v]+|![ \t\n\r\f\v]+|\?[ \t\n\r\f\v]+")


def packed(parts: list[str], most: int, glue: str) -> list[str]:
    """Parts joined in order into chunks of up to ``most`` characters, glue not counted; a longer part is a chunk of its own."""
    out: list[list[str]] = []
    size = 0
    for p in parts:
        p = p.strip(WHITE_SPACE)
        if not p:
            continue
        if not out or size + len(p) > most:
            out.append([])
            size = 0
        out[-1].append(p)
        size += len(p)
    return [glue.join(x) for x in out]


def sentences(text: str, most: int) -> list[str]:
    return packed(SENTENCE_END.split(text), most, " ")


def paragraphs(text: str, most: int) -> list[str]:
    return packed(text.split("\n\n"), most, "\n\n")


def bounded(text: str, size: int, overlap: int, reach: int = 100) -> list[str]:
    """Windows of ``size`` characters, each drawn out to the next sentence end within ``reach``; the next begins ``overlap`` before its end."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            stop = re.compile("[。！？\n]").search(text, end, min(end + reach, len(text)))
            end = stop.end() if stop else end
        if chunk := text[start:end].strip(WHITE_SPACE):
            out.append(chunk)
        if end == len(text):
            break
        start = end - overlap
    return out


def recursive(text: str, size: int, overlap: int, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of up to ``size`` characters, divided at the coarsest mark that makes them small enough, up to ``overlap`` of the last one repeated."""
    mark = next(m for m in marks if m == "" or m in text)
    rest = marks[marks.index(mark) + 1 :]
    pieces = list(text) if mark == "" else [p for p in text.split(mark) if p]
    out: list[str] = []
    held: deque[str] = deque()
    total = 0  # characters held, marks between them counted
    for p in pieces:
        if len(p) > size:
            if held:
                out.append(mark.join(held))
                held.clear()
                total = 0
            out += recursive(p, size, overlap, rest)
            continue
        if held and total + len(mark) + len(p) > size:
            out.append(mark.join(held))
            while held and (total > overlap or total + len(mark) + len(p) > size):
                total -= len(held.popleft()) + (len(mark) if held else 0)
        total += len(p) + (len(mark) if held else 0)
        held.append(p)
    if held:
        out.append(mark.join(held))
    return [x.strip(WHITE_SPACE) for x in out if x.strip(WHITE_SPACE)]
