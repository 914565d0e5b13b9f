"""Reading one packed field under a given dialect; runs inside tasks, on one field at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

from cairn.functions.text import WHITE_SPACE

# The marks that may separate values, the quotes that may enclose one, and brackets.
MARKS = "|｜,，;；、\t\n\r"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』", "«": "»"}
BRACKETS = {"(": ")", "[": "]", "（": "）", "［": "］"}
WRAPS = {"[": "]", "{": "}", "［": "］", "｛": "｝", "【": "】"}

_SPECIAL = re.compile("[" + re.escape("".join({*QUOTES, *BRACKETS}) + "\\") + "]")
#: What reading a field stops at: marks, quotes, brackets and backslashes.
_STEP = re.compile("[" + re.escape("".join({*MARKS, *QUOTES, *BRACKETS}) + "\\") + "]")
_PAIRS = re.compile(r"\\.|[" + re.escape("".join({*BRACKETS, *BRACKETS.values()})) + "]", re.DOTALL)


def _quote_end(s: str, i: int, close: str) -> int:
    """Where the quoted part that opens at i ends (after its closing quote), or -1 if it never does."""
    i += 1
    while i < len(s):
        if s[i] == "\\":
            i += 2
        elif s[i] == close:
            if s[i + 1 : i + 2] == close:
                i += 2
            else:
                return i + 1
        else:
            i += 1
    return -1


class _Quotes:
    """Where quotes of one text end. One kind that is once found open to the end is so from every later place, so no text is read again and again."""

    def __init__(self, s: str):
        self.s, self.open = s, set()

    def end(self, i: int) -> int:
        """As _quote_end, of the quote at i."""
        c = self.s[i]
        if c in self.open:
            return -1
        end = _quote_end(self.s, i, QUOTES[c])
        if end < 0 and QUOTES[c] != c:
            self.open.add(c)
        return end


def _bracket_ends(s: str) -> dict[int, int]:
    """Where each bracket that is closed ends (after the closing one). Brackets of the same kind nest."""
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {close: [] for close in BRACKETS.values()}
    for m in _PAIRS.finditer(s):
        c = m[0]
        if c in BRACKETS:
            waiting[BRACKETS[c]].append(m.start())
        elif c in waiting and waiting[c]:
            ends[waiting[c].pop()] = m.end()
    return ends


def unwrap(field: str) -> str:
    """The field without outer white space and without brackets or braces around the whole list."""
    s = field.strip(WHITE_SPACE)
    if len(s) < 2 or WRAPS.get(s[0]) != s[-1]:
        return s
    i, depth, start, quotes = 0, 0, True, _Quotes(s)
    while i < len(s):
        c = s[i]
        if c == "\\":
            i += 1
        elif start and c in QUOTES and (e := quotes.end(i)) > 0:
            i, start = e, False
            continue
        elif c == s[0]:
            depth += 1
        elif c == s[-1]:
            depth -= 1
            if not depth and i < len(s) - 1:
                return s
        start = c in MARKS or (start and c in WHITE_SPACE) or i == 0
        i += 1
    return s[1:-1] if depth == 0 else s


@lru_cache(maxsize=100_000)
def clean(raw: str, quoting: bool) -> str:
    """The value in a slot: without outer white space, its quotes, and the doubling or backslash of a mark."""
    v, close = raw.strip(WHITE_SPACE), ""
    if quoting and v[:1] in QUOTES and v and _quote_end(v, 0, QUOTES[v[0]]) == len(v):
        close = QUOTES[v[0]]
        v = v[1:-1]
    if "\\" in v or close and close * 2 in v:
        out, i = [], 0
        while i < len(v):
            if v[i] == "\\" and i + 1 < len(v) and (v[i + 1] in MARKS or v[i + 1] == "\\" or v[i + 1] in QUOTES or v[i + 1] in QUOTES.values()):
                i += 1
            elif close and v[i] == close and v[i + 1 : i + 2] == close:
                i += 1
            out.append(v[i])
            i += 1
        v = "".join(out)
    return v.strip(WHITE_SPACE)


def cuts(s: str, seps: str, quoting: bool) -> list[int]:
    """The positions of the separating marks of an unwrapped field."""
    if not _SPECIAL.search(s):
        return [i for i, c in enumerate(s) if c in seps]
    ends, quotes = _bracket_ends(s), _Quotes(s)
    # a value starts at ``start`` if nothing but white space stands before the next mark; -1 within a value
    found, at, start = [], 0, 0
    while m := _STEP.search(s, at):
        i, c = m.start(), m[0]
        at = i + 1
        if c == "\\":
            at, start = i + 2, -1
        elif c in seps:
            found.append(i)
            start = at
        else:
            if start >= 0:
                start = -1 if s[start:i].strip(WHITE_SPACE) else i
            if c in BRACKETS and i in ends:
                at, start = ends[i], -1
            elif quoting and start >= 0 and c in QUOTES and (e := quotes.end(i)) > 0:
                at, start = e, -1
    return found


def slots_at(s: str, at: list[int], quoting: bool) -> list[str]:
    """Every slot's value of an unwrapped field with separators at these places, in order; an empty string for a slot without one."""
    return [clean(s[a + 1 : b], quoting) for a, b in zip([-1, *at], [*at, len(s)])]


def slots(field: str, seps: str, quoting: bool) -> list[str]:
    """Every slot's value, in order; an empty string for a slot without one."""
    s = unwrap(field)
    return slots_at(s, cuts(s, seps, quoting), quoting)


def broken(v: str) -> bool:
    """Whether a value starts with a quote that it doesn't close, or ends with one that it didn't open."""
    if not v:
        return False
    if v[0] in QUOTES and QUOTES[v[0]] not in v[1:]:
        return True
    return any(v[-1] == close and open_ not in v[:-1] for open_, close in QUOTES.items())


def parses(s: str) -> Iterator[tuple[str, bool, int, list[str]]]:
    """An unwrapped field read by each of its dialects: separating marks, whether quotes enclose values, marks left standing, slots.

    Separators are all subsets of the marks that stand unprotected in it, however many these are; there are no more
    than len(MARKS). Only quotes are read differently under different separators; without them the field is read once.
    """
    quoted = any(q in s for q in QUOTES)
    for quoting in (True, False) if quoted else (True,):
        marks = cuts(s, MARKS, quoting)
        found = {s[i] for i in marks}
        here = "".join(m for m in MARKS if m in found)
        for k in range(len(here) + 1):
            for x in combinations(here, k):
                seps = "".join(x)
                at = cuts(s, seps, True) if quoted and quoting else [i for i in marks if s[i] in seps]
                yield seps, quoting, len(marks) - len(at), slots_at(s, at, quoting)


def dialects(field: str) -> Iterator[tuple[str, bool]]:
    """The dialects of a field as (separating marks, whether quotes enclose values)."""
    return ((seps, quoting) for seps, quoting, _, _ in parses(unwrap(field)))
