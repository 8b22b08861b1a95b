"""Spans between an opener and a closer, found in linear time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

_BLANK_LINE = re.compile(r"\n[ \t]*\n")


def enclosed(text: str, opener: re.Pattern, closer: re.Pattern, near: bool = False) -> Iterator[tuple[int, int]]:
    """Spans from an opener to the nearest closer behind it; one without closer, or with ``near`` without one before the next blank line, opens nothing."""
    opened = list(opener.finditer(text))
    closed = [m.span() for m in closer.finditer(text)] if opened else []
    blank = [m.start() for m in _BLANK_LINE.finditer(text)] if closed and near else []
    i = j = at = 0
    for m in opened:
        if m.start() < at:
            continue
        while i < len(closed) and closed[i][0] < m.end():
            i += 1
        while j < len(blank) and blank[j] < m.end():
            j += 1
        if i == len(closed):
            return
        if j == len(blank) or closed[i][0] < blank[j]:
            at = closed[i][1]
            yield m.start(), at


def replaced(text: str, opener: re.Pattern, closer: re.Pattern, change: Callable[[str], str], near: bool = False) -> str:
    """The text with each such span changed."""
    out, end = [], 0
    for a, b in enclosed(text, opener, closer, near):
        out += (text[end:a], change(text[a:b]))
        end = b
    return "".join([*out, text[end:]]) if out else text
