"""Tables of pages of positioned words, by array operations over many pages at once.

The words of a batch of pages are stacked into one set of arrays, sorted by page,
line and left edge. What lines are (table lines, headers, groups of labels) and
where runs of table lines lie is then told for all pages together; only the cells
of a run that was found are put together one table at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

# Shapes of the tokens of financial tables.
MONEY = r"\(?\d[\d,]*\.\d{2}\)?|\(?\d[\d,]{3,}\)?"
BAND_NUMBER = r"\(?\d[\d,]*\.\d+\)?|\(?\d[\d,]{3,}\)?"
DASHES = r"[-—－–]+"
NOTE = r"\(?\d{1,3}\)?(?:[（(]\d{1,3}[）)])?"
ITEM = r"^\s*(?:[（(]?[一二三四五六七八九十百零]+[）)、.]|第[一二三四五六七八九十\d]|\d+\s*[、.)）]|[（(]\d+[）)])"
# Distances in points.
LINE_STEP, LEAST_GAP, USUAL_HEIGHT, COLUMN_BIN, COLUMN_REACH = 3.0, 6.0, 7.0, 4, 6
#: Lines that may stand between table lines, numeric lines of a run, and lines above it among which its header is looked for.
RUN_GAP, RUN_LINES, HEADER_REACH = 2, 3, 5

_MONEY, _ITEM = re.compile(MONEY), re.compile(ITEM)
_KINDS = [(1, re.compile(BAND_NUMBER)), (2, re.compile(MONEY)), (4, re.compile(DASHES)), (8, re.compile(NOTE))]
BAND, CASH, DASH, NOTE_MARK = (bit for bit, _ in _KINDS)
NUMERIC, CELL, MARK = BAND | CASH, BAND | CASH | DASH, BAND | CASH | DASH | NOTE_MARK


class Word(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float
    text: str


def make_word(x0: float, y0: float, x1: float, y1: float, text: str) -> Word:
    return Word(x0, y0, x1, y1, text)


class Table(NamedTuple):
    page: int
    labels: list[str]
    rows: list[list[str]]
    top: float
    bottom: float


def kind_of(token: str) -> int:
    """Bits of what a token may be in a table."""
    if not token or not (token[0].isdigit() or token[0] in "(-—－–"):
        return 0
    return sum(bit for bit, pattern in _KINDS if pattern.fullmatch(token))


def grouped_median(values: np.ndarray, group: np.ndarray, groups: int, empty: float) -> np.ndarray:
    """Median of each group's values; ``empty`` for a group without any."""
    order = np.lexsort((values, group))
    count = np.bincount(group, minlength=groups)
    start = np.cumsum(count) - count
    if not len(values):
        return np.full(groups, empty)
    low = np.minimum(start + np.maximum(count - 1, 0) // 2, len(values) - 1)
    high = np.minimum(start + count // 2, len(values) - 1)
    return np.where(count > 0, (values[order[low]] + values[order[high]]) / 2, empty)


def middle(ordered: list[float]) -> float:
    return (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2


def clusters(ordered: list[float], step: float) -> Iterator[list[float]]:
    """Sorted values parted wherever the step between two exceeds ``step``."""
    begin = 0
    for i in range(1, len(ordered) + 1):
        if i == len(ordered) or ordered[i] - ordered[i - 1] > step:
            yield ordered[begin:i]
            begin = i


class Sheets:
    """Words of several pages as arrays, and what their lines are."""

    def __init__(self, page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, text: list[str], rules: dict[int, list[tuple[float, float, float]]]) -> None:
        order = np.lexsort((x0, np.round(y0, 1), page))
        page, x0, y0, x1, y1 = (a[order] for a in (page, x0, y0, x1, y1))
        self.rules = rules
        starts = self._line_starts(page, y0)
        line = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(page)]))
        self.anchor, self.page = y0[starts], page[starts]
        across = np.lexsort((x0, line))  # stable: equal edges keep their order
        self.x0, self.y0, self.x1, self.y1, self.line = x0[across], y0[across], x1[across], y1[across], line
        self.place = across  # in reading order
        self.text = [text[i] for i in order[across]]
        memo: dict[str, int] = {}
        self.kind = np.array([memo[t] if t in memo else memo.setdefault(t, kind_of(t)) for t in self.text], dtype=np.int64)
        self.start = np.r_[starts, len(page)]  # first word of each line
        self._tell_lines()

    @staticmethod
    def _line_starts(page: np.ndarray, y0: np.ndarray) -> np.ndarray:
        """A line goes on as long as words lie near its first one."""
        starts, i = [], 0
        ends = np.r_[np.flatnonzero(np.diff(page)) + 1, len(page)]
        for end in ends.tolist():
            heights = y0[i:end].tolist()
            anchor = None
            for k, y in enumerate(heights):
                if anchor is None or abs(y - anchor) > LINE_STEP:
                    anchor = y
                    starts.append(i + k)
            i = end
        return np.array(starts, dtype=np.int64)

    def _tell_lines(self) -> None:
        lines = len(self.anchor)
        height = self.y1 - self.y0
        tall = height > 0
        usual = grouped_median(height[tall], self.line[tall], lines, 0.0)
        self.gap = np.maximum(LEAST_GAP, 0.9 * np.where(usual > 0, usual, USUAL_HEIGHT))
        first = np.zeros(len(self.line), dtype=bool)
        first[self.start[:-1]] = True
        # a label ends where the distance to the next word is more than the line's gap
        self.opens = first | np.r_[True, self.x0[1:] - self.x1[:-1] > self.gap[self.line[1:]]] if len(self.line) else first
        length = np.array([len(t) if t.strip() else 0 for t in self.text], dtype=np.int64)
        per_line = lambda flag: np.bincount(self.line[flag], minlength=lines)
        tokens = per_line(length > 0)
        self.header = (tokens >= 2) & (per_line(length == 1) <= 0.4 * tokens) & (per_line(self.opens) >= 2)
        self.member, self.banded, self.numeric = (per_line((self.kind & bits) > 0) > 0 for bits in (CELL, BAND, NUMERIC))

    def labels_of(self, line: int) -> list[tuple[float, float, str]]:
        """(left, right, label) of the groups of words of a line."""
        a, b = self.start[line], self.start[line + 1]
        cuts = [*(a + np.flatnonzero(self.opens[a:b])).tolist(), int(b)]
        return [(float(self.x0[i]), float(self.x1[j - 1]), " ".join(self.text[i:j]).strip()) for i, j in zip(cuts, cuts[1:])]

    # --- where tables are ---------------------------------------------------------------------------------------

    def runs(self) -> Iterator[tuple[int, int]]:
        """(header line, end) of every run of table lines, in order."""
        members = np.flatnonzero(self.member)
        if not len(members):
            return
        parted = (np.diff(members) > RUN_GAP + 1) | (np.diff(self.page[members]) != 0)
        begin = np.r_[0, np.flatnonzero(parted) + 1]
        enough = np.add.reduceat(self.banded[members].astype(np.int64), begin) >= RUN_LINES
        last_of = np.r_[begin[1:] - 1, len(members) - 1]
        head = np.maximum.accumulate(np.where(self.header, np.arange(len(self.header)), -1))
        words = np.bincount(self.page[self.line], minlength=int(self.page[-1]) + 1)
        free = 0
        for first, last in zip(members[begin[enough]].tolist(), members[last_of[enough]].tolist()):
            if words[self.page[first]] < 4:
                continue
            free = max(free, int(np.searchsorted(self.page, self.page[first])))  # no line above the page's first
            found = int(head[first - 1]) if first > free else -1
            yield (found if found >= max(free, first - HEADER_REACH) else max(free, first - 1)), last + 1
            free = last + 1

    def main_run(self, page: int) -> tuple[int, int] | None:
        """The run around the densest column of money of a page."""
        begin, end = np.searchsorted(self.page, [page, page + 1]).tolist()
        a, b = self.start[begin], self.start[end]
        cash = a + np.flatnonzero(self.kind[a:b] & CASH)
        if not len(cash):
            return None
        bins = np.round(self.x0[cash] / COLUMN_BIN) * COLUMN_BIN
        values, of, count = np.unique(bins, return_inverse=True, return_counts=True)
        met = np.full(len(values), len(self.line))
        np.minimum.at(met, of, self.place[cash])
        best = np.lexsort((met, -count))[0]  # of equals the first in reading order
        rows = np.unique(self.line[cash[np.abs(self.x0[cash] - values[best]) <= COLUMN_REACH]])
        if count[best] < 3 or len(rows) < 3:
            return None
        last = int(rows[-1])
        for k in range(last + 1, end):
            if k - last > 3:
                break
            if self.banded[k]:
                last = k
        first = int(rows[0])
        above = [k for k in range(max(begin, first - HEADER_REACH), first) if self.header[k]]
        header = above[-1] if above else first - 1
        return (header, last + 1) if header >= begin else None

    # --- columns ------------------------------------------------------------------------------------------------

    def columns(self, header: int, end: int) -> tuple[list[str], np.ndarray] | None:
        """(labels, column of each word of the body) of a run: by its values if it is dense, else by its header."""
        return self._by_values(header, end) or self._by_labels(header, end)

    def _body(self, header: int, end: int) -> slice:
        return slice(int(self.start[min(header + 1, end)]), int(self.start[end]))

    def _by_labels(self, header: int, end: int) -> tuple[list[str], np.ndarray] | None:
        groups, body = self.labels_of(header), self._body(header, end)
        if len(groups) < 2:
            return None
        x0, x1, y0 = self.x0[body], self.x1[body], np.round(self.y0[body])
        left = x1 < groups[0][0] - 4
        # where enough lines begin before the first label there is a column without one
        if left.any() and len(np.unique(y0[left])) >= max(2, 0.3 * len(np.unique(y0))):
            groups = [(float(x0[left].min()), float(x1[left].max()), ""), *groups]
        cuts = [(a[1] + b[0]) / 2 for a, b in zip(groups, groups[1:])]
        return [label for *_, label in groups], np.searchsorted(cuts, x0, side="right")

    def _by_values(self, header: int, end: int) -> tuple[list[str], np.ndarray] | None:
        body = self._body(header, end)
        kind, x0, x1 = self.kind[body], self.x0[body], self.x1[body]
        if np.count_nonzero(kind & NUMERIC) < 6:
            return None
        mark = (kind & MARK) > 0
        height = middle(sorted((self.y1[body] - self.y0[body]).tolist())) or USUAL_HEIGHT
        least = max(2, 0.12 * max(1, end - header - 1))
        edges = sorted(middle(c) for c in clusters(sorted(x1[mark].tolist()), max(LEAST_GAP, 1.2 * height)) if len(c) >= least)
        if len(edges) < 3:
            return None
        rights = np.array(edges)
        middles = (x0 + x1) / 2
        column = 1 + np.searchsorted((rights[:-1] + rights[1:]) / 2, np.where(mark, x1, middles), side="right")
        column[~mark & (x1 <= rights[0] - 2.0 * height)] = 0
        count = len(rights) + 1
        spans: list[list[float] | None] = [None] * count
        for c, a, b in zip(column.tolist(), x0.tolist(), x1.tolist()):
            span = spans[c]
            if span is None:
                spans[c] = [a, b]
            else:
                span[0], span[1] = min(span[0], a), max(span[1], b)
        centres = np.array([(span[0] + span[1]) / 2 if span and span[1] > 0 else edge for span, edge in zip(spans, [0.0, *edges])])
        return self._stacked_labels(header, float(self.anchor[header + 1]) if header + 1 < end else float(self.anchor[header]), height, centres), column

    def _stacked_labels(self, header: int, below: float, height: float, centres: np.ndarray) -> list[str]:
        """Labels of the columns from the header and the lines close above it; a rule under a word gives it to all columns over the rule."""
        top = header + 1
        while top and self.page[top - 1] == self.page[header] and not self.numeric[top - 1] and below - self.anchor[top - 1] <= 3.0 * height:
            top -= 1
            below = self.anchor[top]
        labels: list[dict[str, None]] = [{} for _ in centres]
        rules = self.rules.get(int(self.page[header]), ())
        for i in range(int(self.start[top]), int(self.start[header + 1])):
            at = (self.x0[i] + self.x1[i]) / 2
            spanned = [np.flatnonzero((centres >= a - 3) & (centres <= b + 3)) for y, a, b in rules if 0 <= y - self.y1[i] <= 7 and a - 2 <= at <= b + 2]
            wide = min((s for s in spanned if len(s) > 1), key=len, default=None)
            for c in wide if wide is not None else [int(np.abs(centres - at).argmin())]:
                labels[c].setdefault(self.text[i])
        return [" ".join(x).strip() for x in labels]

    # --- cells --------------------------------------------------------------------------------------------------

    def cells(self, header: int, end: int, column: np.ndarray, count: int) -> list[list[str]]:
        """Texts of the body's lines by column."""
        body = self._body(header, end)
        out: list[list[list[str]]] = [[[] for _ in range(count)] for _ in range(end - header - 1)]
        for line, c, text in zip((self.line[body] - header - 1).tolist(), column.tolist(), self.text[body]):
            out[line][c].append(text)
        return [[" ".join(cell).strip() for cell in line] for line in out]

    def table(self, header: int, end: int) -> Table | None:
        """The table of a run, None if no column holds enough numbers."""
        spec = self.columns(header, end)
        if spec is None:
            return None
        labels, column = spec
        lines = self.cells(header, end, column, len(labels))
        body = next((i for i, line in enumerate(lines) if line[0] or any(c.isdigit() for cell in line for c in cell)), len(lines))
        labels = [" ".join(filter(None, parts)).strip() for parts in zip(labels, *lines[:body])] if body else labels
        rows = [[" ".join(filter(None, cells)) for cells in zip(*(lines[i] for i in group))] for group in _rows(lines, body)]
        filled = [sum(bool(_MONEY.search(cell)) for cell in cells) for cells in zip(*rows)]
        if not rows or max(filled) < max(3, int(0.3 * len(rows))):
            return None
        top = float(self.y0[self.start[header] : self.start[header + 1]].min())
        under = self.y1[self.start[header + 1 + body] : self.start[end]]
        return Table(int(self.page[header]), labels, rows, top, float(under.max()) if len(under) else top)

    def tables(self) -> list[Table]:
        """All tables, by page and from top to bottom."""
        found = [t for t in (self.table(*run) for run in self.runs()) if t]
        return sorted(found, key=lambda t: (t.page, t.top))

    def main_table(self, page: int) -> Table | None:
        """The dominant table of a page: around the densest column of money, else under the header with the best aligned lines."""
        begin, end = np.searchsorted(self.page, [page, page + 1]).tolist()
        if self.start[end] - self.start[begin] < 4 or end - begin < 2:
            return None
        run = self.main_run(page)
        if run is None or self.columns(*run) is None:
            best, run = (0, 0), None
            for header in range(begin, end - 1):
                spec = self._by_labels(header, end) if self.header[header] else None
                if spec:
                    lines = self.cells(header, end, spec[1], len(spec[0]))
                    score = max(sum(bool(_MONEY.search(c)) for c in cells) for cells in zip(*lines)), sum(sum(map(bool, line)) >= 2 for line in lines)
                    if sum(score) and score > best:
                        best, run = score, (header, end)
        return self.table(*run) if run else None


def _rows(lines: list[list[str]], body: int) -> list[list[int]]:
    """Numbers of the lines that make up each row.

    A line without a number goes on with the row above unless it opens an item;
    so does a label that opens no item where the row above has no number yet.
    """
    groups: list[list[int]] = []
    numbered = False
    for i in range(body, len(lines)):
        if not any(lines[i]):
            continue
        number = any(map(_MONEY.search, lines[i]))
        item = bool(lines[i][0] and _ITEM.match(lines[i][0]))
        plain_label = bool(lines[i][0]) and not item
        if groups and not item and (not number or (plain_label and not numbered)):
            groups[-1].append(i)
            numbered = numbered or number
        else:
            groups.append([i])
            numbered = number
    return groups


def stacked(pages: Sequence[Sequence[tuple]], rules: dict[int, list[tuple[float, float, float]]]) -> Sheets | None:
    """Sheets of pages of (x0, y0, x1, y1, text); None without words."""
    words = [w for page in pages for w in page]
    if not words:
        return None
    number = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    x0, y0, x1, y1 = (np.array([w[k] for w in words], dtype=np.float64) for k in range(4))
    return Sheets(number, x0, y0, x1, y1, [w[4] for w in words], rules)


def tables_of(words: Sequence[tuple], rules: list[tuple[float, float, float]]) -> list[Table]:
    """All tables of a page, from top to bottom."""
    sheet = stacked([words], {0: rules})
    return sheet.tables() if sheet else []


def main_table(words: Sequence[tuple], rules: list[tuple[float, float, float]]) -> Table | None:
    sheet = stacked([words], {0: rules})
    return sheet.main_table(0) if sheet else None
