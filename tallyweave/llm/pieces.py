"""Problem 2: cut oversized texts at natural boundaries, with overlap.

Structure-tree packing. A text is a tree: sections under headings of rising
level, blocks (paragraphs, lists, tables, code), lines or list items, sentences,
clauses, words, changes between digits and letters. Only a node over the limit is descended into; on the way back
sibling subtrees are merged as long as they fit.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts

_LIST = re.compile(r"[ \t]*(?:[-*+•·]|\d{1,3}[.)、]|[（(]?[一二三四五六七八九十]{1,3}[）)、])\s*")
_HEADING = re.compile(r"(#{1,6})\s")
_SENTENCE = re.compile(r"[。！？!?；;]+[”’」』）)\"']*|\.(?=\s)|\.$", re.M)
_CLAUSE = re.compile(r"[，、,:：]+")
_WORD = re.compile(r"\s+")
_SHIFT = re.compile(r"(?<=\d)(?=[^\W\d])|(?<=[a-z])(?=[A-Z])")


def _line_levels(text: str) -> list[tuple[int, int]]:
    """(start, level) of every line: 1-6 a heading, 7 a new block, 8 a line inside one."""
    out, start, kind_before, fenced, blank = [], 0, "", False, False
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        heading = None if fenced else _HEADING.match(line)
        if bare.startswith("```"):
            kind, fenced, opens = "code", not fenced, not fenced
        elif fenced:
            kind, opens = "code", False
        elif heading:
            kind, opens = "heading", True
        elif not bare:
            kind, opens = kind_before, False
            blank = True
        else:
            kind = "table" if bare.startswith(("|", "<table", "<tr")) else "list" if _LIST.match(line) else "text"
            opens = (kind != kind_before and kind_before != "heading") or (blank and kind_before != "heading")
            # every plain line is a paragraph of its own unless its predecessor breaks off inside a sentence
            if kind == kind_before == "text" and not opens:
                opens = bool(re.search(r"[。！？.!?:：；;]\s*$", text[max(0, start - 8) : start]))
        out.append((start, len(heading.group(1)) if heading else 7 if opens else 8))
        if bare:
            kind_before, blank = kind, False
        start += len(line)
    return out


class _Tree:
    """Boundaries of a text by level; a node is a span, its children lie between boundaries of the next level."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.lines = _line_levels(text)
        self.starts = [at for at, _ in self.lines]

    def _inside(self, pattern: re.Pattern, begin: int, end: int) -> list[int]:
        return [m.end() for m in pattern.finditer(self.text, begin, end)]

    def children(self, begin: int, end: int, level: int) -> list[tuple[int, int]]:
        if level <= 8:
            within = self.lines[bisect_right(self.starts, begin) : bisect_left(self.starts, end)]
            cuts = [at for at, kind in within if kind <= level]
        elif level == 9:
            cuts = self._inside(_SENTENCE, begin, end)
        elif level == 10:
            cuts = self._inside(_CLAUSE, begin, end)
        elif level == 11:
            cuts = self._inside(_WORD, begin, end)
        else:
            cuts = self._inside(_SHIFT, begin, end)
        edges = [begin, *sorted({c for c in cuts if begin < c < end}), end]
        return list(zip(edges, edges[1:]))

    def hard(self, begin: int, end: int, limit: int) -> list[tuple[int, int]]:
        """No boundary is left: cut at the limit, but not before a combining mark."""
        out = []
        while end - begin > limit:
            cut = begin + limit
            while cut > begin + 1 and (unicodedata.combining(self.text[cut]) or self.text[cut] in "‍︎️"):
                cut -= 1
            out.append((begin, cut))
            begin = cut
        return [*out, (begin, end)]

    def pack(self, begin: int, end: int, limit: int, level: int = 1) -> list[tuple[int, int]]:
        if end - begin <= limit:
            return [(begin, end)]
        if level > 12:
            return self.hard(begin, end, limit)
        parts = self.children(begin, end, level)
        if len(parts) == 1:
            return self.pack(begin, end, limit, level + 1)
        out: list[tuple[int, int]] = []
        for part in parts:
            for unit in self.pack(*part, limit, level + 1):
                if out and unit[1] - out[-1][0] <= limit:
                    out[-1] = (out[-1][0], unit[1])
                else:
                    out.append(unit)
        return out


def cut(text: str, max_chars: int | None, overlap: int | None) -> list[tuple[int, int, int]]:
    """Spans (start of the repeated part, start of the new part, end) of the pieces.

    The new parts follow each other without gap and cover the text. A missing or
    non-positive limit means none; the overlap is held below the limit, and a
    predecessor shorter than the overlap is repeated whole.
    """
    if not text or not max_chars or max_chars < 1 or len(text) <= max_chars:
        return [(0, 0, len(text or ""))]
    overlap = max(0, min(overlap or 0, max_chars - 1))
    limit = max_chars - overlap
    tree = _Tree(text)
    spans = tree.pack(0, len(text), limit)
    i = 0
    while i < len(spans) - 1:  # a piece too short to be repeated is filled from its successor
        begin, end = spans[i]
        if end - begin < min(overlap, limit) and spans[i + 1][1] - begin > limit:
            edges = [b for level in (8, 9, 10, 11, 12) for _, b in tree.children(begin, spans[i + 1][1], level) if overlap <= b - begin <= limit]
            middle = max(edges, default=begin + limit)
            spans[i : i + 2] = [(begin, middle), (middle, spans[i + 1][1])]
        i += 1
    return [(max(0, begin - overlap) if i else 0, begin, end) for i, (begin, end) in enumerate(spans)]


def split_oversized(chunks: DataFrame, limits: DataFrame, key: str = "chunk_key", text: str = "text") -> DataFrame:
    """Rows (key, piece_no, n_pieces, char_start, n_repeated, text, section_path, page_start).

    ``chunks`` has the key, profile, section_path, page_start and text, ``limits``
    profile, chunk_max_chars and chunk_overlap_chars. Lengths are code points. A
    text within its limit, a null or empty text, and a text without a limit (no
    such profile, null or non-positive limit) is one piece. If a profile stands
    twice, its smallest limit and largest overlap hold. Repeated rows are cut
    each on their own; an empty table gives an empty table.
    """
    bounds = limits.groupBy("profile").agg(F.min("chunk_max_chars").alias("_max"), F.max("chunk_overlap_chars").alias("_overlap"))
    rows = chunks.select(F.col(key).alias("_key"), F.col("profile"), F.col("section_path").alias("_path"), F.col("page_start").alias("_page"), F.col(text).alias("_text")).join(bounds, "profile", "left")
    over = (F.col("_max") >= 1) & (F.length("_text") > F.col("_max"))
    small = rows.where(~F.coalesce(over, F.lit(False))).select(
        F.col("_key").alias(key), F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("char_start"), F.lit(0).alias("n_repeated"),
        F.col("_text").alias("text"), F.col("_path").alias("section_path"), F.col("_page").alias("page_start"),
    )

    def make():
        def kernel(batch: dict[str, list]) -> pa.RecordBatch:
            out: list[tuple] = []
            for k, path, page, body, most, overlap in zip(*(batch[c] for c in ("key", "path", "page", "text", "max", "overlap"))):
                spans = cut(body, most, overlap)
                out += [(k, i + 1, len(spans), begin, begin - shown, body[shown:end], path, page) for i, (shown, begin, end) in enumerate(spans)]
            columns = list(zip(*out))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, "piece_no", "n_pieces", "char_start", "n_repeated", "text", "section_path", "page_start"])

        return kernel

    schema = f"`{key}` bigint, piece_no int, n_pieces int, char_start int, n_repeated int, text string, section_path array<string>, page_start int"
    inputs = {"key": "_key", "path": "_path", "page": "_page", "text": "_text", "max": "_max", "overlap": "_overlap"}
    return map_texts(rows.where(over), inputs, schema, make).unionByName(small)


def oversized(chunks: DataFrame, limits: DataFrame, key: str = "chunk_key") -> DataFrame:
    """Keys of the texts that ``split_oversized`` cut."""
    return split_oversized(chunks, limits, key).where((F.col("n_pieces") > 1) & (F.col("piece_no") == 1)).select(key).distinct()
