"""Problem 6: repair text from scanned pages into continuous paragraphs.

Margin lines (running heads, page numbers) are taken out, and the rest becomes a
stream of characters without lines. Over it words are decoded jointly: a token
may stay, be joined over a hyphen at a line's end, be merged with its neighbour,
be split, or be read with one of the known confusions, and the path of lowest
cost under the corpus' own word counts is taken. Ideographs have no word breaks;
there the counts of three-character contexts decide between look-alikes.
Paragraph boundaries are chosen by dynamic programming over the lines.

Counts are taken over all texts, and exact whatever their size: all contexts
travel to the workers, and all words but those seen once, which are the words
that stand in a text and have no count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: How many times as frequent a reading must be to replace what stands there.
RATIO = 20
#: Least count of a replacing word or context.
LEAST = 12

#: Letters beyond which a run is no word.
LONGEST_WORD = 60

# Shapes that recognition confuses, as read and as meant.
CONFUSIONS = "!:i 1:l 1:i 0:o 9:g 5:s 8:B |:l $:S c:e rn:m li:h w:vi m:rn h:li cl:d d:cl vv:w ii:u u:ii tl:d I:l l:I".split()
#: Pairs of look-alike ideographs and kana, either of which may be read for the other.
LOOKALIKES = (
    "期朝 管菅 已己 已巳 股肢 值植 率卒 审宙 人入 未末 险检 券卷 税悦 损捐 日曰 债侦 贷货 润涧 ー一 土士 天夭 大太 大犬 千干 干于 治冶 侯候 拔拨 折拆 折析 晴睛 徒徙 往住 住佳 酒洒 准淮 暑署 "
    "抵低 侵浸 复夏 质盾 优扰 仪议 设没 计汁 讨计 付什 历厉 万方 力刀 乌鸟 兔免 竞竟 幕慕 密蜜 博搏 购构 账帐 王玉 主王 目自 自白 白百 问间 间闻 贝见 今令 休体 本木 术木 各名 右石 田由 由甲 甲申 午牛 夫失 失矢 "
    "刊判 例列 便使 使史 特持 待侍 营菅 資賃 貸貨 員買 績積 績續 稅悅 損捐 債價 審宙 險檢 潤澗 值植 券卷 益盆 "
    "タ夕 ロ口 カ力 エ工 ハ八 ト卜 ニ二 ミ三 ソン シツ ヘへ"
).split()

# What reports call themselves.
TITLES = (
    r"(?:第[一二三四]季度|半年度|年度|季度|中期|全年|月度|[一二三四]季度)(?:报告|報告|业绩|業績)|业绩摘要|業績摘要|半?年报|半?年報|年次報告書|半期報告書|四半期報告書|四半期決算短信|決算短信|決算概要|決算の概要|業績概要|有価証券報告書|統合報告書"
    r"|(?:annual|interim|quarterly|half-?year(?:ly)?|semi-?annual)\s+(?:report|update|review|statement|results)|summary\s+of\s+results|results\s+summary"
    r"|geschäftsbericht|halbjahresbericht|quartalsbericht|quartalsmitteilung|zwischenbericht|jahresbericht|ergebnis(?:übersicht|zusammenfassung)|zusammenfassung\s+der\s+ergebnisse|kurzbericht"
    r"|rapport\s+(?:annuel|semestriel|trimestriel)|point\s+trimestriel|synthèse\s+des\s+résultats|résumé\s+des\s+résultats|informe\s+(?:anual|semestral|trimestral)|memoria\s+anual|resumen\s+de\s+resultados|avance\s+trimestral"
)
_YEAR = r"(?:19|20)\d\d"
_CO = r"(?:[㐀-鿿぀-ヿー]{2,14}(?:\s?(?:[A-Za-z]{1,12}|\d{1,3}))?|[A-ZÀ-Þ][\w'’.&\-]*(?:\s+(?:[A-ZÀ-Þ][\w'’.&\-]*|\d{1,3}|of|de|du|des|la|le|der|und|y|et|and|&)){0,5})"
_TITLE = rf"(?:(?i:{TITLES}))"
_SECTION = r"[^\s。！？!?；;|].{0,58}?[^。！？!?；;，,、.]"
_HEAD = re.compile(
    rf"^(?:\d{{1,4}}\s+)?(?:{_CO}\s*[|/·\-–—]?\s*(?:{_YEAR}\s*年?\s*)?{_TITLE}(?:\s+{_YEAR})?|{_YEAR}\s*年?\s*{_TITLE}\s*(?:[|/·\-–—]\s*|\s){_CO}|{_TITLE}\s*(?:[|/·\-–—]\s*|\s){_CO}(?:\s+{_YEAR})?|{_TITLE}\s*[ /|·]\s*{_SECTION}|{_SECTION}\s*[/|]\s*{_TITLE})(?:\s+\d{{1,4}})?$"
)
_HAS_TITLE = re.compile(TITLES, re.I)
#: Endings of the titles, for a look without regard to anything else.
_TITLE_PART = re.compile("报告|報告|业绩|業績|年报|年報|決算|概要|報告書|[Rr]eport|REPORT|[Uu]pdate|UPDATE|[Rr]esults|RESULTS|[Rr]eview|REVIEW|[Ss]tatement|STATEMENT|bericht|BERICHT|mitteilung|MITTEILUNG|[Ee]rgebni|ERGEBNI|[Rr]apport|RAPPORT|[Ii]nforme|INFORME|[Mm]emoria|MEMORIA|[Rr]és|RÉS|résultats|RÉSULTATS|[Rr]esumen|RESUMEN|[Aa]vance|AVANCE|[Pp]oint|POINT|[\uFF01-\uFF5E]{3}")
_NEVER_FIRST = frozenset("#|`!{<>\\=*~'")
_NEVER_LAST = frozenset("。；，,;")
_PAGE_WORD = r"(?:page|pag\.|pág(?:ina|\.)?|página|seite|p\.|pp\.|s\.|pg\.|no\.)"
_PAGE = re.compile(
    rf"^(?:[\-–—·•\s]{{0,4}}\d{{1,3}}[\-–—·•\s]{{0,4}}|\[\s*\d{{1,3}}\s*\]|[(<〈《]\s*\d{{1,3}}\s*[)>〉》]|{_PAGE_WORD}\s*\d{{1,4}}(?:\s*(?:/|of|von|de|sur|out of)\s*\d{{1,4}})?|\d{{1,4}}\s*(?:/|of|von|de|sur)\s*\d{{1,4}}"
    r"|第\s*\d{1,4}\s*[页頁](?:\s*[/,，]?\s*共\s*\d{1,4}\s*[页頁])?|共\s*\d{1,4}\s*[页頁]\s*[,，]?\s*第\s*\d{1,4}\s*[页頁]|\d{1,4}\s*(?:页|頁|ページ)(?:\s*/\s*\d{1,4}\s*(?:页|頁|ページ)?)?|[-–—]\s*(?:[ivxlc]{1,6}|[一二三四五六七八九十百]{1,5})\s*[-–—])$",
    re.I,
)
_DIGIT = re.compile(r"\d")
_MARKS = "-‐¬­"
_CUT = re.compile(rf"([^\W\d_][^\W\d_'’]*)[{_MARKS}]\s*$")
_TAIL = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!|$]+$")


def _plain(line: str) -> str:
    return re.sub(r"[​‌‍⁠﻿]", "", unicodedata.normalize("NFKC", line)).strip()


def margin(line: str) -> str | None:
    """"page_no" or "running_head" if the line is one."""
    bare = line.strip()
    if not bare or len(bare) > 100 or bare[-1] in _NEVER_LAST or bare[0] in _NEVER_FIRST:
        return None
    if len(bare) <= 24 and (len(bare) <= 6 or _DIGIT.search(bare)) and _PAGE.match(_plain(bare)):
        return "page_no"
    if _TITLE_PART.search(bare):
        plain = _plain(bare)
        if _HAS_TITLE.search(plain) and _HEAD.match(plain):
            return "running_head"
    return None


_CODE_START = re.compile(r"^\s*```")


def body_lines(lines: list[str]) -> tuple[list[str], set[str]]:
    """(lines without margins and code, kinds of margin lines met)."""
    kept, met, fenced = [], set(), False
    for line in lines:
        if "`" in line and _CODE_START.match(line):
            fenced = not fenced
            kept.append("")
            continue
        if fenced:
            continue
        kind = margin(line) if len(line) <= 104 else None
        if kind:
            met.add(kind)
        else:
            kept.append(line)
    return kept, met


# --- words ------------------------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W\d_]+(?:[!0-9|$][^\W\d_]+)*[!0-9|$]?(?![\w!])|[!0-9|$]{1,2}[^\W\d_]{2,}(?:[!0-9|$][^\W\d_]+)*(?![\w!])")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_ODD_NUMBER = re.compile(r"(?<=\d)[lOo](?=[\d.,%])|(?<=\d[.,])[lO](?=\d)|(?<![A-Za-zÀ-ÿ0-9_])[lO](?=\d{1,3}(?:[.,]\d|[%\s]|$))|(?<=[$€])[lO](?=\d)|(?<=[A-Z]{3})l(?=\d)")
#: Currencies, quarters, standards and the like with a number: no misread words.
_NO_WORD = re.compile(r"[A-Z]{1,4}[$|]?\d+[A-Za-z]?|\d+[A-Z]{1,4}")
_TOKEN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!|$]*[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ0-9!|$]*")


class Lexicon:
    """Word counts and the reading of single tokens, with a bounded memo."""

    def __init__(self, counts: dict[str, int], total: int) -> None:
        self.counts = counts
        self.total = max(1, total)
        self.memo: dict[str, str | None] = {}
        self.edges: dict[str, list[tuple[float, str | None, str]]] = {}
        self.swaps = [tuple(x.split(":")) for x in CONFUSIONS]

    def cost(self, word: str) -> float:
        n = self.counts.get(word.lower(), 0)
        return math.log(self.total / n) if n else math.log(self.total) + 2.0 * len(word)

    def readings(self, token: str) -> Iterator[str]:
        """Words that the token may be misread from: one confusion, or several of the same kind, or two kinds."""
        once = set()
        for read, meant in self.swaps:
            at = token.find(read)
            while at >= 0:
                once.add(token[:at] + meant + token[at + len(read) :])
                at = token.find(read, at + 1)
            if token.count(read) > 1:
                once.add(token.replace(read, meant))
        yield from once
        for word in once:
            for read, meant in self.swaps:
                at = word.find(read)
                while at >= 0:
                    yield word[:at] + meant + word[at + len(read) :]
                    at = word.find(read, at + 1)

    def misread(self, token: str) -> str | None:
        """The word meant, if the token is far more likely a misreading than itself."""
        if len(token) > LONGEST_WORD:
            return None
        if token in self.memo:
            return self.memo[token]
        own = self.counts.get(token.lower(), 1) if token.isalpha() else 0
        best, most = None, 0
        core = token.rstrip("!|$")
        if len(core) >= 3 and own * RATIO < self.total and (own == 0 or own * RATIO <= self.top):
            for word in self.readings(core):
                if word.isalpha() and word.lower() != core.lower():
                    n = self.counts.get(word.lower(), 0)
                    if n > most:
                        best, most = word, n
        found = best if most >= LEAST and most >= RATIO * max(own, 0.5) else None
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[token] = found
        return found

    @property
    def top(self) -> int:
        if not hasattr(self, "_top"):
            self._top = max(self.counts.values(), default=0)
        return self._top

    def known(self, word: str) -> bool:
        return self.counts.get(word.lower(), 0) >= 3

    def meant(self, token: str) -> str | None:
        """The word meant by a token that may be judged."""
        if token.isalpha():
            if len(token) < 4 or self.counts.get(token.lower(), 0) * RATIO > self.top:
                return None
        elif _NO_WORD.fullmatch(token) or sum(c.isdigit() for c in token) > max(2, len(token) // 2):
            return None
        return self.misread(token)

    def alone(self, token: str) -> list[tuple[float, str | None, str]]:
        """Edges (cost, new text, kind) of one token; the last is that it stays."""
        if token not in self.edges:
            edges: list[tuple[float, str | None, str]] = []
            if meant := self.meant(token):
                edges.append((self.cost(meant) + _CHANGE, meant, "ocr_char"))
            if parts := self.split(token):
                edges.append((sum(map(self.cost, parts)) + 4.0, " ".join(parts), "split"))
            elif parts := self.split_misread(token):
                edges.append((sum(map(self.cost, parts)) + 4.0 + _CHANGE, " ".join(parts), "split ocr_char"))
            if len(self.edges) > 500_000:
                self.edges.clear()
            self.edges[token] = [*edges, (self.cost(token), None, "")]
        return self.edges[token]

    def split(self, token: str) -> tuple[str, str] | None:
        best, cheapest = None, self.cost(token) - 4.0
        if 6 <= len(token) <= LONGEST_WORD and not self.known(token) and token.isalpha():
            for i in range(2, len(token) - 1):
                if self.known(token[:i]) and self.known(token[i:]):
                    cost = self.cost(token[:i]) + self.cost(token[i:])
                    if cost < cheapest:
                        best, cheapest = (token[:i], token[i:]), cost
        return best

    def split_misread(self, token: str) -> tuple[str, str] | None:
        """A known word and one that is misread, run together."""
        best, cheapest = None, math.inf
        if 8 <= len(token) <= LONGEST_WORD and not self.known(token):
            for i in range(3, len(token) - 2):
                left, right = token[:i], token[i:]
                if left.isalpha() and self.known(left):
                    parts = (left, self.meant(right)) if len(right) >= 4 else None
                elif right.isalpha() and self.known(right):
                    parts = (self.meant(left), right) if len(left) >= 4 else None
                else:
                    continue
                if parts and all(parts) and (cost := sum(map(self.cost, parts))) < cheapest:
                    best, cheapest = parts, cost
        return best


#: Stands in a stream where a line ended after a mark that may have cut a word.
_JOIN = "\ue000"
_CHANGE = math.log(RATIO)


def join_lines(lines: list[str]) -> str:
    """The stream without lines; a mark that may have cut a word stays, followed by _JOIN."""
    out: list[str] = []
    last = ""  # the part of the stream that the next line follows, "" at a break
    for line in lines:
        line = line.rstrip().replace(_JOIN, "")
        if not line:
            if last:
                out.append("\n")
                last = ""
            continue
        first = line[0]
        if first == "#" or first == "|":
            if last:
                out.append("\n")
            out.append(line + "\n" if first == "#" else "\n")
            last = ""
            continue
        start = line.lstrip() if first.isspace() else line
        if not last:
            out.append(start)
        elif last[-1] in _MARKS and _CUT.search(last) and _LATIN.match(start):
            out.append(_JOIN + start if _TAIL.search(last[:-1]) else start)
        else:
            # ideographs need no space, but one that begins the line is kept
            wide = (last[-1] > "\u2e80" or start[0] > "\u2e80") and not first.isspace()
            out.append(start if wide else " " + start)
        last = line
    return "".join(out)


def decode(stream: str, lexicon: Lexicon) -> list[tuple[int, int, str, str]]:
    """(begin, end, text, kinds) of the changes on the path of least cost through the stream's lattice.

    Nodes lie between tokens. Edges: a token stays, is misread or split; two that
    stand apart by a space are merged; the parts of a word cut at lines' ends are
    joined. The last two may be misread as well. A cut compound may keep its own
    hyphen where both parts are words.
    """
    tokens = list(_TOKEN.finditer(stream))
    n = len(tokens)
    skipped = [False] * n
    if _SKIP_SIGN.search(stream):
        spans = [m.span() for m in _SKIP.finditer(stream)]
        at = 0
        for i, m in enumerate(tokens):
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            skipped[i] = at < len(spans) and spans[at][0] < m.end()
    costs: list[float] = [0.0] + [math.inf] * n
    back: list[tuple[int, str | None, str]] = [(0, None, "")] * (n + 1)
    cut_after = [False] * n
    crossing = [0.0] * n
    words = [m.group(0) for m in tokens]
    apart = [False] * n
    for i in range(n - 1):
        a, b = tokens[i].end(), tokens[i + 1].start()
        if b - a == 1 and stream[a] == " ":
            apart[i] = True
        elif b - a == 2 and stream[a + 1] == _JOIN and stream[a] in _MARKS:
            cut_after[i] = True
            left, right = words[i], words[i + 1]
            whole = stream[a] == "-" and len(left) > 2 and len(right) > 2 and lexicon.known(left) and lexicon.known(right)
            crossing[i] = _CHANGE if whole else 1e3  # two words only where they are too long for one

    def edge(i: int, j: int, cost: float, text: str | None, kinds: str) -> None:
        cost += costs[i] + crossing[j - 1]
        if cost < costs[j]:
            costs[j], back[j] = cost, (i, text, kinds)

    for i, word in enumerate(words):
        for cost, text, kind in lexicon.alone(word)[-1:] if skipped[i] else lexicon.alone(word):
            edge(i, i + 1, cost, text, kind)
        if cut_after[i]:
            j, joined = i + 1, word
            while j < n and cut_after[j - 1] and len(joined) + len(words[j]) <= LONGEST_WORD:
                joined += words[j]
                j += 1
                if not any(skipped[i:j]) and (meant := lexicon.meant(joined)):
                    edge(i, j, lexicon.cost(meant) + _CHANGE, meant, "hyphen ocr_char")
                edge(i, j, lexicon.cost(joined), joined, "hyphen")
        elif apart[i] and not skipped[i] and not skipped[i + 1] and not (lexicon.known(word) and lexicon.known(words[i + 1])):
            joined = word + words[i + 1]
            if joined.isalpha() and lexicon.known(joined):
                edge(i, i + 2, lexicon.cost(joined) + _CHANGE, joined, "merge")
            elif meant := lexicon.meant(joined):
                edge(i, i + 2, lexicon.cost(meant) + 2 * _CHANGE, meant, "merge ocr_char")
    changes = []
    j = n
    while j:
        i, text, kinds = back[j]
        if text is not None:
            changes.append((tokens[i].start(), tokens[j - 1].end(), text, kinds))
        j = i
    return changes[::-1]


def decoded(stream: str, lexicon: Lexicon) -> tuple[str, set[str]]:
    """(stream with the changes made, their kinds)."""
    out, end, met = [], 0, set()
    for a, b, text, kinds in decode(stream, lexicon):
        out += (stream[end:a], text)
        end = b
        met.update(kinds.split())
    return "".join([*out, stream[end:]]).replace(_JOIN, ""), met


# --- ideographs -------------------------------------------------------------------------------------------------

_PARTNERS: dict[int, list[int]] = {}
for _a, _b in LOOKALIKES:
    if ord(_b) not in _PARTNERS.setdefault(ord(_a), []):
        _PARTNERS[ord(_a)].append(ord(_b))
    if ord(_a) not in _PARTNERS.setdefault(ord(_b), []):
        _PARTNERS[ord(_b)].append(ord(_a))
_SET = np.array(sorted(_PARTNERS), dtype=np.int64)
_WIDTH = max(map(len, _PARTNERS.values()))
_OTHERS = np.zeros((len(_SET), _WIDTH), dtype=np.int64)
for _i, _c in enumerate(_SET):
    _OTHERS[_i, : len(_PARTNERS[int(_c)])] = _PARTNERS[int(_c)]
_IN_SET = np.zeros(0x110000, dtype=bool)
_IN_SET[_SET] = True
_HAN = np.zeros(0x110000, dtype=bool)
for _begin, _end in ((0x3041, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
    _HAN[_begin:_end] = True


def _stream_codes(stream: str) -> np.ndarray:
    codes = np.frombuffer(stream.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    # whatever isn't an ideograph or kana is one and the same neighbour
    return np.r_[1, 1, np.where(_HAN[codes], codes, 1), 1, 1]


def _keys(codes: np.ndarray, at: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Keys of the three contexts of the characters at ``at`` if they were ``middle``: [context, position]."""
    p2, p1, n1, n2 = codes[at - 2], codes[at - 1], codes[at + 1], codes[at + 2]
    return np.stack([p2 << 42 | p1 << 21 | middle, p1 << 42 | middle << 21 | n1, (middle << 42 | n1 << 21 | n2)])


_WIDE_BREAK = re.compile(r"(?<=[\u3041-\u30ff\u3400-\u9fff])\r?\n(?=[\u3041-\u30ff\u3400-\u9fff])")


def context_counts(stream: str) -> tuple[np.ndarray, np.ndarray]:
    codes = _stream_codes(stream)
    at = np.flatnonzero(_IN_SET[codes])
    return np.unique(_keys(codes, at, codes[at]), return_counts=True) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Contexts:
    """Counts of contexts as sorted keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(keys.shape, dtype=np.int64)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.counts[i], 0)

    def misread(self, stream: str) -> list[tuple[int, str]]:
        """(position, character meant) of look-alikes in the wrong place."""
        codes = _stream_codes(stream)
        at = np.flatnonzero(_IN_SET[codes])
        found: dict[int, str] = {}
        if not len(at):
            return []
        mine = codes[at]
        own = self.of(_keys(codes, at, mine))
        index = np.searchsorted(_SET, mine)
        for column in range(_WIDTH):
            other = _OTHERS[index, column]
            has = np.flatnonzero(other > 0)
            if not len(has):
                continue
            theirs = self.of(_keys(codes, at[has], other[has]))
            mine_n = own[:, has]
            # a context between two non-ideographs says nothing
            better = ((theirs >= LEAST) & (theirs >= RATIO * np.maximum(mine_n, 0.5))).any(axis=0)
            never_worse = (theirs >= mine_n).all(axis=0)
            for i in has[better & never_worse]:
                found.setdefault(int(at[i]) - 2, chr(int(other[i])))
        return sorted(found.items())


# --- items ------------------------------------------------------------------------------------------------------


def _lines(elements: list[str | None]) -> list[str]:
    return [line for e in elements if e for line in e.split("\n")]


def noises(items: list[list[str | None] | None], lexicon: Lexicon, contexts: Contexts) -> list[list[str]]:
    """Sorted kinds of noise of each item; the ideographs of all items are looked up together."""
    found: list[set[str]] = []
    streams: list[str] = []
    for elements in items:
        kept, met = body_lines(_lines(elements or []))
        stream = join_lines(kept)
        fixed, kinds = decoded(stream, lexicon)
        met |= kinds & {"hyphen", "ocr_char"}
        prose = _SKIP.sub(" ", fixed) if _SKIP_SIGN.search(fixed) else fixed
        if _ODD_NUMBER.search(prose):
            met.add("ocr_char")
        found.append(met)
        streams.append(prose)
    starts = np.cumsum([0, *(len(x) + 1 for x in streams)])
    for at, _ in contexts.misread("\n".join(streams)):
        found[int(np.searchsorted(starts, at, side="right")) - 1].add("ocr_char")
    return [sorted(met) for met in found]


#: Code, links, formulas and markup hold no words to be judged.
_SKIP = re.compile(r"`[^`\n]{0,500}`|https?://\S+|\]\([^()\s]*\)|!?\[\[[^\]\n]{0,200}\]\]|\\[A-Za-z]+|</?[A-Za-z][^<>\n]{0,200}>|&#?\w{1,10};|\$[^$\n]{0,160}\$|\{\|[^\n]*|\b\w*_\w+\b|[A-Za-z0-9]{30,}")
_SKIP_SIGN = re.compile(r"[`\[<&$\\_{]|https?:|[A-Za-z0-9]{30}")
_END = re.compile(r"[。！？!?.:：;；]['\"”’」』）)]*\s*$")
_ITEM = re.compile(r"^\s*(?:#{1,6}\s|[-•*·]\s|\d{1,3}[.)、]\s|[（(]?[一二三四五六七八九十]{1,3}[）)、.]|\|)")


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Lines grouped into paragraphs at least cost.

    A boundary after a line costs little where it ends a sentence short of the
    usual width or where the next line opens an item, much inside a sentence; a
    paragraph of one unfinished line costs extra.
    """
    solid = [line.rstrip("\r") for line in lines]
    n = len(solid)
    if not n:
        return []
    blank = [not x.strip() for x in solid]
    widths = sorted(len(x) for x, b in zip(solid, blank) if not b)
    usual = widths[len(widths) * 3 // 4] if widths else 0
    ended = [bool(_END.search(x)) for x in solid]
    fixed = [x.lstrip().startswith(("#", "|")) for x in solid]
    item = [bool(_ITEM.match(x)) for x in solid]
    parted = [i == n - 1 or blank[i] or blank[i + 1] or item[i + 1] or fixed[i] for i in range(n)]  # after line i
    # short of the usual width, or so long that the text isn't wrapped there
    odd = [not 0.9 * usual <= len(x) <= 1.3 * usual for x in solid]
    boundary = [0.0 if parted[i] else 6.0 if not ended[i] else 0.5 if odd[i] else 2.0 for i in range(n)]
    stay = [8.0 if parted[i] else 1.0 if ended[i] else 0.0 for i in range(n)]
    alone = [0.0 if blank[i] or ended[i] else 1.0 for i in range(n)]
    # least cost up to line i, where it opens a paragraph or goes on with one
    opens, goes_on = [0.0], [math.inf]
    opened_after, went_on_after = [0], [0]  # whether the line before had gone on (1) or opened (0)
    for i in range(1, n):
        ends = (opens[-1] + alone[i - 1], goes_on[-1])
        opened_after.append(int(ends[1] < ends[0]))
        went_on_after.append(int(goes_on[-1] < opens[-1]))
        opens.append(min(ends) + boundary[i - 1])
        goes_on.append(min(opens[-2], goes_on[-1]) + stay[i - 1])
    on = goes_on[-1] < opens[-1] + alone[-1]
    starts = []
    for i in range(n - 1, -1, -1):
        if not on:
            starts.append(i)
        on = bool((went_on_after if on else opened_after)[i])
    starts = [0, *[x for x in starts[::-1] if x]]
    groups = [solid[a:b] for a, b in zip(starts, [*starts[1:], n])]
    return [g for g in groups if any(x.strip() for x in g)]


def repair(elements: list[str | None], lexicon: Lexicon, contexts: Contexts) -> list[str]:
    """Continuous paragraphs of an item, with hyphens joined and misread characters put right."""
    kept, _ = body_lines(_lines(elements))
    out = []
    for group in paragraphs(kept):
        if group[0].lstrip().startswith(("#", "|")):
            out.append("\n".join(group))
            continue
        stream = join_lines(group).strip("\n")
        letters = list(stream)
        for at, meant in contexts.misread(stream):
            letters[at] = meant
        stream = "".join(letters)
        stream = decoded(stream, lexicon)[0]
        out.append(_ODD_NUMBER.sub(lambda m: "1" if m.group(0) == "l" else "0", stream))
    return out


# --- Spark ------------------------------------------------------------------------------------------------------


def items_of(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (item, item_key, lines) of chunk texts and node bodies."""
    a = chunks.select(F.lit("chunk").alias("item"), F.col("chunk_key").alias("item_key"), F.array(F.col("text")).alias("elements"))
    b = nodes.select(F.lit("node").alias("item"), F.col("node_key").alias("item_key"), F.col("body").alias("elements"))
    return a.unionByName(b)


def corpus_counts(items: DataFrame) -> tuple[dict[str, int], int, np.ndarray, np.ndarray]:
    """(word counts from 2 on, number of words, context keys, context counts) over all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        contexts: dict[int, int] = {}
        total = 0

        def flush() -> pa.RecordBatch:
            kind = [0] * len(words) + [1] * len(contexts) + [2]
            text = list(words) + [None] * len(contexts) + [None]
            key = [None] * len(words) + list(contexts) + [None]
            n = list(words.values()) + list(contexts.values()) + [total]
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(text, pa.string()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["kind", "word", "key", "n"])

        for batch in batches:
            joined = "\n".join(e for elements in batch.column(0).to_pylist() if elements for e in elements if e)
            found = _LATIN.findall(joined)
            total += len(found)
            for word, n in Counter(found).items():
                words[word.lower()] += n
            # lines break anywhere between ideographs, so their contexts are counted over the breaks
            joined = _WIDE_BREAK.sub("", joined)
            keys, counts = context_counts(joined)
            for key, n in zip(keys.tolist(), counts.tolist()):
                contexts[key] = contexts.get(key, 0) + n
            if len(words) + len(contexts) > 2_000_000:  # hand over what is summed up so far
                yield flush()
                words, contexts, total = Counter(), {}, 0
        yield flush()

    counted = items.select("elements").mapInArrow(run, "kind int, word string, key bigint, n bigint").groupBy("kind", "word", "key").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    words_total = counted.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    kept = counted.where("kind = 1 OR kind = 0 AND n >= 2").toArrow()
    kind = kept.column("kind").to_numpy()
    n = kept.column("n").to_numpy()
    words = dict(zip(kept.column("word").filter(pa.array(kind == 0)).to_pylist(), n[kind == 0].tolist()))
    keys = kept.column("key").filter(pa.array(kind == 1)).to_numpy(zero_copy_only=False).astype(np.int64)
    return words, words_total, keys, n[kind == 1]


def _over_items(items: DataFrame, schema: str, each) -> DataFrame:
    words, total, keys, counts = corpus_counts(items)
    shared = items.sparkSession.sparkContext.broadcast((words, total, keys, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, keys, counts = shared.value
        lexicon, contexts = Lexicon(words, total), Contexts(keys, counts)
        for batch in batches:
            yield each(batch, lexicon, contexts)

    return items.mapInArrow(run, schema)


def scan_noise(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (item, item_key, noise): each kind of noise that the repair of an item met.

    Null and empty texts, bodies and elements have none. Repeated rows give one
    row; other columns are not read; empty tables give an empty table.
    """

    def each(batch: pa.RecordBatch, lexicon: Lexicon, contexts: Contexts) -> pa.RecordBatch:
        found = noises(batch.column(2).to_pylist(), lexicon, contexts)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["item", "item_key", "noises"])

    met = _over_items(items_of(chunks, nodes), "item string, item_key bigint, noises array<string>", each)
    return met.select("item", "item_key", F.explode("noises").alias("noise")).distinct()


def repaired(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (item, item_key, paragraph_no, text); an item without text has no row."""

    def each(batch: pa.RecordBatch, lexicon: Lexicon, contexts: Contexts) -> pa.RecordBatch:
        out = [repair(elements or [], lexicon, contexts) for elements in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], names=["item", "item_key", "texts"])

    done = _over_items(items_of(chunks, nodes), "item string, item_key bigint, texts array<string>", each)
    return done.select("item", "item_key", F.posexplode("texts").alias("paragraph_no", "text")).withColumn("paragraph_no", F.col("paragraph_no") + 1)
