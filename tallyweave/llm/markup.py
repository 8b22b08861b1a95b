"""Problem 5: turn HTML, Markdown, wiki and LaTeX residue into clean structured text.

A converter recognises the constructs of the four languages and rewrites them:
headings become lines with ``#``, lists ``-`` lines, tables pipe rows, code stays
between fences and formulas between dollar signs; everything else of the markup
goes. The kinds that it met come out with the text.

Afterwards a suffix array over the token streams of a report's pages finds long
runs repeated on several distinct pages; what they cover is boilerplate, which
stays once. A suffix array tells repeated text only, not markup, so it
can't name kinds of residue: those come from the converter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts
from .spans import enclosed, replaced

KINDS = ("html", "markdown", "wiki", "latex")
# Names of HTML elements.
TAGS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del div dl dt em figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav noscript ol option p pre q s script section select small "
    "span strike strong style sub sup table tbody td textarea tfoot th thead title tr tt u ul var"
)
# LaTeX commands that stand without an argument.
COMMANDS = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega "
    "approx times cdot cdots ldots dots leq geq neq le ge ne pm mp div sum prod int infty partial nabla to rightarrow leftarrow Rightarrow in notin subset cup cap forall exists sim equiv propto quad qquad "
    "hline toprule midrule bottomrule cline item newline newpage noindent par centering small large bf it left right tableofcontents maketitle today LaTeX TeX"
)
_TAG = "|".join(sorted(TAGS.split(), key=len, reverse=True))
_COMMAND = "|".join(sorted(COMMANDS.split(), key=len, reverse=True))

#: What a text must hold to be looked at closely.
_ANY = re.compile(r"[`~<\\]|&[#\w]|\*\S|_\S|\]\(|\[\^|^[ \t]*>|''|\[\[|\{\{|^[ \t]*==|^[ \t]*\{\||\$\S|\[https?:", re.M)

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n(?P<body>.*?)^[ \t]*\1[ \t]*$", re.M | re.S)
_HTML = re.compile(rf"</?(?:{_TAG})(?:\s[^<>]*|/)?>|</(?:{_TAG})\b|<(?:{_TAG})\s+[a-z]+=|<!--|<!doctype|<\?xml|&(?P<entity>[A-Za-z][A-Za-z0-9]{{1,30}}|#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}});", re.I)
_MARKDOWN = re.compile(
    r"```|`[^`\n]+`|\*\*(?=\S)[^*\n]+\*\*|(?<!\w)__(?=[^\s_])[^\n]*?[^\s_]__(?!\w)|~~(?=\S)[^~\n]+~~|!?\[[^\[\]\n]*\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)"
    r"|^[ \t]*>[ \t]?(?=\S)|\[\^[\w-]{1,12}\]|(?<![\w*\\])\*(?=[^\s*])[^*\n]*?[^\s*]\*(?![\w*])|(?<![\w*\\])\*[^\s*]\*(?![\w*])|(?<![\w\\])_(?=[^\s_])[^_\n]*[^\s_]_(?!\w)",
    re.M,
)
_WIKI = re.compile(
    r"'{2,5}(?=[^'\s])[^'\n]*(?:'[^'\n]+)*'{2,5}|\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|^[ \t]*(={2,6})[ \t]*[^=\n]+?[ \t]*\1[ \t]*$|^[ \t]*\{\|.*$|^[ \t]*\|\}[ \t]*$|</?ref\b[^<>]*>|\[https?://[^\s\]]+ [^\]\n]+\]|__(?:TOC|NOTOC)__|#REDIRECT\b",
    re.M,
)
_LATEX = re.compile(
    rf"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{{|\\(?:{_COMMAND})(?![A-Za-z])|\\begin\b|\\end\b|(?<=\d)\\%|\$\$[^$\n]+\$\$"
    r"|(?<![\w$])\$(?=[^\s$])[^$\n぀-鿿]*?(?:[_^]\{|\\[A-Za-z]+|[A-Za-z)][_^][A-Za-z0-9])[^$\n぀-鿿]*?\$(?!\d)",
    re.S,
)
_CODE = re.compile(r"`[^`\n]+`")
#: Formulas set off by brackets; they don't run over a blank line.
_FORMULAS = [(re.compile(r"\\\("), re.compile(r"\\\)"), "$"), (re.compile(r"\\\["), re.compile(r"\\\]"), "$$")]
_COMMENT = re.compile("<!--"), re.compile("-->")
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|", re.M), re.compile(r"^[ \t]*\|\}[ \t]*$", re.M)


def _is_html(m: re.Match) -> bool:
    entity = m.group("entity")
    return entity is None or entity[0] == "#" or entity + ";" in html5


def kinds(text: str | None) -> set[str]:
    """Kinds of residue in a text. Code between fences or ticks is looked at for none but Markdown."""
    found: set[str] = set()
    if not text or not _ANY.search(text):
        return found
    if _MARKDOWN.search(text):
        found.add("markdown")
    bare = _CODE.sub(" ", _FENCE.sub("\n", text)) if "`" in text or "~~~" in text else text
    if any(map(_is_html, _HTML.finditer(bare))):
        found.add("html")
    if _WIKI.search(bare):
        found.add("wiki")
    if "\\" in bare or "$" in bare:
        if _LATEX.search(bare) or any(b - a > 4 for opener, closer, _ in _FORMULAS for a, b in enclosed(bare, opener, closer, near=True)):
            found.add("latex")
    return found


# --- conversion -------------------------------------------------------------------------------------------------


def _rows(cells: Iterator[list[str]]) -> str:
    rows = [[re.sub(r"\s+", " ", c).strip().replace("|", r"\|") for c in row] for row in cells]
    rows = [r for r in rows if any(r)]
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    if lines:
        lines.insert(1, "|" + " --- |" * width)
    return "\n" + "\n".join(lines) + "\n" if lines else "\n"


def _html_table(m: re.Match) -> str:
    rows = re.split(r"<tr\b[^<>]*>", m.group(0), flags=re.I)
    return _rows([re.sub(r"<[^<>]*>?", "", c) for c in re.split(r"<t[dh]\b[^<>]*>", r, flags=re.I)[1:]] for r in rows)


def _from_html(text: str) -> str:
    # of a comment that nothing closes only the mark goes: what follows may be content
    text = replaced(text, *_COMMENT, lambda comment: "").replace("<!--", "")
    text = re.sub(r"<(script|style)\b.*?</\1\s*>", "", text, flags=re.S | re.I)
    text = re.sub(r"<table\b.*?</table\s*>", _html_table, text, flags=re.S | re.I)
    text = re.sub(r"<h([1-6])\b[^<>]*>\s*(.*?)\s*</h\1\s*>", lambda m: "\n" + "#" * int(m.group(1)) + " " + m.group(2) + "\n", text, flags=re.S | re.I)
    text = re.sub(r"<pre\b[^<>]*>(.*?)</pre\s*>", lambda m: "\n```\n" + m.group(1).strip("\n") + "\n```\n", text, flags=re.S | re.I)
    text = re.sub(r"<li\b[^<>]*>\s*", "\n- ", text, flags=re.I)
    text = re.sub(r"<br\b[^<>]*>", "", text, flags=re.I) if re.search(r"\w<br\b[^<>]*>[a-z\u3040-\u9fff]", text, re.I) else re.sub(r"<br\b[^<>]*>", "\n", text, flags=re.I)
    text = re.sub(r"</(?:p|div|ul|ol|tr|li|blockquote|section|article)\s*>", "\n", text, flags=re.I)
    text = re.sub(rf"</?(?:{_TAG})(?:\s[^<>]*|/)?>|</(?:{_TAG})\b>?|<!doctype[^<>]*>", "", text, flags=re.I)
    return re.sub(r"&(#?\w{1,31});", lambda m: html.unescape(m.group(0)).replace("\xa0", " "), text)


def _wiki_table(table: str) -> str:
    rows: list[list[str]] = [[]]
    for line in table.splitlines()[1:]:
        line = line.strip()
        if line.startswith("|-"):
            rows.append([])
        elif line[:1] in "|!" and not line.startswith(("|}", "|+")):
            rows[-1] += re.split(r"\|\||!!", line[1:])
    return _rows(iter(rows))


def _from_wiki(text: str) -> str:
    if "|}" in text:
        text = replaced(text, *_WIKI_TABLE, _wiki_table)
    text = re.sub(r"^[ \t]*(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m.group(1)) + " " + m.group(2), text, flags=re.M)
    text = re.sub(r"\[\[(?:Category|File|Image|分类|文件)\s*:[^\[\]\n]*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]+)\]\]", r"\1", text)
    text = re.sub(r"\{\{[^{}|\n]*\|?([^{}\n]*)\}\}", lambda m: " ".join(p.rpartition("=")[2] for p in m.group(1).split("|")), text)
    text = re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", text)
    text = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|__(?:TOC|NOTOC)__", "", text, flags=re.S)
    return re.sub(r"'{2,5}(?=[^'\s])([^'\n]*(?:'[^'\n]+)*?)'{2,5}", r"\1", text)


def _latex_table(m: re.Match) -> str:
    body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^{}]*\})", "", m.group(1))
    return _rows([re.split(r"(?<!\\)&", row) for row in re.split(r"\\\\", body)])


def _from_latex(text: str) -> str:
    text = re.sub(r"\\begin\{(?:tabular|array|longtable)\*?\}(?:\{[^{}]*\})*(.*?)\\end\{(?:tabular|array|longtable)\*?\}", _latex_table, text, flags=re.S)
    for opener, closer, sign in _FORMULAS:
        text = replaced(text, opener, closer, lambda formula: f"{sign}{formula[2:-2].strip()}{sign}" if len(formula) > 4 else formula, near=True)
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m.group(0))
        return f"\x00{len(kept) - 1}\x00"

    text = re.sub(r"\$\$[^$]+\$\$|\$[^$\n]*[\\^_][^$\n]*\$", keep, text)
    text = re.sub(r"\\((?:sub)*)section\*?\{([^{}]*)\}", lambda m: "#" * (2 + len(m.group(1)) // 3) + " " + m.group(2), text)
    text = re.sub(r"\\item\b\s*", "- ", text)
    for _ in range(3):
        text = re.sub(r"\\(?:begin|end|label|cite|ref|footnotemark)\{[^{}]*\}", "", text)
        text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\(?:hline|newline|newpage|noindent|par|centering|maketitle|tableofcontents)\b", "", text)
    text = re.sub(r"\\([%&_#{}])", r"\1", text)
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m.group(1))], text)


def _from_markdown(text: str) -> str:
    text = re.sub(r"!\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1", text)
    text = re.sub(r"\[([^\[\]\n]*)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)", r"\1", text)
    text = re.sub(r"^[ \t]*\[\^[\w-]{1,12}\]:[ \t]*", "", text, flags=re.M)
    text = re.sub(r"\[\^[\w-]{1,12}\]", "", text)
    text = re.sub(r"^([ \t]*)>[ \t]?(?=\S)", r"\1", text, flags=re.M)
    text = re.sub(r"\*\*(?=\S)([^*\n]+)\*\*|(?<!\w)__(?=[^\s_])([^\n]*?[^\s_])__(?!\w)|~~(?=\S)([^~\n]+)~~", lambda m: next(g for g in m.groups() if g is not None), text)
    text = re.sub(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])|(?<![\w\\])_(?=[^\s_])([^_\n]*[^\s_])_(?!\w)", lambda m: next(g for g in m.groups() if g is not None), text)
    return re.sub(r"`([^`\n]+)`", r"\1", text)


def convert(text: str | None) -> tuple[str | None, set[str]]:
    """(clean text, kinds of residue that were in it)."""
    found = kinds(text)
    if not found:
        return text, found
    out, at = [], 0
    fences = list(_FENCE.finditer(text)) if "```" in text or "~~~" in text else []
    for m in [*fences, None]:
        part = text[at : m.start() if m else len(text)]
        codes: list[str] = []
        if "`" in part and found - {"markdown"}:  # code between ticks is no markup of the other languages

            def hide(code: re.Match) -> str:
                codes.append(code.group(0))
                return f"\x01{len(codes) - 1}\x01"

            part = _CODE.sub(hide, part)
        for kind, change in (("html", _from_html), ("wiki", _from_wiki), ("latex", _from_latex)):
            if kind in found:
                part = change(part)
        if codes:
            part = re.sub(r"\x01(\d+)\x01", lambda n: codes[int(n.group(1))] if int(n.group(1)) < len(codes) else n.group(0), part)
        if "markdown" in found:
            part = _from_markdown(part)
        out.append(part)
        if m:
            out.append(f"```\n{m.group('body')}```")
            at = m.end()
    clean = re.sub(r"[ \t]+\n", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", clean).strip("\n"), found


# --- boilerplate over the pages of a report ---------------------------------------------------------------------


def repeated(tokens: np.ndarray, pages: np.ndarray, span: int, min_pages: int) -> np.ndarray:
    """Which tokens lie in a run of ``span`` or more that stands on ``min_pages`` distinct pages.

    The suffix array is built by prefix doubling, stopped once suffixes are
    ordered by their first ``span`` tokens; runs don't pass the end of a page.
    """
    n = len(tokens)
    covered = np.zeros(n, dtype=bool)
    if n < span:
        return covered
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while width < span:
        step = min(width, span - width)
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        width += step
    ends = np.minimum(np.arange(n) + span - 1, n - 1)
    inside = (pages[ends] == pages) & (np.arange(n) + span <= n)
    order = np.lexsort((pages, rank))
    order = order[inside[order]]  # the suffix array, by the first `span` tokens
    if not len(order):
        return covered
    r, p = rank[order], pages[order]
    new = np.r_[True, r[1:] != r[:-1]]
    groups = np.cumsum(new) - 1
    distinct = np.bincount(groups, weights=new | np.r_[True, p[1:] != p[:-1]])
    first_page = p[new][groups]
    starts = order[(distinct[groups] >= min_pages) & (p != first_page)]  # the first page keeps its copy
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + span, -1)
    return np.cumsum(marks)[:n] > 0


_TOKEN = re.compile(r"[A-Za-zÀ-ɏ]+|\d+|[^\sA-Za-zÀ-ɏ\d]")


def boilerplate_lines(texts: list[str | None], page_of: list, span: int = 12, min_pages: int = 3) -> list[list[int]]:
    """Of each text the numbers of the lines that runs repeated on distinct pages cover; all first copies stay.

    A line that runs cover goes, whatever its length; one with a rest of its own
    stays whole, as clauses repeat inside sentences too. Code between fences goes
    whole or not at all.
    """
    page_ids = {p: i for i, p in enumerate(dict.fromkeys(page_of))}
    if len(page_ids) < min_pages:  # nothing can stand on so many pages
        return [[] for _ in texts]
    known: dict = {}
    tokens, pages = [], []
    lines: list[list[tuple[str, int, int]]] = []  # by text: (line, first token, number of tokens)
    for t, text in enumerate(texts):
        lines.append([])
        for line in (text or "").split("\n"):
            found = _TOKEN.findall(line)
            lines[t].append((line, len(tokens), len(found)))
            tokens += [known.setdefault(x, len(known)) for x in found]
            pages += [page_ids[page_of[t]]] * len(found)
    covered = repeated(np.array(tokens), np.array(pages), span, min_pages)
    return [[] if x is None else list(_covered(own, covered)) for x, own in zip(texts, lines)] if covered.any() else [[] for _ in texts]


def without_boilerplate(texts: list[str | None], page_of: list, span: int = 12, min_pages: int = 3) -> list[str | None]:
    """Texts without these lines."""
    out = []
    for text, drop in zip(texts, boilerplate_lines(texts, page_of, span, min_pages)):
        gone = set(drop)
        out.append("\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone) if drop else text)
    return out


def _covered(lines: list[tuple[str, int, int]], covered: np.ndarray) -> Iterator[int]:
    """Numbers of the lines of a text that are covered."""
    at = 0
    while at < len(lines):
        fence = re.match(r"[ \t]*(```|~~~)", lines[at][0])
        end = at + 1
        if fence:
            closing = (i for i in range(end, len(lines)) if lines[i][0].strip().startswith(fence.group(1)))
            end = next(closing, at) + 1
        first, n = lines[at][1], sum(count for _, _, count in lines[at:end])
        marks = covered[first : first + n]
        if n and marks.all():
            yield from range(at, end)
        at = end


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def convert_markup(df: DataFrame, key: str = "chunk_key", text: str = "text", path: str = "section_path", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, text, section_path, markup): clean text and path, and the sorted kinds of residue in either.

    Null stays null, an empty text or path empty; a path element may be null.
    Repeated rows stay repeated; of the other columns only those of ``keep`` are
    read and passed on.
    """
    kinds_of = {c: df.schema[c].dataType.simpleString() for c in keep}

    def make():
        def kernel(rows: dict[str, list]) -> pa.RecordBatch:
            texts, paths, marks = [], [], []
            for body, elements in zip(rows["text"], rows["path"]):
                clean, found = convert(body)
                cleaned = []
                for element in elements or ():
                    value, more = convert(element)
                    cleaned.append(value)
                    found = found | more
                texts.append(clean)
                paths.append(None if elements is None else cleaned)
                marks.append(sorted(found))
            strings = pa.list_(pa.string())
            kept = [pa.array(rows[f"keep_{c}"], _ARROW[t]) for c, t in kinds_of.items()]
            return pa.RecordBatch.from_arrays([pa.array(rows["key"], pa.int64()), pa.array(texts, pa.string()), pa.array(paths, strings), pa.array(marks, strings), *kept], names=[key, "text", "section_path", "markup", *keep])

        return kernel

    schema = f"`{key}` bigint, text string, section_path array<string>, markup array<string>" + "".join(f", `{c}` {t}" for c, t in kinds_of.items())
    return map_texts(df, {"key": key, "text": text, "path": path} | {f"keep_{c}": c for c in keep}, schema, make)


def residue(df: DataFrame, key: str = "chunk_key", text: str = "text", path: str = "section_path") -> DataFrame:
    """Rows (key, markup): each kind that ``convert_markup`` met."""
    return convert_markup(df, key, text, path).select(key, F.explode("markup").alias("markup")).distinct()


def clean_reports(df: DataFrame, span: int = 12, min_pages: int = 3) -> DataFrame:
    """Rows (chunk_key, section_path, text): converted, and without the boilerplate of the report's pages.

    Pages are the distinct chunk_id of a doc_id, so a chunk that was delivered
    twice isn't boilerplate. Equal texts of a page are handled once, so repeated
    rows don't decide a task's size; a report is handled whole, so its distinct
    pages do. Rows without a doc_id are converted only.
    """
    clean = convert_markup(df, keep=("doc_id", "chunk_id")).withColumn("chunk_id", F.coalesce("chunk_id", F.lit("")))
    rows = clean.select("chunk_key", "doc_id", "chunk_id", "section_path", "text", F.xxhash64("text").alias("_hash"))
    page = ["doc_id", "chunk_id", "_hash"]
    pages = rows.groupBy(*page).agg(F.any_value("text").alias("text"))

    def per_report(table: pa.Table) -> pa.Table:
        if table.num_rows < min_pages:
            return pa.table({"doc_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.string()), "_hash": pa.array([], pa.int64()), "drop": pa.array([], pa.list_(pa.int32()))})
        table = table.sort_by([("chunk_id", "ascending"), ("_hash", "ascending")])
        drops = boilerplate_lines(table.column("text").to_pylist(), table.column("chunk_id").to_pylist(), span, min_pages)
        table = table.drop_columns("text").append_column("drop", pa.array(drops, pa.list_(pa.int32())))
        return table.filter(pc.greater(pc.list_value_length(table.column("drop")), 0))

    # the numbers of the lines to drop travel back, of the texts that have some: most have none
    found = pages.where(F.col("doc_id").isNotNull()).groupBy("doc_id").applyInArrow(per_report, "doc_id bigint, chunk_id string, _hash bigint, drop array<int>")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("drop", i)), "\n")
    return rows.join(found, page, "left").select("chunk_key", "section_path", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text"))
