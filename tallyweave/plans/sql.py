"""Pieces of SQL that say in DuckDB what the column functions say in Spark."""

from __future__ import annotations

import unicodedata
from functools import cache

from ..functions.text import LINE_END, SPACE
from ..operators.headings import MARKER, NUMBERING


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {quoted(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


def lines(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """A query of (key, line_no, raw)."""
    body = f"regexp_split_to_array(regexp_replace({text}, {quoted(LINE_END + chr(92) + 'z')}, ''), {quoted(LINE_END)})"
    return f"SELECT {key}, unnest(generate_series(0, len(l) - 1)) AS line_no, unnest(l) AS raw FROM (SELECT {key}, {body} AS l FROM {table} WHERE {text} <> '')"


def numbering_level(x: str, language: str) -> str:
    cases = " ".join(f"WHEN {matches(x, pattern)} THEN {level}" for pattern, level in NUMBERING[language])
    return f"CASE {cases} ELSE 0 END"


def relevel(language: str, promote: bool, longest: int) -> str:
    bare = strip("raw")
    title = strip(f"regexp_replace({strip('''regexp_replace(raw, '^#{1,6}\\s*', '')''')}, '^\\*\\*(.*)\\*\\*$', '\\1')")
    plain = f"WHEN promoted > 0 AND bare <> '' AND NOT contains(bare, '|') AND length(bare) <= {longest} THEN repeat('#', promoted) || ' ' || bare" if promote else ""
    return f"""
        WITH lines AS ({lines()}),
        told AS (SELECT doc_id, line_no, raw, {title} AS title, {bare} AS bare FROM lines),
        levelled AS (SELECT *, {numbering_level('title', language)} AS lvl, {numbering_level('bare', language)} AS promoted FROM told),
        done AS (SELECT doc_id, line_no, CASE WHEN {matches('raw', MARKER)} THEN raw
            WHEN {matches('raw', '^#{1,6}')} AND title <> '' THEN repeat('#', CASE lvl WHEN 0 THEN 2 ELSE lvl END) || ' ' || title {plain} ELSE raw END AS line FROM levelled)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text
        FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM done GROUP BY doc_id) x USING (doc_id)"""


@cache
def _forms() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters with a one-character compatibility form and their forms; and the ligatures and squares with a longer one."""
    source, target, longer = [], [], []
    for code in range(0xA0, 0x30000):
        c = chr(code)
        form = unicodedata.normalize("NFKC", c)
        if form == c or unicodedata.combining(c):
            continue
        if len(form) == 1 and unicodedata.normalize("NFC", c) == c:
            source.append(c)
            target.append(form)
        elif len(form) > 1 and (0xFB00 <= code <= 0xFB06 or 0x3380 <= code <= 0x33DF or code in (0x2026, 0x2103, 0x33A1, 0xBC, 0xBD, 0xBE)):
            longer.append((c, form))
    return "".join(source), "".join(target), longer


def nfkc(x: str) -> str:
    """Compatibility composition by translate and nfc_normalize."""
    source, target, longer = _forms()
    for c, form in longer:
        x = f"replace({x}, {quoted(c)}, {quoted(form)})"
    return f"nfc_normalize(translate({x}, {quoted(source)}, {quoted(target)}))"


def match_form(x: str) -> str:
    return f"regexp_replace(lower({nfkc(x)}), {quoted(SPACE)}, '', 'g')"


def parse_number(x: str) -> str:
    text = strip(x)
    wide = "translate({}, '０１２３４５６７８９', '0123456789')"
    digits = wide.format("replace(replace(body, ',', ''), '，', '')")
    return f"""(SELECT CASE WHEN raw IS NULL OR lower(text) IN ('null', 'none', '', 'n/a', 'na', '—', '-') THEN NULL
        WHEN wrapped AND n > 0 THEN -n ELSE n END
        FROM (SELECT *, TRY_CAST(nullif(regexp_extract({digits}, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS n
        FROM (SELECT *, CASE WHEN wrapped THEN substring(text, 2, length(text) - 2) ELSE text END AS body
        FROM (SELECT raw, text, starts_with(text, '(') AND ends_with(text, ')') AS wrapped FROM (SELECT {x} AS raw, {text} AS text)))))"""
