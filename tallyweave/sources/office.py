"""Workbooks and word documents as the zipped XML that they are; no other library is needed.

One file is one driver-side object: these are report sinks and hand-made sources
of a few sheets, not data paths.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _clean(value) -> str:
    return escape(_CONTROL.sub("", str(value)))


def _column(n: int) -> str:
    letters = ""
    while n >= 0:
        letters = chr(65 + n % 26) + letters
        n = n // 26 - 1
    return letters


def sheet_title(name: str, used: set[str]) -> str:
    """A valid sheet name not used yet, regardless of case."""
    base = re.sub(r"[\\/*?:\[\]]", "_", name).strip()[:31] or "Sheet"
    title, n = base, 2
    while title.lower() in used:
        title = f"{base[: 31 - len(str(n)) - 1]}_{n}"
        n += 1
    used.add(title.lower())
    return title


def write_workbook(path: str, sheets: Iterable[tuple[str, Sequence[Sequence]]], widths: bool = True) -> list[str]:
    """Write (name, rows) sheets; numbers stay numbers, None an empty cell. Returns the names used."""
    used: set[str] = set()
    named = [(sheet_title(name, used), list(rows)) for name, rows in sheets] or [("Sheet", [])]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(named) + 1))
        out.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        out.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        out.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(named) + 1)) + "</Relationships>")
        out.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_SHEET[1:-1]}" xmlns:r="{_OFFICE}/relationships"><sheets>' + "".join(f'<sheet name="{_clean(n).replace(chr(34), "&quot;")}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(named, 1)) + "</sheets></workbook>")
        for i, (_, rows) in enumerate(named, 1):
            shown: dict[int, float] = {}
            body = []
            for r, row in enumerate(rows, 1):
                cells = []
                for c, value in enumerate(row):
                    if value is None:
                        continue
                    ref = f"{_column(c)}{r}"
                    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value:
                        cells.append(f'<c r="{ref}"><v>{value}</v></c>')
                    else:
                        cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{_clean(value)}</t></is></c>')
                    shown[c] = max(shown.get(c, 8.0), min(60.0, sum(1.8 if "一" <= x <= "鿿" else 1.0 for x in str(value)) + 2))
                body.append(f'<row r="{r}">{"".join(cells)}</row>')
            cols = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{w:.1f}" customWidth="1"/>' for c, w in sorted(shown.items())) if widths and shown else ""
            out.writestr(f"xl/worksheets/sheet{i}.xml", f'{_HEAD}<worksheet xmlns="{_SHEET[1:-1]}">' + (f"<cols>{cols}</cols>" if cols else "") + f"<sheetData>{''.join(body)}</sheetData></worksheet>")
    return [name for name, _ in named]


def read_workbook(path: str) -> list[tuple[str, list[list[str | None]]]]:
    """(sheet name, rows of text cells) of a workbook."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            target = rels[sheet.get(f"{{{_OFFICE}/relationships}}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows: list[list[str | None]] = []
            for row in root.iter(f"{_SHEET}row"):
                while len(rows) < int(row.get("r", len(rows) + 1)) - 1:
                    rows.append([])
                cells: list[str | None] = []
                for cell in row.iter(f"{_SHEET}c"):
                    letters = re.match(r"[A-Z]+", cell.get("r", "")) if cell.get("r") else None
                    at = sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(letters.group(0)))) - 1 if letters else len(cells)
                    cells += [None] * (at - len(cells))
                    value = cell.find(f"{_SHEET}v")
                    text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) if cell.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if cell.get("t") == "s" else value.text
                    cells.append(text)
                rows.append(cells)
            out.append((sheet.get("name"), rows))
    return out


def rule_cells(path: str) -> list[dict[str, str | None]]:
    """Rows of all sheets that have headers for id and name, as text cells by column; the sheet's name is the group."""
    from ..operators.rules import header_name

    out = []
    for sheet, rows in read_workbook(path):
        headers = [header_name(h) for h in rows[0]] if rows else []
        if "id" in headers and "name" in headers:
            for row in rows[1:]:
                cells = {h: v for h, v in zip(headers, row) if h}
                out.append(cells | {"rule_group": sheet})
    return out


def write_document(path: str, blocks: Iterable[tuple[str, object]]) -> None:
    """Write a word document of ("heading1".."heading6" | "text", text) and ("table", rows) blocks."""
    body = []
    for kind, content in blocks:
        if kind == "table":
            rows = "".join("<w:tr>" + "".join(f'<w:tc><w:tcPr/><w:p><w:r><w:t xml:space="preserve">{_clean(c)}</w:t></w:r></w:p></w:tc>' for c in row) + "</w:tr>" for row in content)
            body.append(f"<w:tbl><w:tblPr/>{rows}</w:tbl><w:p/>")
        else:
            style = f'<w:pPr><w:pStyle w:val="Heading{kind[-1]}"/></w:pPr>' if kind.startswith("heading") else ""
            body.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{_clean(content)}</w:t></w:r></w:p>')
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        out.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        out.writestr("word/document.xml", f'{_HEAD}<w:document xmlns:w="{_WORD[1:-1]}"><w:body>{"".join(body)}</w:body></w:document>')


def read_document(path: str) -> list[tuple[str, object]]:
    """Blocks of a word document in order, as ``write_document`` takes them."""
    with zipfile.ZipFile(path) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    text_of = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t"))
    out: list[tuple[str, object]] = []
    for node in body:
        if node.tag == f"{_WORD}tbl":
            out.append(("table", [[text_of(c) for c in row.iter(f"{_WORD}tc")] for row in node.iter(f"{_WORD}tr")]))
        elif node.tag == f"{_WORD}p" and text_of(node).strip():
            style = node.find(f"{_WORD}pPr/{_WORD}pStyle")
            level = re.search(r"(\d)$", style.get(f"{_WORD}val", "")) if style is not None else None
            out.append((f"heading{level.group(1)}" if level else "text", text_of(node).strip()))
    return out
