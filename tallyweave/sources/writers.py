"""Where results go: files by entity, workbooks, documents, pages for proofreading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html
from .office import write_document, write_workbook


def save_results(results: DataFrame, path: str, by: str | None = None, form: str = "json") -> None:
    """Write results in files, a folder per entity if ``by`` names one."""
    writer = results.write.mode("overwrite").format(form)
    (writer.partitionBy(by) if by else writer).save(path)


def save_workbook(path: str, sheets: Sequence[tuple[str, DataFrame]], most: int = 100_000) -> list[str]:
    """A workbook with a sheet per table. It is one file for people: a table of more than ``most`` rows is an error, never cut."""
    filled = []
    for name, frame in sheets:
        rows = frame.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name}: more than {most} rows don't fit a sheet; write files instead")
        filled.append((name, [frame.columns, *map(tuple, rows)]))
    return write_workbook(path, filled)


def grid_sheets(tables: DataFrame, key_value, key: str = "doc_id") -> list[tuple[str, list[list[str]]]]:
    """Sheets of one document's tables: title, rows."""
    found = tables.where(F.col(key) == key_value).orderBy("table_no").collect()
    return [(f"Table {t.table_no}", [[t.title], *[list(r) for r in t.grid]]) for t in found]


def markdown_document(path: str, blocks: DataFrame) -> None:
    """A word document of one document's blocks (block_no, is_table, block)."""
    out: list[tuple[str, object]] = []
    for row in blocks.orderBy("block_no").collect():
        if row.is_table and row.block.lstrip().startswith("|"):
            lines = [line.strip().strip("|") for line in row.block.splitlines() if not set(line.strip()) <= set("|-: ")]
            out.append(("table", [[c.strip() for c in line.split("|")] for line in lines]))
            continue
        for line in row.block.splitlines():
            level = len(line) - len(line.lstrip("#"))
            out.append((f"heading{level}", line.lstrip("# ").strip()) if 0 < level <= 6 and line[level : level + 1] == " " else ("text", line))
    write_document(path, out)


def section_html(number: Column, page_start: Column, page_end: Column, body: Column) -> Column:
    """A section of the proofreading page: its pages beside its text."""
    pages = F.concat_ws(" - ", page_start.cast("string"), page_end.cast("string"))
    return F.concat(F.lit('<section id="s'), number.cast("string"), F.lit('"><h2>'), escape_html(pages), F.lit('</h2><pre contenteditable="true">'), escape_html(body), F.lit("</pre></section>"))


def proofreading_pages(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, html): the sections of a document in order."""
    html = section_html(*(F.col(c) for c in ("section_no", "page_start", "page_end", "body")))
    parts = sections.select(key, F.struct("section_no", html.alias("h")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return parts.select(key, F.concat(F.lit("<!doctype html><html><body>"), F.array_join(F.transform("x", lambda p: p["h"]), "\n"), F.lit("</body></html>")).alias("html"))


def merged_edits(sections: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, text): sections with their edited bodies, ends trimmed, an empty line between, a line end last."""
    edited = sections.join(edits.select(key, "section_no", F.col("body").alias("_edit")), [key, "section_no"], "left")
    body = F.rtrim(F.regexp_replace(F.coalesce("_edit", "body"), r"\s+\z", ""))
    ordered = edited.select(key, F.struct("section_no", body.alias("b")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return ordered.select(key, F.concat(F.array_join(F.transform("x", lambda p: p["b"]), "\n\n"), F.lit("\n")).alias("text"))


def report_document(path: str, title: str, sections: DataFrame, records: DataFrame) -> None:
    """A word document of a report: its title, each section's text, then a table per section of the metrics that belong to it.

    ``sections`` has section_no, title and body, ``records`` section_no, id, name,
    value and unit. Both are of one report.
    """
    of: dict[int, list[tuple]] = {}
    for r in records.orderBy("section_no", "id").collect():
        of.setdefault(r.section_no, []).append((r.id, r.name or "", " ".join(filter(None, (r.value, r.unit)))))
    blocks: list[tuple[str, object]] = [("heading1", title)]
    for s in sections.orderBy("section_no").collect():
        blocks.append(("heading2", s.title or ""))
        blocks += [("text", line) for line in (s.body or "").split("\n") if line.strip()]
        if s.section_no in of:
            blocks.append(("table", [("id", "name", "value"), *of[s.section_no]]))
    write_document(path, blocks)
