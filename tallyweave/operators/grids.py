"""Tables inside Markdown: pipe tables and HTML tables as grids, with their breadcrumb."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of, strip, strip_inline_markdown

SEPARATOR = r"^[\s|:\-]+$"


def pipe_cells(line: Column) -> Column:
    """Cells of a pipe row, without inline marks."""
    body = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(body, r"\|"), strip_inline_markdown)


def numbered_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, line_no, raw), line_no from 0."""
    return df.select(key, F.posexplode_outer(lines_of(F.col(text))).alias("line_no", "raw")).where(F.col("line_no").isNotNull())


def level_path(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``lines`` with ``path``: the headings above a line, each cut off by a later one of its level or higher.

    For every level the last heading at or above it is carried forward; it
    belongs to the path if its own level is that level.
    """
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    bare = strip(F.col("raw"))
    level = F.when(bare.rlike(r"^#{1,6}\s+") & ~bare.rlike(r"^#\s*---"), F.length(F.regexp_extract(bare, r"^(#{1,6})", 1)))
    headed = lines.withColumn("level", level).withColumn("_head", F.when(level.isNotNull(), F.struct(level.alias("level"), strip(F.regexp_replace(bare, r"^#{1,6}\s+", "")).alias("title"))))
    carried = [F.last(F.when(F.col("level") <= n, F.col("_head")), ignorenulls=True).over(order).alias(f"_h{n}") for n in range(1, 7)]
    out = headed.select("*", *carried)
    parts = [F.when(F.col(f"_h{n}.level") == n, F.col(f"_h{n}.title")) for n in range(1, 7)]
    return out.withColumn("path", F.array_compact(F.array(*parts))).drop("_head", *(f"_h{n}" for n in range(1, 7)))


def pipe_tables(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, table_no, title, grid) of the pipe tables; separator rows, and rows of blanks or dashes only, are left out, short rows padded.

    A table is a run of lines that begin with a pipe; its title is the
    breadcrumb of the headings above it, or Table N.
    """
    lines = level_path(numbered_lines(df, key, text), key)
    order = Window.partitionBy(key).orderBy("line_no")
    is_row = F.coalesce(strip(F.col("raw")).startswith("|"), F.lit(False))
    flagged = lines.withColumn("_row", is_row).withColumn("_new", (F.col("_row") & ~F.coalesce(F.lag("_row").over(order), F.lit(False))).cast("int"))
    runs = flagged.withColumn("_run", F.sum("_new").over(order)).where(F.col("_row") & ~strip(F.col("raw")).rlike(SEPARATOR))
    grouped = runs.groupBy(key, "_run").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: pipe_cells(x["raw"])).alias("_cells"), F.min_by("path", "line_no").alias("_path"))
    width = F.array_max(F.transform("_cells", lambda r: F.size(r)))
    padded = grouped.withColumn("grid", F.transform("_cells", lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    number = F.row_number().over(Window.partitionBy(key).orderBy("_run"))
    title = F.when(F.size("_path") > 0, F.array_join("_path", " > "))
    return padded.withColumn("table_no", number).select(key, "table_no", F.coalesce(title, F.concat(F.lit("Table "), F.col("table_no").cast("string"))).alias("title"), "grid")


def cells(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, table_no, row_no, col_no, cell), numbers from 0."""
    return tables.select(key, "table_no", F.posexplode("grid").alias("row_no", "_r")).select(key, "table_no", "row_no", F.posexplode("_r").alias("col_no", "cell"))


def grid_markdown(labels: Column, rows: Column) -> Column:
    """A pipe table; pipes inside cells are escaped."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(labels, lambda _: F.lit("---")), " | "), F.lit(" |"))
    head = F.concat(F.lit("| "), F.array_join(labels, " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(head, rule), F.transform(rows, line)), "\n")


def expand_spans(table: str) -> list[list[str]]:
    """Grid of an HTML table: a column span repeats as empty cells, a row span repeats its text."""
    grid: list[list[str]] = []
    open_spans: dict[int, tuple[int, str]] = {}
    for row in re.findall(r"<tr\b[^>]*>(.*?)</tr\s*>", table, re.S | re.I):
        out: list[str] = []

        def carried() -> None:
            while len(out) in open_spans:
                left, text = open_spans[len(out)]
                if left > 1:
                    open_spans[len(out)] = (left - 1, text)
                else:
                    del open_spans[len(out)]
                out.append(text)

        for attributes, body in re.findall(r"<t[dh]\b([^>]*)>(.*?)</t[dh]\s*>", row, re.S | re.I):
            carried()
            text = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", body, flags=re.I))).strip()
            across, down = (int(m.group(1)) if (m := re.search(rf"{name}\s*=\s*[\"']?(\d+)", attributes, re.I)) else 1 for name in ("colspan", "rowspan"))
            for i in range(max(1, across)):
                shown = text if i == 0 else ""
                if down > 1:
                    open_spans[len(out)] = (down - 1, shown)
                out.append(shown)
        carried()
        grid.append(out)
    width = max(map(len, grid), default=0)
    return [r + [""] * (width - len(r)) for r in grid]


def html_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, table_no, grid) of the HTML tables in a text; spans need Python, so only texts with a table go there."""
    found = df.select(F.col(key).alias("_key"), F.regexp_extract_all(F.col(text), F.lit(r"(?is)<table\b.*?</table\s*>"), 0).alias("_tables")).where(F.size("_tables") > 0)
    each = found.select("_key", F.posexplode("_tables").alias("_no", "_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = [expand_spans(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n + 1 for n in batch.column(1).to_pylist()], pa.int32()), pa.array(grids, pa.list_(pa.list_(pa.string())))], names=[key, "table_no", "grid"])

    return each.mapInArrow(run, f"`{key}` bigint, table_no int, grid array<array<string>>")
