"""Pages as Markdown: rebuilt tables and the prose around them in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import layout


def table_markdown(labels: Column, rows: Column) -> Column:
    """A pipe table of labels and rows; pipes inside cells are escaped, line ends become spaces."""
    cell = lambda c: F.replace(F.regexp_replace(c, r"\s*\n\s*", " "), F.lit("|"), F.lit(r"\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(labels)))
    return F.array_join(F.concat(F.array(line(labels), rule), F.transform(rows, line)), "\n")


def region_markdown(tables: DataFrame, least_rows: int = 2) -> DataFrame:
    """``tables`` with ``markdown``; a region of fewer rows is no table and is left out."""
    return tables.where(F.size("rows") >= least_rows).withColumn("markdown", table_markdown(F.col("labels"), F.col("rows")))


def page_markdown(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows (doc_id, page, text): a marker, then the page's lines outside its tables and its tables, from top to bottom.

    A word belongs to a table if its middle lies within the table's height. A
    page without words has no row.
    """
    page = ["doc_id", "page"]
    spans = tables.groupBy(*page).agg(F.collect_list(F.struct("y0", "y1")).alias("_spans"))
    middle = (F.col("y0") + F.col("y1")) / 2
    inside = F.exists(F.coalesce("_spans", F.array().cast("array<struct<y0: double, y1: double>>")), lambda s: middle.between(s["y0"], s["y1"]))
    placed = words.where(F.col("text").isNotNull()).join(spans, page, "left").withColumn("_inside", inside)
    pages = placed.groupBy(*page).agg(F.array_sort(F.collect_list(F.when(~F.col("_inside"), F.struct("y0", "x0", "word_no", "text")))).alias("_w"))
    # a line's words are those near its first one
    state = "struct<y: double, lines: array<struct<y: double, x: double, text: string>>>"

    def step(acc: Column, w: Column) -> Column:
        near = F.abs(w["y0"] - acc["y"]) <= layout.LINE_STEP
        last = F.try_element_at(acc["lines"], F.lit(-1))
        longer = F.concat(F.slice(acc["lines"], 1, F.greatest(F.size(acc["lines"]) - 1, F.lit(0))), F.array(F.struct(last["y"].alias("y"), last["x"].alias("x"), F.concat(last["text"], F.lit(" "), w["text"]).alias("text"))))
        opened = F.concat(acc["lines"], F.array(F.struct(w["y0"].alias("y"), w["x0"].alias("x"), w["text"].alias("text"))))
        return F.struct(F.when(near, acc["y"]).otherwise(w["y0"]).alias("y"), F.when(near, longer).otherwise(opened).alias("lines")).cast(state)

    start = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<struct<y: double, x: double, text: string>>").alias("lines")).cast(state)
    prose = pages.select(*page, F.transform(F.aggregate("_w", start, step)["lines"], lambda x: F.struct(x["y"].alias("y"), x["text"].alias("text"))).alias("_prose"))
    grids = tables.groupBy(*page).agg(F.collect_list(F.struct(F.col("y0").alias("y"), table_markdown(F.col("labels"), F.col("rows")).alias("text"))).alias("_tables"))
    blocks = F.array_sort(F.concat("_prose", F.coalesce("_tables", F.array().cast("array<struct<y: double, text: string>>"))))
    marker = F.format_string("# --- PDF 物理切片：第 %d - %d 页 ---", "page", "page")
    return prose.join(grids, page, "left").select(*page, F.array_join(F.concat(F.array(marker), F.transform(blocks, lambda b: b["text"])), "\n\n").alias("text"))


def wants_turning(language: str, detect: bool) -> bool:
    """Whether pages are looked at for vertical text: Chinese reports only, and where the profile asks for it."""
    return detect and language == "zh"


def with_content(materials: DataFrame, text: str = "text") -> DataFrame:
    """Materials whose text isn't blank."""
    return materials.where(F.trim(F.col(text)) != "")
