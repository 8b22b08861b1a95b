"""Files as tables: folders of reports, recognised text, rule and route files, engines' coordinates."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import signature, without_bom, word_form

# What counts as a report file, and what a former run leaves beside one.
REPORT_FILE = r"(?i)\.(pdf|png|jpg|jpeg|bmp|tif|tiff|webp|gif)$"
LEFTOVER = r"(?i)(_asimg\.pdf|_rotated_ready\.pdf)$|_mineru/"
RULE = "id string, name string, name_in_material string, source string, enabled boolean, allow_parent_note boolean, section_hint array<string>, aliases array<string>, company_hints array<string>, extraction_mode string, calc string, aggregation string, skip_reason string, `group` string"


def report_files(spark: SparkSession, root: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """Rows (path, modified, size[, content]) of report files under a folder, leftovers of former runs left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    kept = found.where(F.col("path").rlike(REPORT_FILE) & ~F.col("path").rlike(LEFTOVER))
    columns = [F.col("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")]
    return kept.select(*columns, *([F.col("content")] if content else [])).orderBy(F.lower("path"))


def union_of_materials(frames: Iterable[DataFrame]) -> DataFrame:
    """All files of several listings, each path once regardless of case; the first listing wins."""
    every = None
    for i, frame in enumerate(frames):
        part = frame.withColumn("_from", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    first = Window.partitionBy(F.lower("path")).orderBy("_from", "path")
    return every.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n", "_from")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, text) of recognised texts, without a byte order mark."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), without_bom(F.col("value")).alias("text"))


def pending(sources: DataFrame, done: DataFrame, least: int = 1024) -> DataFrame:
    """Sources without an output of at least ``least`` bytes made with the same options: ``options`` is part of the key."""
    finished = done.where(F.col("size") > least).select("stem", "options")
    return sources.join(finished, ["stem", "options"], "left_anti")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def read_rules(spark: SparkSession, path: str, profile: str | None = None) -> DataFrame:
    """Rules of JSON files, either a list or wrapped in an object, typed and numbered in order."""
    plain = spark.read.schema(f"rules array<struct<{RULE}>>").option("multiLine", "true").json(path)
    wrapped = plain.where(F.col("rules").isNotNull()).select(F.posexplode("rules").alias("_i", "r"))
    rules = wrapped.select((F.col("_i") + 1).cast("bigint").alias("rule_key"), F.lit(profile).cast("string").alias("profile"), "r.*").withColumnRenamed("group", "rule_group")
    return rules.withColumn("enabled", F.coalesce("enabled", F.lit(True))).withColumn("allow_parent_note", F.coalesce("allow_parent_note", F.lit(False)))


def rules_signature(path: Column, modified: Column, size: Column) -> Column:
    """What tells whether a rule file changed since its cache was written."""
    return signature(path, modified.cast("string"), size.cast("string"))


def read_routes(path: str) -> tuple[list[tuple[str, str]], str | None]:
    """(routes, default) of a route file; entries without pattern or profile are left out."""
    from ..operators.routing import load_routes

    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    return load_routes(content.get("routes", [])), content.get("default")


# Fixed value: the nested layout file of a recognition engine, two levels of blocks deep.
_LINE = "struct<bbox: array<double>, spans: array<struct<content: string, html: string>>>"
_BLOCK = f"struct<type: string, bbox: array<double>, lines: array<{_LINE}>, blocks: array<struct<type: string, bbox: array<double>, lines: array<{_LINE}>>>>"
LAYOUT = f"pdf_info array<struct<page_idx: int, page_size: array<double>, para_blocks: array<{_BLOCK}>>>"


def layout_anchors(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, page, is_table, norm, yf0, yf1) of a nested layout file: blocks in fractions of the page height."""
    pages = spark.read.schema(LAYOUT).option("multiLine", "true").json(path).select(F.col("_metadata.file_path").alias("path"), F.explode("pdf_info").alias("p"))
    blocks = pages.select("path", (F.col("p.page_idx") + 1).alias("page"), F.element_at("p.page_size", 2).alias("_h"), F.explode("p.para_blocks").alias("b"))
    none = F.array().cast(f"array<{_LINE}>")
    lines = F.concat(F.coalesce("b.lines", none), F.flatten(F.transform(F.coalesce("b.blocks", F.array().cast(f"array<struct<type: string, bbox: array<double>, lines: array<{_LINE}>>>")), lambda x: F.coalesce(x["lines"], none))))
    text = F.array_join(F.flatten(F.transform(lines, lambda x: F.transform(x["spans"], lambda s: F.coalesce(s["content"], F.regexp_replace(s["html"], "<[^>]+>", " "), F.lit(""))))), "")
    height = F.when(F.col("_h") > 0, F.col("_h")).otherwise(F.lit(1.0))
    return blocks.select("path", "page", (F.col("b.type") == "table").alias("is_table"), word_form(text).alias("norm"), (F.element_at("b.bbox", 2) / height).alias("yf0"), (F.element_at("b.bbox", 4) / height).alias("yf1"))


def flat_anchors(spark: SparkSession, path: str) -> DataFrame:
    """The same of a flat list of items; heights are fractions of the lowest edge on a page."""
    items = spark.read.schema("type string, bbox array<double>, page_idx int, text string, table_body string").option("multiLine", "true").json(path)
    page = Window.partitionBy("path", "page_idx")
    placed = items.select(F.col("_metadata.file_path").alias("path"), "*").where(F.size("bbox") == 4).withColumn("_h", F.greatest(F.max(F.element_at("bbox", 4)).over(page), F.lit(1.0)))
    text = F.coalesce("text", F.regexp_replace("table_body", "<[^>]+>", " "), F.lit(""))
    return placed.select("path", (F.col("page_idx") + 1).alias("page"), (F.col("type") == "table").alias("is_table"), word_form(text).alias("norm"), (F.element_at("bbox", 2) / F.col("_h")).alias("yf0"), (F.element_at("bbox", 4) / F.col("_h")).alias("yf1"))


def thin_rules(strokes: DataFrame) -> DataFrame:
    """Horizontal rules (doc_id, page, y, x0, x1) among the strokes and boxes of pages."""
    flat = (F.abs(F.col("y1") - F.col("y0")) < F.when(F.col("kind") == "line", 1).otherwise(3)) & (F.abs(F.col("x1") - F.col("x0")) > 4)
    return strokes.where(flat).select("doc_id", "page", F.least("y0", "y1").alias("y"), F.least("x0", "x1").alias("x0"), F.greatest("x0", "x1").alias("x1"))


