"""Sections, blocks and outlines of a document; fingerprints of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SLICE_ANY, SLICE_LINE, lines_of, strip
from .grids import numbered_lines


def slice_sections(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, section_no, page_start, page_end, body): the text between page markers, inside the row.

    What stands before the first marker joins the first section; a text without
    markers is one section without pages.
    """
    lined = df.select(F.col(key), lines_of(F.col(text)).alias("_l")).where(F.size("_l") > 0)
    marks = F.array_compact(F.transform("_l", lambda x, i: F.when(strip(x).rlike(SLICE_LINE), i)))
    starts = lined.withColumn("_marks", marks).withColumn("_starts", F.when(F.size("_marks") == 0, F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), F.slice("_marks", 2, F.size("_marks")))))

    def one(begin: Column, i: Column) -> Column:
        until = F.coalesce(F.try_element_at(F.col("_starts"), (i + 2).cast("int")), F.size("_l"))
        held = F.filter(F.slice(F.col("_l"), begin + 1, until - begin), lambda x: ~strip(x).rlike(SLICE_LINE))
        marker = strip(F.try_element_at(F.col("_l"), F.try_element_at(F.col("_marks"), (i + 1).cast("int")) + 1))
        page = lambda n: F.regexp_extract(marker, SLICE_ANY, n).try_cast("int")
        return F.struct(page(1).alias("page_start"), page(2).alias("page_end"), strip(F.array_join(held, "\n")).alias("body"))

    each = starts.select(key, F.transform("_starts", one).alias("_sections")).select(key, F.posexplode_outer("_sections").alias("_i", "_s"))
    return each.select(key, (F.col("_i") + 1).alias("section_no"), "_s.page_start", "_s.page_end", "_s.body")


def blocks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, block_no, is_table, block): parts between blank lines; a fence stays whole over blank lines."""
    order = Window.partitionBy(key).orderBy("line_no")
    lines = numbered_lines(df, key, text).withColumn("_bare", F.lower(strip(F.col("raw"))))
    fence = F.col("_bare").rlike("^(```|~~~)")
    inside = lines.withColumn("_f", fence.cast("int")).withColumn("_open", (F.sum("_f").over(order) - F.col("_f")) % 2)
    breaks = inside.withColumn("_gap", ((F.col("_open") == 0) & (F.col("_bare") == "")).cast("int")).withColumn("_block", F.sum("_gap").over(order))
    held = breaks.where(F.col("_gap") == 0).groupBy(key, "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]).alias("_lines"))
    first, second = F.element_at("_lines", 1), F.coalesce(F.try_element_at("_lines", F.lit(2)), F.lit(""))
    table = F.lower(first).rlike(r"^\s*<table") | (first.contains("|") & second.rlike(r"^\s*\|?\s*:?-{3,}"))
    numbered = held.withColumn("block_no", F.row_number().over(Window.partitionBy(key).orderBy("_block")))
    return numbered.select(key, "block_no", table.alias("is_table"), F.array_join("_lines", "\n").alias("block"))


def outline(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, node_no, level, title, body): a node per heading outside fences; lines before any are node 0 of level 1 without title."""
    order = Window.partitionBy(key).orderBy("line_no")
    lines = numbered_lines(df, key, text).withColumn("_bare", strip(F.col("raw")))
    fence = F.col("_bare").startswith("```").cast("int")
    inside = lines.withColumn("_f", fence).withColumn("_open", (F.sum("_f").over(order) - F.col("_f")) % 2)
    headed = inside.withColumn("_head", ((F.col("_open") == 0) & (F.col("_f") == 0) & F.col("_bare").rlike(r"^#{1,6}\s+\S")).cast("int")).withColumn("node_no", F.sum("_head").over(order))
    kept = headed.where(F.col("_bare") != "")
    title = strip(F.regexp_replace("_bare", r"^#{1,6}\s+", ""))
    grouped = kept.groupBy(key, "node_no").agg(
        F.max(F.when(F.col("_head") == 1, F.struct(F.length(F.regexp_extract("_bare", "^(#{1,6})", 1)).alias("level"), title.alias("title")))).alias("_h"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_head") == 0, F.struct("line_no", "_bare")))), lambda x: x["_bare"]).alias("body"),
    )
    return grouped.select(key, "node_no", F.coalesce("_h.level", F.lit(1)).alias("level"), F.coalesce("_h.title", F.lit("")).alias("title"), "body")


def ideographs(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[一-鿿]"))


def latin_letters(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]"))


def rough_language(text: Column) -> Column:
    """zh or en by the counts of ideographs and Latin letters; a tie and none of either are zh."""
    return F.when(ideographs(text) >= latin_letters(text), F.lit("zh")).otherwise(F.lit("en"))


def primary_language(df: DataFrame, by: str, language: str = "language") -> DataFrame:
    """The most frequent language per group; of equally frequent ones the first in the alphabet."""
    counted = df.groupBy(by, language).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.min_by(F.struct(F.col(language).alias("language"), "n"), F.struct(-F.col("n"), F.col(language))).alias("_p")).select(by, F.col("_p.language").alias("language"), F.col("_p.n").alias("n"))


def data_line(bare: Column) -> Column:
    """Whether a line bears data: a pipe and a digit, or at least three digits in under 160 characters."""
    digits = F.regexp_count(bare, F.lit("[0-9]"))
    return (bare.contains("|") & (digits > 0)) | ((F.length(bare) < 160) & (digits >= 3))


def fingerprint_lines(df: DataFrame, key: str = "doc_id", text: str = "text", headings: int = 120, data_lines: int = 80) -> DataFrame:
    """Rows (key, kind, place, line): the first headings and the first distinct data lines of each document.

    The caps are the operator's: a fingerprint is a bounded report on a material.
    Data lines are distinct by their first 80 characters.
    """
    lines = numbered_lines(df, key, text).withColumn("line", strip(F.col("raw"))).where(F.col("line") != "")
    kind = F.when(F.col("line").startswith("```"), None).when(F.col("line").startswith("#"), "heading").when(data_line(F.col("line")), "data")
    told = lines.withColumn("kind", kind).where(F.col("kind").isNotNull())
    lead = F.when(F.col("kind") == "data", F.substring("line", 1, 80)).otherwise(F.col("line_no").cast("string"))
    firsts = told.groupBy(key, "kind", lead.alias("_lead")).agg(F.min_by("line", "line_no").alias("line"), F.min("line_no").alias("line_no"))
    place = F.row_number().over(Window.partitionBy(key, "kind").orderBy("line_no"))
    return firsts.withColumn("place", place).where(F.col("place") <= F.when(F.col("kind") == "heading", headings).otherwise(data_lines)).select(key, "kind", "place", "line")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", longest: int = 9000) -> DataFrame:
    """Rows (key, fingerprint, language) built from ``fingerprint_lines``; documents without such lines have the empty form."""
    lines = fingerprint_lines(df, key, text).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "heading", F.struct("place", "line")))), lambda x: x["line"]).alias("_h"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "data", F.struct("place", "line")))), lambda x: x["line"]).alias("_d"),
    )
    every = df.select(key).distinct().join(lines, key, "left")
    none = F.array().cast("array<string>")
    h, d = F.coalesce("_h", none), F.coalesce("_d", none)
    shown = lambda x, empty: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(empty)))
    parts = F.concat(F.array(F.lit("[Material headings]")), shown(h, "(no markdown headings found)"), F.array(F.lit("\n[Representative data lines]")), shown(d, "(no obvious table/data lines found)"))
    full = F.array_join(parts, "\n")
    cut = F.when(F.length(full) > longest, F.concat(F.substring(full, 1, longest), F.lit("\n...(fingerprint truncated)"))).otherwise(full)
    return every.select(key, cut.alias("fingerprint"), rough_language(F.concat(F.array_join(h, " "), F.array_join(F.slice(d, 1, 30), " "))).alias("language"))


def matching_metrics(nodes: DataFrame, metrics: DataFrame, on: list[str]) -> DataFrame:
    """Pairs (node_key, rule_key) where the node's title or body holds a name, material name, group or alias of the metric, regardless of case."""
    text = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.array_join(F.coalesce("body", F.array().cast("array<string>")), "\n")))
    left = nodes.select(*on, "node_key", text.alias("_text"))
    keys = F.concat(F.array("name", "name_in_material", "rule_group"), F.coalesce("aliases", F.array().cast("array<string>")))
    right = metrics.select(*on, "rule_key", F.filter(F.transform(keys, lambda k: F.lower(k)), lambda k: F.coalesce(k, F.lit("")) != "").alias("_keys"))
    return left.join(right, on).where(F.exists("_keys", lambda k: F.col("_text").contains(k))).select("node_key", "rule_key")


def metric_block(name: Column, values: Column) -> Column:
    """One line of a metric over entities: entity=value and unit, or entity=missing."""
    part = F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit("="), F.when(F.coalesce(e["value"]["value"].isin("", "null"), F.lit(True)), F.lit("missing")).otherwise(F.concat(e["value"]["value"], F.coalesce(e["value"]["unit"], F.lit(""))))))
    return F.concat(F.lit("- "), name, F.lit(": "), F.array_join(part, "; "))
