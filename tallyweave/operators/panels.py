"""What the proofreading view and the figure and rule steps add: offsets, bands, coverage, figures in text, inferred rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of, strip, word_form
from ..session import cut_lineage
from . import figures
from .rules import distinct_ids, with_material_name


def line_offsets(lines: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """``lines`` with ``offset``: how many compared characters stand before a line in its group."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length(word_form(F.col(text)))).over(before), F.lit(0)))


def outside_bands(blocks: DataFrame, bands: DataFrame, by: list[str]) -> DataFrame:
    """Blocks (by, y0, y1) whose middle lies in none of the bands (by, top, bottom) of their page."""
    b = bands.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("top").alias("_top"), F.col("bottom").alias("_bottom"))
    middle = (F.col("y0") + F.col("y1")) / 2
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    condition = (F.col("_top") <= middle) & (middle <= F.col("_bottom"))
    for s in same:
        condition = s & condition
    return blocks.join(b, condition, "left_anti")


def inside(words: DataFrame, top: float, bottom: float) -> DataFrame:
    """Words whose vertical middle lies in a region."""
    return words.where(((F.col("y0") + F.col("y1")) / 2).between(top, bottom))


def anchors_of_sections(anchors: DataFrame, sections: DataFrame, by: str = "doc_id") -> DataFrame:
    """Anchors with the section whose pages hold them."""
    s = sections.select(F.col(by).alias("_by"), "section_no", "page_start", "page_end")
    return anchors.join(s, (F.col(by) == F.col("_by")) & F.col("page").between(F.col("page_start"), F.col("page_end"))).drop("_by")


def coverage(aligned: DataFrame, by: str = "doc_id") -> DataFrame:
    """Rows (by, n_blocks, n_placed): how many blocks found their place."""
    return aligned.groupBy(by).agg(F.count("*").alias("n_blocks"), F.count("page").alias("n_placed"))


def spaced_tables(text: Column) -> Column:
    """Text with an empty line before and after every run of pipe rows that lacks one."""
    lines = lines_of(text)
    is_row = lambda x: strip(x).startswith("|")

    def one(x: Column, i: Column) -> Column:
        before = F.try_element_at(lines, i.cast("int"))
        opens = is_row(x) & before.isNotNull() & (i > 0) & ~is_row(before) & (strip(before) != "")
        closes = ~is_row(x) & (i > 0) & is_row(F.coalesce(before, F.lit(""))) & (strip(x) != "")
        return F.when(opens | closes, F.concat(F.lit("\n"), x)).otherwise(x)

    return F.array_join(F.transform(lines, one), "\n")


def numeric_cells(html: Column) -> Column:
    """HTML with a class on table cells that hold a number only."""
    return F.regexp_replace(html, r"<td>(\s*[-(（]?[\d,，.]+[%)）]?\s*)</td>", '<td class="num">$1</td>')


def archived_images(documents: DataFrame, index: DataFrame, describe: Callable[[DataFrame], DataFrame], chars: int = 600) -> tuple[DataFrame, DataFrame]:
    """(documents (doc_id, text) with figures replaced by what recognition read, outcomes (doc_id, ref, status, text)).

    Each distinct reference of a document is described once, with the text
    before its first place as context; the outcomes are written out, so that
    neither a second use nor a lost executor repeats a call.
    """
    refs = documents.select("doc_id", "text", F.explode(figures.image_refs(F.col("text"))).alias("ref")).withColumn("context", figures.preceding("text", "ref", chars)).drop("text")
    found = figures.resolve(refs, index)
    named = found.withColumn("_ref", F.col("ref")).withColumn("ref", F.concat_ws("\x00", F.col("doc_id").cast("string"), "ref"))
    outcomes = describe(named).withColumn("_p", F.split("ref", "\x00")).select(F.col("_p")[0].cast("bigint").alias("doc_id"), F.col("_p")[1].alias("ref"), "status", "text")
    outcomes = cut_lineage(outcomes)
    listed = outcomes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ref", "status", "text"))).alias("_o"))
    none = F.array().cast("array<struct<ref: string, status: string, text: string>>")
    done = documents.select("doc_id", "text").join(listed, "doc_id", "left").select("doc_id", figures.replaced(F.col("text"), F.coalesce("_o", none)).alias("text"))
    return done, outcomes


#: What a model returns for the rules it infers from a sample.
INFERRED = "array<struct<id: string, name: string, name_in_material: string, group: string, source: string, section_hint: array<string>, aliases: array<string>>>"


def inferred_rules(replies: DataFrame, profile: str = "profile", reply: str = "reply") -> DataFrame:
    """Rules of replies (profile, reply as a JSON list): ids given or made unique, the material's name first among the aliases, nameless ones left out."""
    body = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    each = replies.select(profile, F.posexplode(F.from_json(body, INFERRED)).alias("_i", "r")).select(profile, (F.col("_i") + 1).cast("bigint").alias("rule_key"), "r.*").withColumnRenamed("group", "rule_group")
    return with_material_name(distinct_ids(each.where(F.coalesce(strip(F.col("name")), F.lit("")) != "")))
