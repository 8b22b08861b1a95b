"""Image references in Markdown, their context, and what recognition gave for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"


def image_refs(text: Column) -> Column:
    """Distinct image references in the order of their first place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IMAGE), 1), lambda r: F.trim(r)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def resolve(refs: DataFrame, index: DataFrame) -> DataFrame:
    """``refs`` (..., ref) with ``path``: the file of that base name under the first root, null if there is none."""
    best = index.groupBy(base_name(F.col("path")).alias("_name")).agg(F.min_by("path", F.struct("root_no", "path")).alias("path"))
    return refs.join(best, base_name(F.col("ref")) == F.col("_name"), "left").drop("_name")


def preceding(text: str, ref: str, chars: int = 600) -> Column:
    """The ``chars`` characters before the first place of column ``ref`` in column ``text``, image marks removed and trimmed."""
    at = F.position(F.col(ref), F.col(text))
    start = F.greatest(F.lit(1), at - chars)
    before = F.when(at > 1, F.substring(F.col(text), start, at - start)).otherwise(F.lit(""))
    return F.trim(F.regexp_replace(before, r"!\[[^\]]*\]\([^)]+\)", ""))


def status_counts(outcomes: DataFrame, by: str = "doc_id") -> DataFrame:
    """A column per status: ok, empty, failed, missing."""
    return outcomes.groupBy(by).pivot("status", ["ok", "empty", "failed", "missing"]).count().fillna(0, ["ok", "empty", "failed", "missing"])


def last_texts(lines: DataFrame, by: str, order: str, text: str, n: int = 5) -> DataFrame:
    """``lines`` with ``context``: the n texts before each."""
    window = Window.partitionBy(by).orderBy(order).rowsBetween(-n, -1)
    return lines.withColumn("context", F.array_join(F.collect_list(text).over(window), "\n"))


def replaced(text: Column, outcomes: Column) -> Column:
    """Text with each reference of ``outcomes`` (array of ref, status, text) replaced: ok by its text, empty by nothing, others kept."""

    def one(acc: Column, o: Column) -> Column:
        mark = F.concat(F.lit("!["), F.regexp_extract(F.call_function("substring_index", acc, F.concat(F.lit("]("), o["ref"], F.lit(")")), F.lit(1)), r"!\[([^\]\[]*)$", 1), F.lit("]("), o["ref"], F.lit(")"))
        new = F.when(o["status"] == "ok", F.concat(F.lit("\n\n"), o["text"], F.lit("\n\n"))).when(o["status"] == "empty", F.lit("")).otherwise(mark)
        return F.when(acc.contains(mark), F.replace(acc, mark, new)).otherwise(acc)

    return F.aggregate(outcomes, text, one)
