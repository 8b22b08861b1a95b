"""Extracted results: normalisation, merging over windows, comparison over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import parse_number
from ..functions.text import absent, value_with_unit


def normalised(results: DataFrame) -> DataFrame:
    """Results with the number read from the value; a missing error is empty."""
    return results.select(
        "result_id", "doc_id", "id", "name", F.coalesce("rule_group", F.lit("")).alias("rule_group"), "value", parse_number(F.col("value")).alias("value_num"), "unit", "source_text", F.coalesce("error", F.lit("")).alias("error")
    )


def first_present(responses: DataFrame, by: list[str], window: str = "window_no", order: str = "item_no", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per key the first window's value that isn't absent; within a window the last item of an id counts.

    Two aggregations, both partial before the shuffle: the last item per window
    and key, then the first of those with a value. ``keep`` names further columns
    of the item to keep.
    """
    fields = ["value", "unit", *keep]
    last = responses.groupBy(*by, window).agg(F.max_by(F.struct(*fields), order).alias("_item"))
    kept = last.where(~absent(F.col("_item.value")))
    return kept.groupBy(*by).agg(F.min_by("_item", window).alias("_item"), F.min(window).alias("from_window")).select(*by, *(F.col(f"_item.{f}").alias(f) for f in fields), "from_window")


def for_every_rule(rules: DataFrame, found: DataFrame, missing: str = "") -> DataFrame:
    """A row for each document and rule; where nothing was found nulls and ``missing`` as the error.

    The source text and the errors of ``found`` are kept where it has them.
    """
    joined = rules.join(found.withColumn("_found", F.lit(True)), ["doc_id", "id"], "left")
    told = F.coalesce("error", F.lit("")) if "error" in found.columns else F.lit("")
    source = ["source_text"] if "source_text" in found.columns else []
    error = F.when(F.col("_found"), told).otherwise(F.lit(missing))
    return joined.select("doc_id", "id", "name", "value", parse_number(F.col("value")).alias("value_num"), "unit", *source, error.alias("error"))


def with_aliases(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Results with the aliases of their rule, none where there is no such rule; of repeated rules the first."""
    aliases = rules.groupBy("id").agg(F.min_by("aliases", "rule_key").alias("aliases"))
    return results.join(aliases, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def last_result(results: DataFrame, by: list[str]) -> DataFrame:
    """Of repeated results the one with the greatest result_id."""
    return results.groupBy(*by).agg(F.max_by(F.struct("name", "rule_group", "value", "unit"), "result_id").alias("_r")).select(*by, "_r.*")


def comparison(results: DataFrame, entities: list[str], entity: str = "entity") -> DataFrame:
    """Wide table: a row per id, a column of formatted values per entity.

    The entities are named, so no pass over the data looks for them. Name and
    group come from the first entity, in the order given, that has the id.
    """
    place = F.coalesce(F.array_position(F.array(*map(F.lit, entities)), F.col(entity)), F.lit(0))
    cells = results.where(F.col(entity).isin(*entities)).withColumn("_cell", value_with_unit(F.col("value"), F.col("unit"))).withColumn("_place", place)
    heads = cells.groupBy("id").agg(F.min_by("name", "_place").alias("name"), F.min_by("rule_group", "_place").alias("rule_group"))
    wide = cells.groupBy("id").pivot(entity, entities).agg(F.max_by("_cell", "result_id"))
    return heads.join(wide, "id")


def comparison_long(results: DataFrame, entity: str = "entity") -> DataFrame:
    """Rows (id, entity, name, rule_group, cell): every entity's last formatted value of every id.

    Name and group come from the first entity by name that has the id. Rows
    without an entity take no part.
    """
    last = results.where(F.col(entity).isNotNull()).groupBy("id", entity).agg(F.max_by(F.struct("name", "rule_group", "value", "unit"), "result_id").alias("_r"))
    heads = last.groupBy(F.col("id").alias("_id")).agg(F.min_by(F.struct("_r.name", "_r.rule_group"), entity).alias("_h"))
    joined = last.join(heads, F.col("id").eqNullSafe(F.col("_id")))
    return joined.select("id", entity, F.col("_h.name").alias("name"), F.col("_h.rule_group").alias("rule_group"), value_with_unit(F.col("_r.value"), F.col("_r.unit")).alias("cell"))


def records(results: DataFrame, entity: str = "entity") -> DataFrame:
    """A row per id with a map from entity to value and unit; of repeated results the last counts.

    The entities are those being compared: a bounded set, as the map is one cell.
    """
    last = results.groupBy("id", entity).agg(F.max_by(F.struct("name", "value", "unit"), "result_id").alias("_r"))
    present = last.where(~absent(F.col("_r.value")))
    return present.groupBy("id").agg(F.min("_r.name").alias("name"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(entity), F.struct(F.col("_r.value").alias("value"), F.col("_r.unit").alias("unit")).alias("v"))))).alias("values"))


def sheet_names(names: DataFrame, name: str, base) -> DataFrame:
    """Names of sheets: the base, with a number from the second of the same base on."""
    nth = F.row_number().over(Window.partitionBy(F.lower(base)).orderBy(name))
    suffix = F.concat(F.lit("_"), nth.cast("string"))
    return names.withColumn("sheet", F.when(nth == 1, base).otherwise(F.concat(F.substring(base, 1, 31 - F.length(suffix)), suffix)))


def in_rule_order(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Results with their rule's place; unknown rules come last."""
    places = rules.groupBy("id").agg(F.min("rule_key").alias("_place"))
    return results.join(places, "id", "left").withColumn("place", F.coalesce("_place", F.lit(9999).cast("bigint"))).drop("_place")
