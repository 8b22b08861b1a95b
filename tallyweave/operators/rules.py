"""Rule tables: typing of raw cells, enabled rules, checks, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_bool, parse_list, strip

# Headers of rule sheets, by the column they mean.
HEADERS = {
    "id": "id 编号",
    "name": "name 名称 指标名称",
    "name_in_material": "name_in_material 素材名称 素材中的叫法",
    "source": "source 来源 来源说明 口径",
    "enabled": "enabled 启用 是否启用",
    "section_hint": "section_hint 章节线索 定位线索",
    "aliases": "aliases 别名",
    "extraction_mode": "extraction_mode 抽取模式",
    "calc": "calc 计算",
    "aggregation": "aggregation 聚合",
    "allow_parent_note": "allow_parent_note 母公司附注",
    "skip_reason": "skip_reason 备注 跳过原因",
}


def header_name(header: str | None) -> str | None:
    """The column that a sheet's header names, without regard to case and white space."""
    bare = "".join((header or "").split()).lower()
    return next((column for column, names in HEADERS.items() if bare in names.split()), None)


def typed_rules(cells: DataFrame) -> DataFrame:
    """Rules from a table of text cells: typed, rows without id or name dropped, absent columns null."""
    have = set(cells.columns)
    text = lambda c: strip(F.col(c)) if c in have else F.lit(None).cast("string")
    typed = cells.select(
        text("id").alias("id"), text("name").alias("name"), text("name_in_material").alias("name_in_material"), text("source").alias("source"),
        parse_bool(text("enabled"), True).alias("enabled"), parse_bool(text("allow_parent_note"), False).alias("allow_parent_note"),
        *(parse_list(text(c)).alias(c) for c in ("section_hint", "aliases", "company_hints")),
        F.coalesce(text("extraction_mode"), F.lit(None).cast("string") if "extraction_mode" in have else F.lit("direct")).alias("extraction_mode"),
        *(text(c).alias(c) for c in ("calc", "aggregation", "skip_reason", "rule_group")),
    )
    return typed.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))


def enabled_rules(rules: DataFrame) -> DataFrame:
    """Rules that aren't switched off; a missing switch is on."""
    return rules.where(F.coalesce("enabled", F.lit(True)))


def rule_faults(rules: DataFrame) -> DataFrame:
    """Rows (profile, rule_key, fault): missing id or name, repeated id, calculation without formula."""
    nth = F.row_number().over(Window.partitionBy("profile", "id").orderBy("rule_key"))
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    faults = F.array_compact(
        F.array(
            F.when(blank("id"), F.lit("missing id")), F.when(blank("name"), F.lit("missing name")),
            F.when(~blank("id") & (F.col("_nth") > 1), F.lit("duplicate id")), F.when((F.col("extraction_mode") == "calc") & blank("calc"), F.lit("calc without formula")),
        )
    )
    return rules.withColumn("_nth", nth).select("profile", "rule_key", F.explode(faults).alias("fault"))


def type_faults(raw: DataFrame, rule: str = "rule") -> DataFrame:
    """Rows (rule_key, fault) of rules as JSON texts: lists that are none, switches that are neither true nor false."""
    parsed = F.try_parse_json(F.col(rule))
    typed = lambda name: F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
    faults = F.array_compact(
        F.array(
            *(F.when(~typed(c).startswith("ARRAY") & (typed(c) != "VOID"), F.lit(f"{c} is no list")) for c in ("section_hint", "aliases")),
            *(F.when(~typed(c).isin("BOOLEAN", "VOID"), F.lit(f"{c} is neither true nor false")) for c in ("enabled", "allow_parent_note")),
        )
    )
    return raw.select("rule_key", F.explode(faults).alias("fault"))


def distinct_ids(rules: DataFrame) -> DataFrame:
    """Rules with ids made unique within the profile: empty ids become M01, M02 ..., repeated ones get the row's number."""
    place = Window.partitionBy("profile").orderBy("rule_key")
    numbered = rules.withColumn("_i", F.row_number().over(place))
    given = numbered.withColumn("_id", F.when(F.coalesce(strip(F.col("id")), F.lit("")) == "", F.format_string("M%02d", F.col("_i"))).otherwise(strip(F.col("id"))))
    nth = F.row_number().over(Window.partitionBy("profile", "_id").orderBy("rule_key"))
    return given.withColumn("_nth", nth).withColumn("id", F.when(F.col("_nth") > 1, F.concat_ws("_", "_id", "_i")).otherwise(F.col("_id"))).drop("_i", "_id", "_nth")


def with_material_name(rules: DataFrame) -> DataFrame:
    """The name used in the material stands first among the aliases."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    name = F.col("name_in_material")
    return rules.withColumn("aliases", F.when((F.coalesce(name, F.lit("")) != "") & ~F.array_contains(aliases, name), F.array_prepend(aliases, name)).otherwise(aliases))


def rules_by_group(rules: DataFrame) -> DataFrame:
    """Rows (profile, rule_group, n_rules, ids) in the order of the rules."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rule_key", "id"))), lambda x: x["id"])
    return rules.groupBy("profile", "rule_group").agg(F.count("*").alias("n_rules"), F.array_join(listed, ",").alias("ids"))
