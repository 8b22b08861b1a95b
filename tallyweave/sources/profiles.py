"""Profiles as folders: settings, prompts and rules of a kind of report."""

from __future__ import annotations

import json
import re
from dataclasses import fields, replace
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pipeline import Settings
from .files import read_rules
from .office import rule_cells, write_workbook

# The parts of a profile's folder, and the columns of a rule sheet.
CONFIG, PROMPTS, RULES = "profile.json", {"global_prompt": "prompts/global.txt", "template": "prompts/chunk.txt", "whole_template": "prompts/whole.txt"}, "rules/rules.json"
RULE_COLUMNS = ["id", "name", "name_in_material", "source", "enabled", "section_hint", "aliases", "extraction_mode", "calc", "aggregation", "allow_parent_note", "skip_reason"]
_UNSAFE = re.compile(r'[\\/:*?"<>|\s]+')


def list_profiles(root: str) -> list[str]:
    """Names of the profiles under a folder, in order."""
    return sorted(p.parent.name for p in Path(root).glob(f"*/{CONFIG}"))


def load_profile(root: str, name: str) -> Settings:
    """A profile's settings over the defaults; an unknown profile is an error that names those that exist."""
    folder = Path(root) / name
    if not (folder / CONFIG).is_file():
        raise ValueError(f"no profile {name}; there are {', '.join(list_profiles(root)) or 'none'}")
    config = json.loads((folder / CONFIG).read_text("utf-8-sig"))
    retrieval = config.get("retrieval", {})
    given = {"language": config.get("language"), "period": config.get("report_period_hint"), "topk": retrieval.get("topk"), "weights": retrieval.get("weights"), "window": config.get("llm", {}).get("max_chars_context")}
    chunking = config.get("chunking", {})
    given |= {"max_chars": chunking.get("max_chars"), "heading_levels": chunking.get("heading_levels"), "strategy": chunking.get("strategy")}
    given |= {key: (folder / path).read_text("utf-8-sig") for key, path in PROMPTS.items() if (folder / path).is_file()}
    known = {f.name for f in fields(Settings)}
    return replace(Settings(), **{k: v for k, v in given.items() if v is not None and k in known})


def profile_name(title: str) -> str:
    """A folder's name from a title: signs that paths don't take become underscores."""
    return _UNSAFE.sub("_", title.strip()).strip("_.") or "profile"


def save_profile(root: str, title: str, config: dict, rules: list[dict], prompts: dict[str, str] | None = None) -> str:
    """Write a profile's folder; its name. An existing profile of the name is an error."""
    name = profile_name(title)
    folder = Path(root) / name
    if folder.exists():
        raise ValueError(f"profile {name} exists")
    (folder / RULES).parent.mkdir(parents=True)
    (folder / CONFIG).write_text(json.dumps(config, ensure_ascii=False, indent=2), "utf-8")
    (folder / RULES).write_text(json.dumps({"count": len(rules), "rules": rules}, ensure_ascii=False, indent=2), "utf-8")
    for key, text in (prompts or {}).items():
        path = folder / PROMPTS[key]
        path.parent.mkdir(exist_ok=True)
        path.write_text(text, "utf-8")
    return name


def rules_workbook(path: str, rules: DataFrame, most: int = 100_000) -> None:
    """A workbook with a sheet of rules per group, lists joined by commas; reading it back gives the rules. More than ``most`` rules are an error."""
    flat = rules.select("rule_key", F.coalesce("rule_group", F.lit("")).alias("rule_group"), *(F.array_join(c, ", ").alias(c) if c in ("section_hint", "aliases") else F.col(c).cast("string").alias(c) for c in RULE_COLUMNS))
    rows = flat.orderBy("rule_key").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules don't fit a workbook")
    groups: dict[str, list[tuple]] = {}
    for row in rows:
        groups.setdefault(row.rule_group, []).append(tuple(row[c] for c in RULE_COLUMNS))
    write_workbook(path, [(name or "rules", [RULE_COLUMNS, *sheet]) for name, sheet in groups.items()] or [("rules", [RULE_COLUMNS])])


def rules_of_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Typed rules of a workbook."""
    from ..operators.rules import typed_rules

    cells = rule_cells(path)
    columns = sorted({c for row in cells for c in row} | {"id", "name", "rule_group"})
    schema = ", ".join(f"`{c}` string" for c in columns)
    return typed_rules(spark.createDataFrame([tuple(row.get(c) for c in columns) for row in cells], schema))


def cached_rules(spark: SparkSession, workbook: str, cache: str) -> DataFrame:
    """Rules of a workbook, converted once: the cache keeps the signature of the file that it was made of."""
    source = Path(workbook)
    stat = source.stat()
    row = spark.range(1).select(F.substring(F.md5(F.concat_ws("|", F.lit(str(source.resolve())), F.lit(str(stat.st_mtime_ns)), F.lit(str(stat.st_size)))), 1, 12)).first()
    target = Path(cache)
    known = json.loads(target.read_text("utf-8")).get("_sig") if target.is_file() else None
    if known != row[0]:
        rules = [r.asDict() for r in rules_of_workbook(spark, workbook).withColumnRenamed("rule_group", "group").collect()]  # a workbook made by people
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps({"_sig": row[0], "_source": source.name, "count": len(rules), "rules": rules}, ensure_ascii=False), "utf-8")
    return read_rules(spark, str(target))


def save_prompts(prompts: DataFrame, folder: str, scope: str = "main", at: datetime | None = None) -> None:
    """Write prompts (rule_id, prompt) as texts for auditing, a folder <time>_<scope>_<rule> each, from the executors."""
    stamp = (at or datetime.now()).strftime("%Y%m%d_%H%M%S_%f")
    rule = F.regexp_replace(F.coalesce("rule_id", F.lit("unknown")), r'[\\/:*?"<>|\s]+', "_")
    name = F.concat_ws("_", F.lit(stamp), F.lit(_UNSAFE.sub("_", scope or "main")), rule)
    prompts.select(name.alias("file"), "prompt").write.mode("append").partitionBy("file").text(folder)

