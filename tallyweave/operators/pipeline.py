"""The whole way from recognised text to compared results, as one composition of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import chunks, extraction, headings, retrieval, rules
from .results import first_present, for_every_rule


#: Error of a rule that no chunk was retrieved for.
NO_CONTEXT = "no relevant context retrieved"


@dataclass(frozen=True)
class Settings:
    """What a profile sets."""

    language: str = "zh"
    max_chars: int = 4500
    heading_levels: int = 6
    strategy: str = "auto"
    promote: bool = True
    longest_heading: int = 0
    topk: int = 12
    window: int = 32000
    weights: dict[str, float] = field(default_factory=lambda: dict(retrieval.WEIGHTS))
    template: str = extraction.TEMPLATE
    whole_template: str = extraction.WHOLE
    global_prompt: str = ""
    period: str = ""
    pages: str | None = None


def _with_profile(df: DataFrame) -> DataFrame:
    """Documents and rules meet by profile; where a table has none, all of it is one profile."""
    return df if "profile" in df.columns else df.withColumn("profile", F.lit(""))


def prepared(documents: DataFrame, settings: Settings) -> DataFrame:
    """Chunks of documents (doc_id, profile, text) after heading promotion and page filter, with a key."""
    given = _with_profile(documents).select("doc_id", "profile", "text")
    text = headings.relevel(given, language=settings.language, promote=True, longest=settings.longest_heading) if settings.promote else given
    # the profile rides along in the key, so that chunking needs no join afterwards
    keyed = text.withColumn("_key", F.struct("doc_id", "profile"))
    built = chunks.build_chunks(keyed, "_key", "text", max_chars=settings.max_chars, heading_levels=settings.heading_levels, strategy=settings.strategy)
    parts = built.select(F.col("_key.doc_id").alias("doc_id"), F.col("_key.profile").alias("profile"), "chunk_id", "page_start", "page_end", "section_path", "text")
    return chunks.on_pages(parts.withColumn("chunk_key", F.xxhash64("doc_id", "chunk_id")), settings.pages)


def extract(documents: DataFrame, rule_table: DataFrame, responder: Callable[[str], str], settings: Settings = Settings()) -> DataFrame:
    """Rows (doc_id, id, name, value, value_num, unit, source_text, error): a row per document and enabled rule of its profile.

    The replies are written out before they are used, so that neither a second
    use nor a lost executor asks a prompt again. A failed call and a rule without
    context end in the error column.
    """
    active = _with_profile(rules.enabled_rules(rule_table))
    parts = prepared(documents, settings)
    best = retrieval.best_chunks(retrieval.scored(parts, active, weights=settings.weights), settings.topk)
    prompts = extraction.rule_prompts(extraction.contexts(best, parts, settings.window), active, settings.template, settings.global_prompt)
    replies = cut_lineage(extraction.respond(prompts, ["doc_id", "rule_key"], responder))
    found = replies.join(active.select("rule_key", F.col("id").alias("_id")), "rule_key").select("doc_id", F.col("_id").alias("id"), "value", "unit", "source_text", "error")
    return for_every_rule(_wanted(documents, active), found, missing=NO_CONTEXT)


def extract_whole(documents: DataFrame, rule_table: DataFrame, responder: Callable[[str], str], settings: Settings = Settings()) -> DataFrame:
    """The same without retrieval: every window of a document is asked for all rules of its profile at once, the first value wins.

    A rule without a value has the error of the document's first failed window, if one failed.
    """
    active = _with_profile(rules.enabled_rules(rule_table))
    parts = prepared(documents, settings)
    of = _with_profile(documents).select("doc_id", "profile").distinct()
    windows = chunks.pack_windows(parts, settings.window).join(of, "doc_id")
    prompts = extraction.whole_prompts(windows, active, settings.whole_template, settings.global_prompt, settings.period, settings.window)
    replies = cut_lineage(extraction.respond(prompts, ["doc_id", "window_no"], responder, many=True))
    found = first_present(replies.where(F.col("id").isNotNull()), ["doc_id", "id"], keep=("source_text", "error"))
    failed = replies.where(F.col("error") != "").groupBy("doc_id").agg(F.min_by("error", "window_no").alias("_failed"))
    rows = for_every_rule(_wanted(documents, active), found.drop("from_window")).join(failed, "doc_id", "left")
    return rows.withColumn("error", F.when(F.col("value").isNull() & (F.col("error") == ""), F.coalesce("_failed", F.lit(""))).otherwise(F.col("error"))).drop("_failed")


@dataclass
class Run:
    """What became of a staged run: the result of each stage that ran, and the error of each that failed."""

    results: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def run_stages(stages: Sequence[tuple[str, Callable[[Run], DataFrame]]], wanted: Collection[str] | None = None) -> Run:
    """Run the wanted stages in order, each with what the former ones gave; an error is kept and ends the run, not raised."""
    run = Run()
    for name, stage in stages:
        if wanted is None or name in wanted:
            try:
                run.results[name] = stage(run)
            except Exception as e:  # noqa: BLE001 - whatever a stage raises is part of the result
                run.errors[name] = str(e)
                break
    return run


def _wanted(documents: DataFrame, active: DataFrame) -> DataFrame:
    return _with_profile(documents).select("doc_id", "profile").distinct().join(active.select("profile", "id", "name").distinct(), "profile").select("doc_id", "id", "name")
