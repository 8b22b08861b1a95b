"""Rules against chunks: scored retrieval and the best chunks per rule."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES

try:
    import ahocorasick
except ImportError:  # terms are then looked for one by one
    ahocorasick = None

# Weights and the words whose presence tells a table.
WEIGHTS = {"alias": 4.0, "section_base": 3.0, "text_base": 2.0, "step": 1.0, "company": 10.0, "table": 1.0}
TABLE_SIGNALS = ("单位：", "项目", "本期", "上期", "同比", "%", "Unit", "Item", "Current", "Prior", "YoY")
_SPACES = re.compile(f"[{re.escape(SPACES)}]+")


#: Bytes of terms that one pass over the chunks takes to the workers.
BLOCK_BYTES = 4_000_000
_ALIAS, _SECTION, _COMPANY = range(3)


def _formed(text: str | None) -> str:
    """``match_form`` of a text in a worker."""
    return _SPACES.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()) if text else ""


def alternatives(term: str | None) -> set[str]:
    """Match forms of a term's alternatives: its parts between slashes, or itself if there are none; a blank term has none."""
    whole = (term or "").strip(SPACES)
    parts = [p for p in (p.strip(SPACES) for p in whole.split("/")) if p]
    return {_formed(p) for p in parts or [whole]} - {""}


class Terms:
    """The terms of the rules that share a key, as one automaton, and what a term found in a text or section is worth."""

    def __init__(self, rules: Sequence[tuple], weights: dict[str, float]) -> None:
        self.table = weights["table"]
        self.keys = [key for key, *_ in rules]
        self.parents = [parent for _, parent, *_ in rules]
        groups: dict[str, list[int]] = {}
        self.owner: list[int] = []  # rule of each group of alternatives
        self.worth: list[tuple[float, float]] = []  # of a group found in the text, in the section
        for r, (_, _, *lists) in enumerate(rules):
            for kind, listed in zip((_ALIAS, _SECTION, _COMPANY), lists):
                for place, term in enumerate(listed or ()):
                    if kind == _ALIAS:
                        worth = weights["alias"], 0.0
                    elif kind == _COMPANY:
                        worth = weights["company"], weights["company"]
                    else:  # hints weigh more the later they stand, empty ones counted
                        worth = weights["text_base"] + place * weights["step"], weights["section_base"] + place * weights["step"]
                    for form in alternatives(term):
                        groups.setdefault(form, []).append(len(self.owner))
                    self.owner.append(r)
                    self.worth.append(worth)
        self.groups = groups
        self.automaton = None
        if ahocorasick and groups:
            self.automaton = ahocorasick.Automaton()
            for term, numbers in groups.items():
                self.automaton.add_word(term, numbers)
            self.automaton.make_automaton()

    def found(self, text: str) -> set[int]:
        """Groups of which some alternative stands in the text."""
        if not text:
            return set()
        if self.automaton is not None:
            hits = {id(numbers): numbers for _, numbers in self.automaton.iter(text)}.values()
        else:
            hits = [numbers for term, numbers in self.groups.items() if term in text]
        return {g for numbers in hits for g in numbers}

    def scores(self, text: str, section: str, has_table: bool, parent: bool) -> Iterator[tuple[object, float]]:
        """(rule_key, score) of the rules for such chunks with a score above 0."""
        sums = [self.table * has_table] * len(self.keys)
        for where, groups in enumerate((self.found(text), self.found(section))):
            for g in groups:
                sums[self.owner[g]] += self.worth[g][where]
        return ((key, total) for key, wants, total in zip(self.keys, self.parents, sums) if total > 0 and wants == parent)


def _scored_block(chunks: DataFrame, rules: list, on: tuple[str, ...], weights: dict[str, float], schema: str) -> DataFrame:
    by_key: dict[tuple, list[tuple]] = {}
    for r in rules:
        key = tuple(r[c] for c in on)
        if None not in key:
            by_key.setdefault(key, []).append((r["rule_key"], r["_parent"], r["aliases"], r["section_hint"], r["company_hints"]))

    key_type = {"bigint": pa.int64(), "int": pa.int32()}.get(schema.rpartition("rule_key ")[2].split(",")[0], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple, Terms] = {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            at, keys, scores = [], [], []
            for i, (text, path, parent, *key) in enumerate(zip(*columns[3:])):
                key = tuple(key)
                if key not in by_key:
                    continue
                terms = made.get(key)
                if terms is None:
                    terms = made[key] = Terms(by_key[key], weights)
                section = _formed(" > ".join(x for x in path if x is not None)) if path else ""
                signals = sum(s in text for s in TABLE_SIGNALS) if text else 0
                for rule, score in terms.scores(_formed(text), section, signals >= 2, bool(parent)):
                    at.append(i)
                    keys.append(rule)
                    scores.append(score)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(taken) for k in range(3)), pa.array(keys, key_type), pa.array(scores, pa.float64())], names=["doc_id", "chunk_key", "chunk_id", "rule_key", "score"])

    return chunks.mapInArrow(run, schema)


def scored(chunks: DataFrame, rules: DataFrame, on: tuple[str, ...] = ("profile",), weights: dict[str, float] = WEIGHTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rule-chunk pairs with a score above 0, without a shuffle.

    ``on`` names columns both sides share: a chunk meets the rules of its own
    profile. Rules that want parent notes meet only chunks marked so, the others
    only the rest; no mark means no. The terms of a profile's rules are one
    automaton, so a chunk is read once whatever their number; rules go to the
    workers in blocks of at most about ``block_bytes`` of terms, each block
    against all chunks. Text stays where it is scanned.
    """
    weights = WEIGHTS | weights
    terms = ("aliases", "section_hint", "company_hints")
    right = rules.select(*on, "rule_key", F.coalesce("allow_parent_note", F.lit(False)).alias("_parent"), *terms)
    size = sum((F.coalesce(F.octet_length(F.array_join(c, "")) + 16 * F.size(c), F.lit(0)) for c in terms), F.lit(64))
    total = right.select(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    mark = F.coalesce("is_parent_note_block", F.lit(False)) if "is_parent_note_block" in chunks.columns else F.lit(False)
    left = chunks.select("doc_id", "chunk_key", "chunk_id", "text", "section_path", mark.alias("_mark"), *on)
    schema = ", ".join(f"{c} {(right if c == 'rule_key' else left).schema[c].dataType.simpleString()}" for c in ("doc_id", "chunk_key", "chunk_id", "rule_key")) + ", score double"
    out = None
    for block in range(blocks):
        share = right if blocks == 1 else right.where(F.pmod(F.xxhash64("rule_key"), F.lit(blocks)) == block)
        found = _scored_block(left, share.collect(), on, weights, schema)
        out = found if out is None else out.unionByName(found)
    return out


def best_chunks(pairs: DataFrame, topk: int = 12) -> DataFrame:
    """The ``topk`` chunks of each document and rule by score, then chunk_id as text, then key: a top-k report."""
    order = Window.partitionBy("doc_id", "rule_key").orderBy(F.desc("score"), "chunk_id", "chunk_key")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= topk)
