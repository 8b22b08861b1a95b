"""Which profile a file belongs to; layered settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex


def load_routes(entries: list[dict]) -> list[tuple[str, str]]:
    """(pattern, profile) of the entries that have both."""
    return [(e["match"], e["profile"]) for e in entries if e.get("match") and e.get("profile")]


def route(path: Column, routes: list[tuple[str, str]], default: str | None) -> Column:
    """The first route whose pattern the path matches, regardless of case, else the default.

    Routes are a short list in the settings, so they become one expression.
    """
    return reduce(lambda rest, r: F.when(path.rlike(glob_to_regex(r[0])), F.lit(r[1])).otherwise(rest), reversed(routes), F.lit(default).cast("string"))


def unknown_profiles(used: DataFrame, known: DataFrame) -> DataFrame:
    """Profiles in use that don't exist."""
    return used.select("profile").where(F.col("profile").isNotNull()).distinct().join(known.select("profile"), "profile", "left_anti")


def overlay(base: dict, over: dict) -> dict:
    """Settings with another layer on top; only dictionaries are merged, anything else is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = overlay(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out
