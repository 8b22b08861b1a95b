"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import metrics, pages, quantities, structure

_MODULES = (quantities, structure, metrics, pages)
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of every rule: scan, match form, scoring, top-k."""
    return QUERIES["retrieve_topk"](spark, sf_dir)
