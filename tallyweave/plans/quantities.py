"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.units import read_units, same_quantities
from ..sources.tables import dealt, table


def p1_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_units(dealt(table(spark, sf_dir, "metric_results"), "result_id"), table(spark, sf_dir, "unit_factors"), table(spark, sf_dir, "documents").select("doc_id", "lang"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_quantities(p1_units(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_units": p1_units}
ORACLES: dict[str, str] = {}
