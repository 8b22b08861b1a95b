"""Choice of the announcement that carries a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def choose(titles: DataFrame, by: list[str], year: str, editions: dict[str, list[str]], barred: list[str], order: str) -> DataFrame:
    """Rows (by, order, edition): the first title of the preferred edition with the year, one of its words and none barred.

    Editions are given in order of preference.
    """
    title = F.col("title")
    has = lambda words: reduce(lambda a, w: a | title.contains(w), words, F.lit(False))
    place = reduce(lambda rest, e: F.when(has(e[1][1]), F.lit(e[0])).otherwise(rest), reversed(list(enumerate(editions.items()))), F.lit(None).cast("int"))
    good = titles.where(title.contains(F.col(year).cast("string")) & ~has(barred)).withColumn("_place", place).where(F.col("_place").isNotNull())
    best = good.groupBy(*by).agg(F.min(F.struct("_place", order)).alias("_b"))
    return best.select(*by, F.col(f"_b.{order}").alias(order), F.element_at(F.array(*map(F.lit, editions)), F.col("_b._place") + 1).alias("edition"))
