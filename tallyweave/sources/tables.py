"""The report tables as parquet folders or files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out to the cores where it lies in far fewer files than there are.

    Large tables have many files and stay as they lie, so nothing moves at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if 2 * df.rdd.getNumPartitions() <= cores else df
