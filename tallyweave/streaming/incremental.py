"""The same operators over arriving files: structured streams that stop when all is read.

Chunking is a function of one row, so it runs on a stream unchanged; the state of
latest results is bounded by a watermark on the extraction time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import build_chunks
from ..operators.results import normalised


def arriving(spark: SparkSession, folder: str, schema, form: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(form).load(folder)


def chunk_stream(documents: DataFrame, max_chars: int = 4500) -> DataFrame:
    """Chunks of documents as they arrive."""
    return build_chunks(documents, max_chars=max_chars)


def normalised_stream(results: DataFrame) -> DataFrame:
    return normalised(results)


def counts_by_day(results: DataFrame, late: str = "10 days") -> DataFrame:
    """Results and absent values per extraction day and company; days are closed once ``late`` has passed."""
    marked = results.withColumn("extracted_at", F.col("extracted_at").cast("timestamp")).withWatermark("extracted_at", late)
    return marked.groupBy(F.window("extracted_at", "1 day").alias("day"), "company").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("value").isin("", "null"), F.lit(True))).alias("n_absent"))


def run_all(stream: DataFrame, target: str, checkpoint: str, form: str = "parquet", mode: str = "append") -> None:
    """Process what has arrived, each file once, and stop."""
    stream.writeStream.format(form).option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
