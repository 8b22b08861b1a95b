"""Arrow-batch plumbing shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_texts(df: DataFrame, columns: dict[str, str], schema: str, make: Callable[[], Callable[[dict[str, list]], pa.RecordBatch]]) -> DataFrame:
    """Run a kernel over Arrow batches of a few columns, without a shuffle.

    ``columns`` names the kernel's inputs and the columns they come from, so
    other columns of ``df``, whatever their names, are never read. ``make`` is
    called once a task and returns the kernel: lists by input name in, one
    record batch out.
    """
    picked = df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            if batch.num_rows:
                yield kernel({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})

    return picked.mapInArrow(run, schema)
