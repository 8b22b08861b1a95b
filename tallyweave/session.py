"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the plans are made for; values a cluster sets itself are kept.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster use the one it gives."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tallyweave")
    settings = DEFAULTS | {"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": str(cpus), "spark.ui.showConsoleProgress": "false"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a
    folder of this machine is used in local mode, as in tests; on a cluster it is
    an error, for the executors would not share it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not (context.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tallyweave-"))
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once an application, unless their path already has it.

    The archive is staged on the driver only; Spark hands it to every executor,
    those that replace lost ones too.
    """
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="tallyweave-")) / "tallyweave.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted((root / "tallyweave").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
