"""Session defaults."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that Python functions get at once.
ROWS_PER_BATCH = 1000
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS_PER_BATCH),
}


def build(app: str = "grainmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword arguments use ``_`` for ``.`` in setting names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers on machines that share this checkout import the package, and bound their batches.

    Elsewhere, install the package on the workers.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [*paths, root] if p)
    # Rows of whole texts: a batch of the default ten thousand could be gigabytes.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input has fewer splits than that, as a file of one row group has, for work that is dear by row.

    As they are otherwise, as on any input of a size that matters. The number of splits is asked of the planner; no row is read for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
