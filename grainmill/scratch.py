"""Tables that cut lineage, in the folder all executors share.

The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only where that is unset, as
in tests, a folder of our own is set; on a cluster that is an error. A written table survives the loss of any executor, and is read
back with column pruning, which an RDD checkpoint is not.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

FALLBACK = "/tmp/grainmill-checkpoints"
_seen: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Root of this application's scratch tables, as a path or URI that Spark can write."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = FALLBACK
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.applicationId not in _seen:
        _seen.add(spark.sparkContext.applicationId)
        atexit.register(clear, spark)
    return f"{root.rstrip('/')}/grainmill/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path below :func:`shared_dir` that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the frame that reads it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove every scratch table of this application, as also at the interpreter's end, if the session lives still."""
    if spark.sparkContext._jsc is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
